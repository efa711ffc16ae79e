"""Canonical JSON: numbers, odd texts, and the scenario's form and its stored records."""

import hashlib

import pytest

from polyglint.functions import canonical


def form(number, more=""):
    return '{"ScenarioId":"s","Snippets":[{"Action":' + number + ',"ReferenceIndex":0}],"TalkData":[],"SpecialEffectData":[],"AppearCharacters":[]' + more + "}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("written, shown", [("1.0", "1"), ("1e0", "1"), ("-0", "-0"), ("0.000001", "0.000001"), ("0.0000001", "1e-7"), ("1e20", "100000000000000000000"), ("1e21", "1e+21"), ("123456789012345678901234", "1.2345678901234569e+23"), ("12345678901234567890", "12345678901234567000"), ("-1.50", "-1.5"), ("5e-324", "5e-324"), ("100", "100")])
def test_numbers(written, shown):
    assert canonical.shortest(written) == shown


@pytest.mark.parametrize("number, problem", [("1", None), ("1.0", "not_canonical"), ("1e0", "not_canonical"), ("1e400", "not_json"), ("NaN", "not_json")])
def test_stored_numbers(number, problem):
    body = form(number)
    assert canonical.stored_problem(1, "1", "s", body, sha(body)) == problem


def test_scenarios():
    body, digest, problem = canonical.scenario_form('{"TalkData":[],"x":1,"AppearCharacters":[],"ScenarioId":"s","SpecialEffectData":[],"Snippets":[{"ReferenceIndex":0,"Action":1.0}]}', "s")
    assert (body, digest, problem) == (form("1"), sha(form("1")), None)
    assert canonical.scenario_form(form("1"), "t")[2] == "id_mismatch"
    assert canonical.scenario_form('{"ScenarioId":5}', "5")[2] == "id_missing"
    assert canonical.scenario_form('{"ScenarioId":"s","Snippets":[],"TalkData":null}', "s")[2] == "not_array:TalkData"
    assert [canonical.scenario_form(x, "s")[2] for x in ("[]", "", None, "{} {}", "[" * 100_000)] == ["not_object", "not_json", "not_json", "not_json", "not_json"]
    good = form("1")
    assert canonical.stored_problem(0, "1", "s", good, sha(good)) == canonical.stored_problem(1, " ", "s", good, sha(good)) == "incomplete_identity"
    assert canonical.stored_problem(1, "1", "s", good, sha("x")) == "digest_mismatch"
    spaced = form("1", " ")
    assert canonical.stored_problem(1, "1", "s", spaced, sha(spaced)) == "not_canonical"
    assert canonical.stored_problem(1, "1", "s", good + " {}", sha(good + " {}")) == "not_json"


def test_no_text_fails_the_job(spark):
    texts = ['{"b":1.50,"a":"<\\u2028"}', '"\\ud800"', "[" * 50_000, "NaN", None, "", '{"a":1,"a":2}', "123456789012345678901234567890.10"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, t string")
    got = [r.c for r in df.select("k", canonical.canonical_json_udf("t").alias("c")).orderBy("k").collect()]
    assert got == ['{"a":"\\u003c\\u2028","b":1.50}', '"�"', None, None, None, None, '{"a":2}', "123456789012345678901234567890.10"]


def test_scenarios_are_dealt_to_all_partitions(spark):
    """The table of parts is one split; the work on its rows is not left to one task."""
    import __spark_entry__

    made = __spark_entry__.queries()["n02_scenarios"](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
