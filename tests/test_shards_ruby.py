"""Shards under two ceilings and readings over segments, against sequential versions."""

import hashlib
import random

import pytest
import regex

from polyglint.operators import ruby, shards


def plan(sizes, most_encoded, most_raw):
    out, start = [], 0
    while start < len(sizes):
        encoded, raw, end = len('{"schemaVersion":1,"ordinal":%d,"items":[]}' % len(out)), 0, start
        while end < len(sizes):
            e, r = encoded + (end > start) + sizes[end][0], raw + sizes[end][1]
            if r > most_raw or e > most_encoded:
                break
            encoded, raw, end = e, r, end + 1
        if end == start:
            return out, start
        out.append((len(out), start, end, end - start, encoded, raw, start, end - 1))
        start = end
    return out, None


def run(spark, sizes, most_encoded, most_raw):
    df = spark.createDataFrame([(i, e, r) for i, (e, r) in enumerate(sizes)], "k long, e long, r long").repartition(5)
    found, unfit = shards.planned(df, "k", "e", "r", most_encoded, most_raw)
    rest = [r.id for r in unfit.collect()]
    return sorted(tuple(r) for r in found.collect()), rest[0] if rest else None


@pytest.mark.parametrize("seed, n, most_encoded, most_raw", [(1, 300, 120, 60), (2, 150, 60, 1000), (3, 40, 10_000, 15), (4, 60, 90, 0)])
def test_equals_the_sequential_fill(spark, seed, n, most_encoded, most_raw):
    r = random.Random(seed)
    sizes = [(r.randrange(1, 12), 0 if most_raw == 0 else r.randrange(0, 8)) for _ in range(n)]
    assert run(spark, sizes, most_encoded, most_raw) == plan(sizes, most_encoded, most_raw)


def test_exact_ceilings_and_items_that_fit_nowhere(spark):
    room = 60 - shards.overhead(1)
    exact = [(room, 5), (room, 5), (1, 1), (room - 2, 1), (1, 9)]
    assert run(spark, exact, 60, 10) == plan(exact, 60, 10)
    assert [x[3] for x in plan(exact, 60, 10)[0]] == [1, 1, 2, 1]
    late = [(3, 1)] * 30 + [(room + 1, 1)] + [(3, 1)] * 5
    assert run(spark, late, 60, 10) == plan(late, 60, 10) and plan(late, 60, 10)[1] == 30
    assert run(spark, [(3, 99)], 60, 10) == ([], 0)
    assert run(spark, [], 60, 10) == ([], None)


def test_bodies_and_digests(spark):
    items = [(i, "{" + "x" * (i % 7) + "}", i % 3) for i in range(25)]
    found, unfit = shards.sealed(spark.createDataFrame(items, "k long, body string, raw long"), "k", "body", "raw", 70, 8)
    rows = sorted(found.collect(), key=lambda r: r.ordinal)
    assert unfit.collect() == []
    assert ",".join(r.body.split("[", 1)[1][:-2] for r in rows) == ",".join(b for _, b, _ in items)
    for r in rows:
        assert len(r.body) == r.encoded_bytes <= 70 and r.sha256 == hashlib.sha256(r.body.encode()).hexdigest()
        assert r.body.startswith('{"schemaVersion":1,"ordinal":%d,"items":[' % r.ordinal)


def deal(segments, spans):
    cut = lambda t: regex.findall(r"\X", t)
    out, at, offset = [[] for _ in segments], 0, 0
    for i, text in enumerate(segments):
        left = len(cut(text))
        while left > 0:
            if at >= len(spans):
                return None
            own = cut(spans[at][0])
            take = min(len(own) - offset, left)
            if spans[at][1] and (offset or take != len(own)):
                return None
            out[i].append(("".join(own[offset : offset + take]), spans[at][1]))
            left, offset = left - take, offset + take
            if offset == len(own):
                at, offset = at + 1, 0
    return out if at == len(spans) and not offset else None


def test_ruby_equals_the_sequential_deal(spark):
    r = random.Random(9)
    letters = ["a", "歌", "が", "👩‍🎤", "é", "é"]
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = []
    for i in range(400):
        segments = [text(r.randrange(0, 4)) for _ in range(r.randrange(0, 4))]
        n = sum(len(regex.findall(r"\X", s)) for s in segments) + r.choice([0, 0, 0, 0, -1, 1])
        spans = []
        while n > 0:
            k = min(n, r.randrange(0, 3))
            spans.append((text(k), r.choice(["", "", "よみ"])))
            n -= k
        rows.append((i, segments, spans))
    rows += [(1000, None, None), (1001, ["ab", "c"], [("abc", "")]), (1002, ["ab", "c"], [("abc", "x")]), (1003, ["ab"], [("a", "x")]), (1004, ["ab"], [("abc", "")]), (1005, ["a", "", "b"], [("a", "x"), ("", "y"), ("b", "")])]
    df = spark.createDataFrame(rows, "k long, segments array<string>, spans array<struct<text:string,reading:string>>")
    got = {x.k: x for x in ruby.partitioned(df, "segments", "spans").collect()}
    made = 0
    for k, segments, spans in rows:
        wanted = deal(segments or [], spans or [])
        parts = got[k].parts
        assert (parts is None) == (wanted is None) == (got[k].refusal is not None)
        if wanted is not None:
            made += 1
            assert [[tuple(p) for p in part] for part in parts] == wanted
    assert made > 100 and got[1002].refusal == "crosses_segment" and got[1003].refusal == "ended_early" and got[1004].refusal == "continues_after"


def test_tables_of_all_items_are_not_sent_through_the_driver(spark):
    items = spark.range(50).selectExpr("id AS k", "concat('{', id, '}') AS body", "1L AS raw")
    found, _ = shards.sealed(items, "k", "body", "raw", 60, 300)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and found.agg({"n_items": "sum"}).first()[0] == 50
