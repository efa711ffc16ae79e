import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyglint.functions import canonical, scalars, unicode
from polyglint.operators import align, jobs, merge, story
from polyglint.streaming import feeds

ENTRY = "category string, field string, jp_key string, cn_text string, source string, ids array<string>"


def test_official_texts_by_precedence(spark):
    """The seven cases of the merge: pinned rows keep their text, all else gives way to a filled text."""
    rows = [("pinned", "a", "pinned", ["old"]), ("human", "b", "human", ["old"]), ("cn", "c", "cn", []), ("llm", "d", "llm", []), ("unknown", "", "unknown", []), ("blank", "e", "llm", [])]
    entries = spark.createDataFrame([("cards", "prefix", *r[:3], r[3]) for r in rows], ENTRY)
    new = [("pinned", "A", ["new"]), ("human", "B", ["new"]), ("cn", "C", None), ("llm", "D", None), ("unknown", "U", None), ("blank", "", None), ("new", "N", ["7"])]
    official = spark.createDataFrame([("cards", "prefix", *r) for r in new], "category string, field string, jp_key string, cn_text string, ids array<string>")
    got = {r.jp_key: (r.cn_text, r.source, r.ids, r.changed) for r in merge.official_merge(entries, official).collect()}
    assert got == {
        "pinned": ("a", "pinned", ["old", "new"], True), "human": ("B", "cn", ["old", "new"], True), "cn": ("C", "cn", [], True), "llm": ("D", "cn", [], True),
        "unknown": ("U", "cn", [], True), "blank": ("e", "llm", [], False), "new": ("N", "cn", ["7"], True),
    }
    assert sum(x[3] for x in got.values()) == 6


@given(st.lists(st.sampled_from("abc"), max_size=4), st.lists(st.sampled_from("abc"), max_size=7))
@settings(max_examples=200, deadline=None)
def test_subsequences_match_brute_force(part, whole):
    ways = [list(c) for c in itertools.combinations(range(len(whole)), len(part)) if [whole[i] for i in c] == part]
    expected = ("missing", []) if not ways else ("unique", ways[0]) if len(ways) == 1 else ("ambiguous", [])
    assert align.subsequence(part, whole) == expected


def best(left, right):
    """Pairs that are on every best alignment's table of candidates, by trying all alignments."""
    n, m, top, found = len(left), len(right), -1.0, []
    for k in range(min(n, m) + 1):
        for a in itertools.combinations(range(n), k):
            for b in itertools.combinations(range(m), k):
                s = sum(align.points(left[i], right[j]) for i, j in zip(a, b))
                if s > top:
                    top, found = s, []
                if s == top:
                    found.append(set(zip(a, b)))
    pairs = set().union(*found)
    return sorted(p for p in pairs if sum(q[0] == p[0] for q in pairs) == 1 and sum(q[1] == p[1] for q in pairs) == 1)


ROWS = st.lists(st.tuples(st.sampled_from(["talk", "effect"]), st.sampled_from(["", "x"]), st.sampled_from("pq")), max_size=4)


@given(ROWS, ROWS)
@settings(max_examples=60, deadline=None)
def test_alignment_matches_brute_force(left, right):
    got = align.alignment(left, right) if left and right else []
    assert got == (best(left, right) if left and right else [])


def test_unicode_identities():
    assert unicode.identity_text("  ＡＢ　ｃ ") == "AB c" and unicode.identity_text("-") == ""
    assert unicode.work_text("Ｈｅｌｌｏ, World?") == "helloworld?"
    assert unicode.trailing_parenthesis("a (b (c))") == ["a", "b (c)"] and unicode.trailing_parenthesis("(a)") == ["(a)", ""]
    assert unicode.top_level_parts("a/b (c/d)、e") == ["a", "b (c/d)", "e"]
    assert unicode.title_matches("Song (Long Title)", "song") and not unicode.title_matches("Song", "Other")
    assert unicode.unique_json('{"a": 1}') and not unicode.unique_json('{"a": {"b": 1, "b": 2}}') and not unicode.unique_json("{")
    assert canonical.canonical_json('{"b": 1, "a": "<"}') == '{"a":"\\u003c","b":1}' and canonical.canonical_json("x") is None


def test_scalars(spark):
    df = spark.createDataFrame([("  a ", "-", "Speaker_2", "Some Error!!", '<t id="1">x&lt;y</t><t id="9">z</t>')], "a string, b string, s string, e string, r string")
    got = df.select(
        scalars.credits(F.col("a"), F.col("b"), F.lit("c")).alias("credits"), scalars.speaker_of(F.col("s")).alias("speaker"), scalars.error_code(F.col("e")).alias("code"),
        scalars.batch_reply(F.col("r"), F.lit(3)).alias("reply"), scalars.vote(F.lit("x"), F.lit(None).cast("string"), F.lit("x")).alias("same"), scalars.vote(F.lit("x"), F.lit("y")).alias("differ"),
    ).first()
    assert (got.credits, got.speaker, got.code) == ("a | c", "Speaker", "some_error")
    assert got.reply == ["", "x<y", ""] and (got.same, got.differ) == ("x", "unknown")


def test_attempts_are_admitted_by_windows(spark):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 1, 2, 9, 10, 11, 25])], "k string, i long, t long")
    got = {r.i: r.admitted for r in jobs.admitted(df, "k", "i", "t", 10, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_scenarios_are_flattened(spark):
    doc = '{"ScenarioId":"s","Snippets":[{"Action":1,"ReferenceIndex":0},{"Action":6,"ReferenceIndex":0},{"Action":1,"ReferenceIndex":5},{"Action":1,"ReferenceIndex":1}],"TalkData":[{"WindowDisplayName":"A_1","Body":"hi","WhenFinishCloseWindow":1},{"WindowDisplayName":"B","Body":"yo","WhenFinishCloseWindow":1}],"SpecialEffectData":[{"EffectType":8,"StringVal":"Town"}]}'
    rows = story.talks(story.decoded(spark.createDataFrame([(1, doc)], "id int, json string")), ["id"]).orderBy("ord").collect()
    assert [(r.kind, r.speaker, r.body) for r in rows] == [("talk", "A", "hi"), ("separator", "", ""), ("effect", "", "Town"), ("talk", "B", "yo")]


def test_streams_of_files(spark, tmp_path):
    source = spark.createDataFrame([(1, 0), (1, 100), (1, 5000), (2, 50), (2, 50)], "user long, s long").select("user", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    path = str(tmp_path / "in")
    source.write.parquet(path)
    stream = spark.readStream.schema(source.schema).parquet(path)
    q = feeds.bursts(stream, "user", "ts", "10 minutes", "0 seconds").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.user, r.n) for r in spark.table("bursts").collect()) == [(1, 1), (1, 2), (2, 2)]
    log = str(tmp_path / "log")
    for _ in range(2):  # a restart appends nothing again
        feeds.appended_log(feeds.deduplicated(stream, ["user", "ts"], "ts", "1 hour"), log, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert spark.read.parquet(log).count() == 4


@pytest.mark.parametrize("at, expected", [(1, 30), (2, 60), (20, 3600)])
def test_backoff(spark, at, expected):
    assert spark.range(1).select(scalars.backoff(F.lit(at), 30, 3600).alias("d")).first().d == expected


def test_preview_names_every_row_of_both_sides(spark, monkeypatch):
    side = lambda k, s, texts: [(k, s, i, "talk", "m", t) for i, t in enumerate(texts)]
    rows = side(1, "left", ["a", "b", "c"]) + side(1, "right", ["a", "x", "c", "d"]) + side(2, "left", ["a"]) + side(3, "right", ["q"])
    df = spark.createDataFrame(rows, "k long, side string, position long, kind string, speaker string, text string")
    pairs = align.aligned(df, "k")
    found = {(r.k, r.left, r.right): r.outcome for r in align.preview(df, pairs, "k").collect()}
    matched = {(r.k, r.left): r.right for r in pairs.where("status = 'matched'").collect()}
    text = {(k, s, i): t for k, s, i, _, _, t in rows}
    want = {}
    for k, s, i, _, _, t in rows:
        if s == "left":
            j = matched.get((k, i))
            want[k, i, j] = "missing" if j is None else "matched" if text[k, "right", j] == t else "conflict"
        elif i not in {j for (x, _), j in matched.items() if x == k}:
            want[k, None, i] = "unmatched"
    assert found == want and set(found.values()) >= {"matched", "missing", "unmatched"}
    large = spark.createDataFrame([(1, None, None, "too_large")], "k long, left long, right long, status string")
    judged = align.preview(df.where("k = 1"), large, "k")
    found = judged.collect()
    assert {r.outcome for r in found} == {"too_large"} and len(found) == sum(k == 1 for k, *_ in rows)
    assert [tuple(r) for r in align.preview_counts(judged, "k").collect()] == [(1, 0, 0, 0, 0, 7)]  # three left rows and four right ones


def test_timestamps_of_years_beyond_four_digits_have_no_plus(spark):
    days = [0, -719528, -700000, 2932896, 2932897, 9000000, 90000000]
    expected = ["1970-01-01", "0000-01-01", "0053-06-19", "9999-12-31", "10000-01-01", "26611-03-02", "248381-08-19"]
    got = spark.createDataFrame([(i, d * 86400) for i, d in enumerate(days)], "i int, s long").select("i", scalars.rfc3339(F.col("s")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [f"{d}T00:00:00Z" for d in expected]
    texts = spark.createDataFrame([("+10000-01-01T00:00:00Z",), ("9999-12-31T00:00:00Z",)], "t string").select(F.unix_seconds(scalars.canonical_timestamp(F.col("t"))).alias("s")).collect()
    assert [r.s for r in texts] == [None, 2932896 * 86400]


def test_preview_aligns_every_group_once(spark):
    """Four joins read the pairs; none of them aligns again."""
    rows = spark.createDataFrame([("a", s, i, "talk", "x", f"t{i}") for s in ("left", "right") for i in range(3)], "k string, side string, position bigint, kind string, speaker string, text string")
    seen = spark.sparkContext.accumulator(0)

    def run(group):
        seen.add(1)
        return group.head(1)[["k"]].assign(left=0, right=0, status="matched")

    pairs = rows.groupBy("k").applyInPandas(run, "k string, left bigint, right bigint, status string")
    got = {(r.left, r.right): r.outcome for r in align.preview(rows, pairs, "k").collect()}
    assert got == {(0, 0): "matched", (1, None): "missing", (2, None): "missing", (None, 1): "unmatched", (None, 2): "unmatched"}
    assert seen.value == 1
