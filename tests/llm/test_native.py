import hashlib
import re

import pytest
from pyspark.sql import functions as F

from polyglint.llm import decontam, fracsketch

from .cases import documents, prose, texts


def ascii_lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_edited_texts_and_likeness(spark):
    docs = documents(spark, extra=True)
    got = {r.doc_id: r for r in fracsketch.fingerprints(docs, scale=1).collect()}
    all_ = [t or "" for t in texts()]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    for i, t in enumerate(all_):
        after = all_[(i + 1) % len(all_)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = shingles(t), shingles(edited), shingles(after)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b))
        assert got[i].near_next == pytest.approx(len(a & c) / len(a | c))
    assert got[6].fingerprint == got[7].fingerprint == got[8].fingerprint and got[6].near_next == 1.0
    assert got[10].fingerprint != got[6].fingerprint  # upper() changes letters beyond A-Z


def test_sketches_keep_a_fixed_fraction_and_merge(spark):
    a, b = prose(50, 6000), prose(51, 3000)
    # The shingles of both texts and those of the joint alone make those of the whole.
    w = a.split()[-4:] + b.split()[:4]
    df = spark.createDataFrame([(a, b, " ".join(w), a + " " + b)], "a string, b string, c string, ab string")
    for name in ("a", "b", "c", "ab"):
        df = fracsketch.with_sketch(df, name, f"s_{name}")
    r = df.select("s_a", "s_ab", fracsketch.merged(fracsketch.merged(F.col("s_a"), F.col("s_b")), F.col("s_c")).alias("m"), fracsketch.containment(F.col("s_b"), F.col("s_ab")).alias("in_whole")).first()
    assert 0.1 < len(r.s_a) / 6000 < 0.15 and r.s_a == sorted(r.s_a)
    low = fracsketch.limit_of(8)
    assert [x for x in r.m if x <= low] == r.s_ab and r.in_whole > 0.99


def test_likeness_of_short_texts_is_exact_and_of_longer_ones_close(spark):
    """Texts of up to 16 shingles have whole sketches; those of up to some 128 the 16 smallest hashes."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    pairs = []
    for i in range(60):
        w = prose(700 + i, 6 + i).split()
        pairs.append((i, " ".join(w), " ".join(w[: len(w) - 1 - i // 8] + ["other"])))
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    for name in ("a", "b"):
        df = fracsketch.with_sketch(df, name, f"s_{name}")
    got = {r.i: r for r in df.select("i", "s_a", "s_b", fracsketch.likeness(F.col("s_a"), F.col("s_b")).alias("near"), fracsketch.containment(F.col("s_b"), F.col("s_a")).alias("held")).collect()}
    for i, a, b in pairs:
        a, b = shingles(a), shingles(b)
        if max(len(a), len(b)) < 16:
            assert got[i].near == pytest.approx(len(a & b) / len(a | b)) and got[i].held == pytest.approx(len(a & b) / len(b))
        else:
            assert abs(got[i].near - len(a & b) / len(a | b)) < 0.5 and len(got[i].s_a) >= 16
    late = [abs(got[i].near - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))) for i, a, b in pairs[20:]]
    assert sum(late) / len(late) < 0.12 and all(r.near > 0 for r in got.values() if r.i >= 8)


def test_neighbours_over_many_ranges_ties_and_wrap(spark):
    ids = [-5, -5, 0, 3, 4, 1000, 100000, 100001, 5_000_000]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = fracsketch.followed(docs, ["doc_id", "text"], rows_each=1).collect()
    assert sorted((r.doc_id, r.next_doc_id) for r in got) == sorted(zip(ids, ids[1:] + ids[:1]))


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0, 5], [2**62, *range(3000)], [0, *(10**15 + 7 * i for i in range(3000))], [7] * 500 + list(range(400)), [3], list(range(50))])
def test_neighbours_of_unevenly_spread_ids(spark, ids):
    docs = documents(spark, [(x, f"t{k:05d}", "en", "s", 0) for k, x in enumerate(ids)]).select("doc_id", "text")
    got = [tuple(r) for r in fracsketch.followed(docs, ["doc_id", "text"], rows_each=30).select("doc_id", "text", "next_doc_id", "next_text").collect()]
    rows = sorted((x, f"t{k:05d}") for k, x in enumerate(ids))
    assert sorted(got) == [(*x, *y) for x, y in zip(rows, rows[1:] + rows[:1])]


def test_one_far_id_does_not_fill_one_range(spark):
    docs = documents(spark, [(x, "t", "en", "s", 0) for x in [2**62, *range(20_000)]]).select("doc_id", "text")
    plan = fracsketch.followed(docs, ["text"], rows_each=500)
    sizes = [r["n"] for r in plan.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_001 and max(sizes) < 15_000


def test_fingerprints_of_odd_tables_and_no_python(spark):
    assert fracsketch.fingerprints(documents(spark, [])).count() == 0
    docs = documents(spark, [(7, "only one", "", "", 0), (None, "left out", "", "", 0)])
    r = fracsketch.fingerprints(docs).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].n_chars == 8
    assert not re.search("Python|Pandas|Arrow", plan(fracsketch.fingerprints(documents(spark))))


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(10, prose(11, 25)), (2, "Short item, Four words"), (3, None), (4, "?!"), (5, prose(12, 10)), (6, prose(12, 10) + " tail")]


def brute(rows: list, items: list, size: int) -> dict:
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    known: dict = {}
    for i, t in items:
        w = find(t)
        n = min(len(w), size)
        for k in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for i, t in rows:
        w, hit, met = find(t), set(), set()
        for n in {len(x) for x in known}:
            for k in range(len(w) - n + 1):
                if x := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    met |= x
        out[i] = (len(w), sorted(hit), sorted(met))
    return out


@pytest.mark.parametrize("sent", [10**6, 0])
def test_hits_match_brute_force(spark, sent):
    planted = [prose(60, 30) + " " + ITEMS[0][1].upper() + "... " + prose(61, 10), "x SHORT--item four\nwords y", prose(12, 10), prose(12, 9), ITEMS[0][1][:60]]
    rows = list(enumerate(texts() + planted))
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in rows], extra=True)
    got = {r.doc_id: (r.n_words, r.covered, r["items"]) for r in decontam.hits(docs, benchmark(spark, ITEMS), 10, sent).collect()}
    expected = brute(rows, ITEMS, 10)
    assert got == expected and sum(bool(x[1]) for x in expected.values()) >= 4
    left = decontam.decontaminate(docs, benchmark(spark, ITEMS), 10, "documents", sent)
    assert sorted(r.doc_id for r in left.collect()) == [i for i, x in expected.items() if not x[1]]
    assert left.columns == docs.columns


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before, {item.upper()}! After"), (2, item), (3, "clean  text\n"), (4, None), (5, f"({item}) ({item})")]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, benchmark(spark, [(1, item)]), remove="spans").collect()}
    assert got[1] == "Before, ! After" and got[2] == "" and got[3] == "clean  text\n" and got[4] is None
    assert got[5].replace(" ", "") in ("()()", "()", "()(" + ")")
    assert all("six" not in (t or "") for t in got.values())


def test_decontamination_of_odd_tables_and_no_python(spark):
    docs, items = documents(spark), benchmark(spark, ITEMS)
    assert decontam.hits(documents(spark, []), items).count() == 0
    none = decontam.hits(docs, benchmark(spark, [])).collect()
    assert len(none) == len(texts()) and not any(r.covered for r in none)
    twice = documents(spark, [(1, ITEMS[1][1], "", "", 0)] * 2 + [(None, ITEMS[1][1], "", "", 0)])
    assert [len(r.covered) for r in decontam.hits(twice, items).collect()] == [4, 4, 4]
    assert not re.search("Python|Pandas|Arrow", plan(decontam.hits(docs, items)) + plan(decontam.windows(items, 10)))


def test_decontamination_with_text_ids(spark):
    docs = spark.createDataFrame([("d1", "one two three"), ("d2", "clean words here"), ("d3", None)], "doc_id string, text string")
    bench = spark.createDataFrame([("x-1", "two three"), ("x-10", "three"), ("y", None)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.covered, r["items"]) for r in decontam.hits(docs, bench).collect()}
    assert got == {"d1": (3, [1, 2], ["x-1", "x-10"]), "d2": (3, [], []), "d3": (0, [], [])}
