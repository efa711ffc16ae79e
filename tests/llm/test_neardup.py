import os
import random
from collections import Counter
from itertools import combinations

import pytest

from polyglint.llm import neardup, simhash
from polyglint.llm.common import row_digest

from .cases import documents


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a: str, b: str) -> float:
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pairs_of(n: int):
    """Texts of 300 words and copies with 5 or 6 words changed, far from each other: J of 0.8 to 0.85."""
    r = random.Random(4)
    out = []
    for i in range(n):
        words = [f"w{r.randrange(50_000)}" for _ in range(300)]
        near = list(words)
        for k in range(5 + i % 2):
            near[20 + 45 * k] = f"other{k}"
        out.append((" ".join(words), " ".join(near)))
    return out


def test_near_copies_just_above_the_similarity_go(spark):
    made = pairs_of(120)
    assert all(0.8 <= likeness(a, b) < 0.86 for a, b in made)
    docs = documents(spark, [(2 * i + k, t, "en", "s", 0) for i, p in enumerate(made) for k, t in enumerate(p)])
    got = {r.doc_id: r.component_id for r in neardup.near_copies(docs).collect()}
    lost = [i for i in range(120) if got[2 * i + 1] != 2 * i]
    assert len(lost) <= 2  # of 120; one fingerprint within 8 bits lost about half
    assert all(got[2 * i] == 2 * i for i in range(120))


def member(i: int, bits: int, check: int = 0):
    return (i, 0, bits, check, i)


def test_candidates_within_the_guarantee_meet(spark):
    r = random.Random(6)
    rows = []
    for i in range(150):
        x, check = r.getrandbits(63), r.getrandbits(63)
        rows += [member(2 * i, x, check), member(2 * i + 1, x ^ sum(1 << b for b in r.sample(range(63), r.randrange(1, 8))), check)]
    found = neardup.candidates(spark.createDataFrame(rows, neardup.MEMBER), neardup.four_blocks()).collect()
    assert {(2 * i, 2 * i + 1) for i in range(150)} <= {(x.a, x.b) for x in found}


def test_a_failed_link_does_not_hide_another(spark):
    """Nearest candidates first, A-C would join A and B by C; it fails, and A-B has to be tried."""
    base = [f"w{i}" for i in range(100)]
    texts = {1: base, 2: base[:97] + ["x", "y", "z"], 3: base[:97] + ["x", "y", "q"] + [f"more{i}" for i in range(22)]}
    texts = {i: " ".join(t) for i, t in texts.items()}
    assert likeness(texts[1], texts[2]) >= 0.8 > max(likeness(texts[1], texts[3]), 0)
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    members = spark.createDataFrame([(i, i, *[b] * neardup.SEEDS) for i, b in ((1, 0), (2, 0b1111), (3, 0b11))], f"id long, row long, {', '.join(f'{n} long' for n in neardup.SEEN)}")
    from pyspark.sql import functions as F

    label = neardup.linked(members, docs.select(F.col("doc_id").alias("row"), "text"), 5, 0.8, neardup.four_blocks())
    assert {r.id: r.label for r in label.collect()} == {1: 1, 2: 1}


def test_candidates_are_limited_and_say_so(spark):
    rows = [member(i, i) for i in range(40)]
    found = neardup.candidates(spark.createDataFrame(rows, neardup.MEMBER), neardup.four_blocks(), 2).collect()
    assert any(x.more for x in found) and all(x.a != x.b for x in found if not x.more)
    pairs, short = {(x.a, x.b) for x in found if not x.more}, {x.a for x in found if x.more}
    assert all({a, b} <= short for a in range(40) for b in range(a + 1, 40) if (a, b) not in pairs)
    whole = neardup.candidates(spark.createDataFrame(rows, neardup.MEMBER), neardup.four_blocks(), 1000).collect()
    assert not any(x.more for x in whole) and len(whole) == 40 * 39 // 2
    assert isinstance(simhash.wide_cover(8), simhash.Cover)


def test_crowded_anchors_are_dealt_in_parts_and_lose_nothing(spark):
    """All 40 fingerprints lie within six bits, so they crowd the same anchors."""
    rows = [member(i, i) for i in range(40)]
    of = spark.createDataFrame(rows, neardup.MEMBER)
    whole, dealt = ({(x.a, x.b) for x in neardup.candidates(of, neardup.two_blocks(), 1000, home_rows=n).collect()} for n in (1000, 7))
    assert whole == dealt and len(whole) == 40 * 39 // 2


def test_rows_are_told_apart_by_id_and_text(spark):
    rows = [(None, "1:5:abc", "", "", 0), (5, "abc", "", "", 0), (None, "abc", "", "", 0), (5, None, "", "", 0), (5, "", "", "", 0)]
    got = [r[0] for r in documents(spark, rows).select(row_digest()).collect()]
    assert len(set(got)) == 4 and got.count(documents(spark, rows[4:]).select(row_digest()).first()[0]) == 2


def test_hashes_of_64_bits_that_meet_unite_nothing(spark):
    """Members with equal fingerprints are different texts until their shingles are compared."""
    docs = documents(spark, [(1, "a b c d e f", "en", "s", 0), (2, "g h i j k l", "en", "s", 0), (3, "a b c d e f", "en", "t", 0)])
    members = spark.createDataFrame([(i, i, *[9] * neardup.SEEDS) for i in (1, 2, 3)], f"id long, row long, {', '.join(f'{n} long' for n in neardup.SEEN)}")
    label = neardup.linked(members, docs.selectExpr("doc_id row", "text"), 5, 0.8, neardup.two_blocks())
    assert {r.id: r.label for r in label.collect()} == {1: 1, 3: 1}


def test_recall_against_all_pairs_of_the_documents(spark):
    """Every pair of different texts at 0.8 or more, found through their common shingles, is looked for."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are absent")
    docs = spark.read.parquet(path).select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    of, where = {i: shingles(t) for i, t in texts.items()}, {}
    for i, found in of.items():
        for x in found:
            where.setdefault(x, []).append(i)
    shared = Counter(p for ids in where.values() for p in combinations(sorted(ids), 2))
    close = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(of[a]) + len(of[b]) - n)}
    group = {r.doc_id: r.component_id for r in neardup.near_copies(docs).collect()}
    assert len(close) > 50 and sum(group[a] == group[b] for a, b in close) >= 0.98 * len(close)
    united = [(a, b) for b, a in group.items() if a != b]
    assert all(any(b in p and group[p[0]] == group[p[1]] for p in close) for _, b in united)


def crowd(n: int):
    """Texts of 400 words with seven of their own each: most pairs are near, but not near enough; every third is a copy but for a word."""
    r = random.Random(8)
    out = []
    for i in range(n):
        words = list(out[-1]) if i % 3 == 2 else [f"w{k}" for k in range(400)]
        for k in r.sample(range(400), 1 if i % 3 == 2 else 7):
            words[k] = f"own{i}x{k}"
        out.append(words)
    return [" ".join(x) for x in out]


def united(pairs, n: int) -> dict:
    least = {i: i for i in range(n)}
    for _ in range(n):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_pairs_of_a_crowd_that_fail_are_never_rows(spark, monkeypatch):
    """As many rows are written as there are texts and tiles, not as pairs."""
    texts, tables, write = crowd(120), [], neardup.written

    def counted(df, name):
        tables.append((name, write(df, name)))
        return tables[-1][1]

    monkeypatch.setattr(neardup, "written", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_copies(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    close = [p for p in combinations(range(120), 2) if likeness(texts[p[0]], texts[p[1]]) >= 0.8]
    assert got == united(close, 120) and len(set(got.values())) == 80
    sizes = {name: max(t.count() for n, t in tables if n == name) for name, _ in tables}
    assert max(sizes.values()) <= 30 * 120, sizes


def test_tiles_of_any_size_find_the_same_groups(spark):
    texts = crowd(60)
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).select("doc_id", "text")
    live = neardup.seen(docs, 5).selectExpr("0L as `group`", "doc_id as id", "doc_id as label", *neardup.SEEN).join(simhash.shingle_sets(docs, 5), "id").cache()
    close = [p for p in combinations(range(60), 2) if likeness(texts[p[0]], texts[p[1]]) >= 0.8]
    for sizes in ((4000, 1_000_000, 60), (7, 1_000_000, 60), (4000, 500, 60), (4000, 1_000_000, 4)):
        found = [(r.a, r.b) for r in neardup.links_inside(live, 0.8, *sizes).collect()]
        assert set(found) <= set(close) and united(found, 60) == united(close, 60)
