import random
import time

import numpy as np
import pytest
import xxhash

from polyglint.llm import simhash
from polyglint.llm.components import components

from .cases import documents, prose


def brute(texts: dict, width: int, bits: int) -> dict:
    found = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        found[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (found[a] ^ found[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (found[i], find(i)) for i in texts}


def test_matches_brute_force_on_all_cases(spark):
    docs = documents(spark, extra=True)
    expected = brute({r.doc_id: r.text for r in docs.collect()}, 3, 2)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in rows} == expected


@pytest.mark.parametrize("cover", [simhash.narrow_cover(2), simhash.narrow_cover(1), simhash.wide_cover(8), simhash.wide_cover(5)])
def test_no_pair_within_the_threshold_is_lost(spark, cover):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    found = list(base)
    for x in base:
        for _ in range(5):
            flips = r.choice(64, r.integers(0, cover.threshold + 3), replace=False)
            found.append(np.uint64(int(x) ^ sum(1 << int(b) for b in flips)))
    found = np.unique(np.array(found, dtype=np.uint64))
    members = spark.createDataFrame([(i, int(x.view(np.int64))) for i, x in enumerate(found)], "id long, fingerprint long")
    label = {x.id: x.label for x in components(simhash.links(members, cover)).collect()}
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(found)):
        for b in np.flatnonzero(np.bitwise_count(found[a] ^ found[a + 1 :]) <= cover.threshold) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    assert [label.get(i, i) for i in range(len(found))] == [find(i) for i in range(len(found))]


def test_anchors_hold_the_home_of_every_near_word():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    y = x ^ np.uint64(1 << 5) ^ np.uint64(1 << 40)
    parts = simhash.narrow_cover(2).blocks[0]
    row, key, beyond = simhash.anchors(np.concatenate([x, y]), parts, 2)
    at = {}
    for a, k, b in zip(row.tolist(), key.tolist(), beyond.tolist()):
        at.setdefault(a, {})[k] = b
    for i in range(300):
        homes = [(h, o) for h, o in ((i, i + 300), (i + 300, i)) if any(k in at[o] for k, b in at[h].items() if b == 0)]
        assert homes


def test_large_group_gives_few_links(spark):
    rows = [(i, int(i)) for i in [0, *(1 << b for b in range(60)), *((1 << b) | 1 for b in range(1, 60))]]
    members = spark.createDataFrame(rows, "id long, fingerprint long")
    found = simhash.links(members, simhash.narrow_cover(2))
    assert found.count() < 60 * len(rows)
    assert {r.label for r in components(found).collect()} == {0}


def test_similarity_is_checked(spark):
    a = prose(9, 120)
    near, far = a.replace(a.split()[60], "changed", 1), " ".join(a.split()[:60] + prose(10, 60).split())
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate([a, near, far, a])])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, simhash.wide_cover(8), similarity=0.8).collect()}
    assert got[3] == 0 and got[2] == 2 and got[1] in (0, 1)
    pairs = spark.createDataFrame([(0, 1, 3), (0, 2, 3)], "a long, b long, bits int")
    assert [tuple(r) for r in simhash.similar(pairs, docs.select("doc_id", "text"), 5, 0.8).collect()] == [(0, 1)]


def test_empty_null_and_repeated(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    docs = documents(spark, [(None, "a b c", "", "", 0), (4, "a b c", "", "", 0), (4, "a b c", "", "", 0), (2, "a b c", "", "", 0)])
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(2, 2), (4, 2), (4, 2)]


def test_components_of_a_chain_a_star_and_loops(spark):
    ids = list(range(1000, 3000))
    random.Random(1).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(500, i) for i in range(450, 500)]
    edges += [(5, 5), (8, 7), (None, 3), (4, None), (8, 7)]
    at = time.monotonic()
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert time.monotonic() - at < 60
    assert got == {**{i: 1000 for i in ids}, **{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, **{i: 450 for i in range(450, 501)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
