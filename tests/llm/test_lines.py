import hashlib
from collections import Counter

import numpy as np
import pytest

from polyglint.llm import linededup

from .cases import documents, texts

SPACE = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows: list, documents: int, least: int, keep_first: bool) -> list:
    count, first = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                count[k] += 1
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if count[key(x)] < documents or keep_first and first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


@pytest.mark.parametrize("wanted", [2, 3])
@pytest.mark.parametrize("least", [1, 6])
@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("sent", [10**9, 0])
@pytest.mark.parametrize("bits", [12, 22])
def test_matches_brute_force(spark, wanted, least, keep_first, sent, bits):
    rows = list(enumerate(texts()))
    rows += [(100 + i, f"Shared line\n own {i}\n  SHARED Line \n\nÉclair\n") for i in range(6)]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in rows], extra=True)
    got = linededup.line_dedup(docs, wanted, least, keep_first, bits, sent)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(rows, wanted, least, keep_first)
    assert set(docs.columns) <= set(got.columns)


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert linededup.line_dedup(documents(spark, [])).count() == 0
    docs = documents(spark, [(None, "a\nb", "", "", 0), (1, "a", "", "", 0), (1, "a", "", "", 0)])
    got = linededup.line_dedup(docs, documents=3).collect()
    assert sorted((r.doc_id is None, r.n_dropped, r.text) for r in got) == [(False, 1, ""), (False, 1, ""), (True, 1, "b")]


def test_merged_filters_hold_all_that_was_seen_twice(spark):
    docs = documents(spark, [(i, f"line {i % 50}\nalone {i}", "", "", 0) for i in range(100)]).repartition(7)
    field = linededup.twice_seen(docs, 1, 16)
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(f"line {i}".encode()) for i in range(50)], dtype=np.uint64)
    assert linededup.Twice.has(field, linededup._slots(hashes, 16)).all()
    alone = np.array([xxhash.xxh64_intdigest(f"alone {i}".encode()) for i in range(100)], dtype=np.uint64)
    assert linededup.Twice.has(field, linededup._slots(alone, 16)).mean() < 0.2


def test_kept_text_of_the_query(spark):
    got = linededup.line_dedup(documents(spark, [(1, None, "", "", 0)])).collect()[0]
    assert (got.n_lines, got.n_dropped, hashlib.sha256(got.text.encode()).hexdigest()) == (1, 0, hashlib.sha256(b"").hexdigest())


def test_filters_grow_with_the_lines(spark):
    docs = documents(spark, [(1, "a\nb\n", "", "", 0), (2, None, "", "", 0), (3, "\n" * 4_000_000, "", "", 0)])
    assert linededup.fitting_bits(docs.where("doc_id < 3")) == 23 and linededup.fitting_bits(docs) == 26
    assert linededup.fitting_bits(docs.limit(0)) == 23


def test_what_is_counted_and_sent_does_not_grow_with_the_lines_length(spark):
    long = "word " * 5000
    docs = documents(spark, [(i, f"{long}\nalone {i}", "", "", 0) for i in range(4)])
    twice = spark.sparkContext.broadcast((linededup.twice_seen(docs, 1, 16), 16))
    got = linededup.repeated_keys(docs, twice, documents=10, passage=50).collect()
    assert [(len(r.key), r.n_documents, r.first) for r in got] == [(16, 4, 0)]
