"""Cross-tokenizer alignment, quality rules and the filter audit against their definitions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglint.llm import crosstok, interaction, qualityrules
from polyglint.llm.bpe import byte_letters
from polyglint.llm.common import held_out
from polyglint.llm.queries import tokenizer_path
from polyglint.session import table

from .cases import documents, prose, texts

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts(n):
    r = random.Random(5)
    pick = lambda: r.choice([r.randrange(32, 127), r.randrange(32, 127), 32, 32, 10, 97, r.randrange(0x20, 0x3000), r.randrange(0x1F300, 0x1F6FF)])
    return ["".join(chr(pick()) for _ in range(r.randrange(40))) for _ in range(n)]


def brute_alignment(all_texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: i for i, c in byte_letters().items()}
    bytes_a = lambda i: bytes(back[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>"
    bytes_b = lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()
    found, docs_of = [], Counter()
    for t in all_texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, x)) != whole or b"".join(map(bytes_b, y)) != whole:
            found.append(([], [], []))
            continue
        groups, i, j = [], 0, 0
        while i < len(x):
            ga, gb, end_a, end_b = [x[i]], [y[j]], len(bytes_a(x[i])), len(bytes_b(y[j]))
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    ga.append(x[i])
                    end_a += len(bytes_a(x[i]))
                    i += 1
                else:
                    gb.append(y[j])
                    end_b += len(bytes_b(y[j]))
                    j += 1
            groups.append((Counter(ga), Counter(gb), ga, gb))
        links = Counter()
        for ca, cb, _, _ in groups:
            for p, n in ca.items():
                for q, m in cb.items():
                    links[p, q] += n * m
        docs_of.update(links.keys())
        found.append((x, y, groups, links))
    best = defaultdict(int)
    for (p, _), n in docs_of.items():
        best[p] = max(best[p], n)
    out = []
    for f in found:
        if not f[0]:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = f
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for _, _, ga, gb in groups)
        out.append((len(x), len(y), len(groups), sum(links.values()), sum(n for k, n in links.items() if docs_of[k] == best[k[0]]), sum(n * docs_of[k] for k, n in links.items()), shown))
    return out


@pytest.mark.parametrize("broadcast", [crosstok.BROADCAST_PAIRS, 40])
def test_alignment_equals_its_definition(spark, broadcast):
    given = [*texts(), *odd_texts(300), "a▁b", " " * 5000 + "x", "<s> </s> <0x41>", "<|endoftext|>", "\x00", "é" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in crosstok.align(docs, A, B, broadcast=broadcast).collect()}
    assert [got[i] for i in range(len(given))] == brute_alignment(given)


def test_alignment_of_repeated_rows_clashing_columns_and_no_rows(spark):
    docs = documents(spark, extra=True).withColumn("pairs", F.lit("clash"))
    rows = crosstok.align(docs.unionByName(docs), A, B).collect()
    once = {r.doc_id: tuple(r) for r in crosstok.align(docs, A, B).collect()}
    assert len(rows) == 2 * len(once)
    assert all(r.count_sum == 2 * once[r.doc_id][6] and r.groups == once[r.doc_id][7] for r in rows)
    assert crosstok.align(docs.limit(0), A, B).collect() == []


def brute_counts(t):
    t = t or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_statistics_equal_their_definition(spark):
    r = random.Random(3)
    given = [*texts(), *odd_texts(50)] + [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(100)] + ["one two three four five six seven eight nine " * 30000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:6] for x in qualityrules.statistics(docs).collect()}
    assert [got[i] for i in range(len(given))] == [brute_counts(t) for t in given]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8])
def test_windows_of_any_width(width):
    r = random.Random(width)
    for _ in range(200):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(25))]
        seen = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
        hit = {k for i in range(len(words) - width + 1) if seen[tuple(words[i : i + width])] > 1 for k in range(i, i + width)}
        assert qualityrules.repeated_words(words, width) == len(hit)


def test_rules_find_planted_conjunctions(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(qualityrules.FEATURES)))
    bad = ((x[:, 1] > 0.7) & (x[:, 4] <= 0.4)) | (x[:, 2] > 0.9)
    rules = qualityrules.learn(x, bad)
    fresh = rng.random((3000, len(qualityrules.FEATURES)))
    truth = ((fresh[:, 1] > 0.7) & (fresh[:, 4] <= 0.4)) | (fresh[:, 2] > 0.9)
    assert (rules.rejected(fresh) == truth).mean() > 0.98
    df = spark.createDataFrame(fresh[:500].tolist(), list(qualityrules.FEATURES))
    rows = df.select(rules.column().alias("kept"), rules.reason().alias("reason")).collect()
    assert [not r.kept for r in rows] == rules.rejected(fresh[:500]).tolist()
    assert all((r.reason is None) == r.kept for r in rows)


def test_no_labels_no_rules_and_cases(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = qualityrules.judged(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.kept != r.base_failed for r in rows)
    assert qualityrules.judged(docs.limit(0), labels).collect() == []
    some = spark.createDataFrame([(1, None, 1), (None, 0, 0), (2, 0, None), (2, 1, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(qualityrules.judged(docs.unionByName(docs), some).collect()) == 2 * len(rows)


def test_held_out_quality(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    labels, docs = table(spark, "/root/testdata/sf0.01", "labels"), table(spark, "/root/testdata/sf0.01", "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    rows = qualityrules.judged(docs, labels.where(~out)).join(labels.where(out).select("doc_id", "quality"), "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad) and sum(r.kept for r in good) >= 0.97 * len(good)


def brute_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None and (first.get(t or "") is None or i < first[t or ""]):
            first[t or ""] = i
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {k for k, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i)) if bad}
        parts[s or ""].append((f, i in good, i in toxic))
    out, shapley = {}, Counter()
    for p, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                here, gone = [d for d in left if x in d[0]], [d for d in docs if x in d[0] and not any(d is y for y in left)]
                left = [d for d in left if x not in d[0]]
                shapley[p, x] += len(here)
                out[p, "".join(order), step] = [len(left), len(here), len(gone), sum(d[0] == {x} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_simulation(spark):
    given = [(i, t, "s1" if i % 3 else None) for i, t in enumerate(texts())] + [(None, "x", ""), (3, "!?", "s2"), (40, prose(8, 300) + " #", "s2"), (41, "A" * 500, "s2"), (41, "A" * 500, "s2"), (42, "A" * 500, "s1")]
    labels = [(i, i % 2, i % 4 == 1) for i in range(0, 44, 1)] + [(None, 1, 1)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string").withColumn("mask", F.lit("clash"))
    df = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interaction.filter_interaction(docs, df).collect()}
    assert got == brute_audit(given, [x for x in labels if x[0] is not None])
    assert interaction.filter_interaction(docs.limit(0), df).collect() == []


def test_polynomial_is_exact():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 4, 5):
        counts = rng.integers(0, 10**12, (1, 1 << k))
        c = interaction.polynomial(counts, k)
        removed = [sum(int(counts[0, m]) for m in range(1 << k) if m & s) for s in range(1 << k)]
        assert interaction.corners(c, k)[0].tolist() == removed
        for i in range(k):
            exact = sum(Fraction(int(counts[0, m]), m.bit_count()) for m in range(1 << k) if m >> i & 1)
            assert interaction.diagonal_integrals(c, k)[0, i] == exact * factorial(k)


def test_audit_sql(spark):
    import duckdb

    from polyglint.llm.queries import op13_filter_audit, oracle_sql

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    wanted = db.execute(oracle_sql()["op13_filter_audit"]).df()
    got = op13_filter_audit(spark, folder).toPandas()
    columns = sorted(wanted.columns)
    assert columns == sorted(got.columns)
    ordered = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert ordered(got) == ordered(wanted)


def test_digest_of_groups_is_of_the_text(spark):
    docs = documents(spark)
    plain = {r.doc_id: r.groups for r in crosstok.align(docs, A, B).collect()}
    for r in crosstok.align(docs, A, B, shown=lambda g: F.when(g == "", g).otherwise(F.sha2(g.cast("binary"), 256))).collect():
        assert r.groups == (hashlib.sha256(plain[r.doc_id].encode()).hexdigest() if plain[r.doc_id] else "")
