import math
import os
import random
from collections import Counter

import pytest
import numpy as np
from pyspark.sql import functions as F

from polyglint.llm import ctw, toxicity

from .cases import documents, prose, texts


def labelled(spark, n: int):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = prose(1000 + i, 40).split()
        toxic = i % 4 == 0
        if toxic:
            for bad in r.sample(["blasted", "rotten", "vile"], 2):
                words.insert(r.randrange(len(words)), bad)
        elif i % 4 == 1:
            words.insert(5, "rotting")
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return documents(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learned_and_judged_on_held_out_rows(spark):
    docs, labels = labelled(spark, 600)
    learns = F.col("doc_id") % 3 != 1
    got = toxicity.toxicity(docs, labels, learns).where("doc_id % 3 = 1").collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert right / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled(spark, 120)
    learns = F.col("doc_id") % 3 != 1
    flipped = labels.withColumn("toxic", F.when(learns, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x, learns).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def flat(examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(examples), np.r_[0, np.cumsum([len(x) for x in examples])]


def test_weights_are_sparse_and_bounded():
    r = np.random.default_rng(1)
    examples = [np.unique(np.append(r.integers(0, 4095, 30), [4095] if i % 2 else [])).astype(np.int32) for i in range(400)]
    sizes = []
    for l1 in (0.0, 0.5, 2.0):
        slots, weights, bias = toxicity.ftrl(*flat(examples), np.array([i % 2 for i in range(400)], float), toxicity.Settings(bits=12, l1=l1, alpha=0.3, epochs=3))
        assert len(slots) <= 1 << 12 and slots[np.argmax(weights)] == 4095 and bias < 0
        sizes.append(len(slots))
    assert sizes[0] > 3500 and sizes[1] < 0.6 * sizes[0] and sizes[2] < 0.1 * sizes[0]


def test_ftrl_is_its_definition_coordinate_by_coordinate():
    r = np.random.default_rng(3)
    examples = [np.unique(r.integers(0, 200, r.integers(0, 25))).astype(np.int32) for _ in range(150)]
    labels = np.array([float(len(x) and x[0] % 3 == 0) for x in examples])
    s = toxicity.Settings(bits=8, l1=0.4, l2=0.7, alpha=0.9, beta=1.3, epochs=2)
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == "bias" else s.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(examples)).tolist():
            known = {i: weight(i) for i in [*examples[k].tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(known.values()))) - labels[k]
            for i, w in known.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * w
                n[i] += g * g
    slots, weights, bias = toxicity.ftrl(*flat(examples), labels, s)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert want and set(slots.tolist()) == set(want) and abs(bias - weight("bias")) < 1e-9
    assert all(abs(w - want[i]) < 1e-9 for i, w in zip(slots.tolist(), weights.tolist()))


def test_features_are_distinct_grams_skip_grams_and_stems():
    ids = toxicity.Words(20)
    one, other = (set(toxicity.features(t, ids).tolist()) for t in ("badness here now", "badly here now"))
    assert len(one) == 3 + (4 + 1) + 2 + 1 + 1 and len(toxicity.features("", ids)) == 0  # words, stems, bigrams, a skip-gram, a trigram
    assert len(one & other) == 2 + 2 + 1  # two words, the stems "bad" and "her", a bigram
    ids.most = 2
    assert set(toxicity.features("badness here now", ids).tolist()) == one


def test_sums_are_those_of_the_features():
    r = np.random.default_rng(2)
    weights = np.where(r.random(1 << 12) < 0.2, r.normal(size=1 << 12), 0.0)
    ids = toxicity.Words(12, weights != 0)
    many = [t or "" for t in texts()] + ["one two", "a b a b a b", ""]
    got = toxicity.sums(many, ids, weights)
    assert np.allclose(got, [weights[toxicity.features(t, ids)].sum() for t in many])
    assert len(toxicity.sums([], ids, weights)) == 0 and toxicity.sums(["", ""], ids, weights).tolist() == [0, 0]


def test_held_out_toxic_texts_of_the_tables_are_caught(spark):
    """The query on the driver's own tables: what counts is predicted, on rows it did not learn from."""
    from polyglint.llm.queries import op5_toxicity

    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no tables")
    labels = spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "toxic")
    n, caught, clean, hit = (
        op5_toxicity(spark, where).where("held_out").join(labels, "doc_id")
        .agg(F.sum("toxic"), F.sum(F.col("toxic") * F.col("predicted")), F.sum(1 - F.col("toxic")), F.sum((1 - F.col("toxic")) * F.col("predicted"))).first()
    )
    assert caught >= 0.75 * n and hit <= 0.01 * clean


def test_toxicity_of_odd_tables(spark):
    docs, labels = labelled(spark, 40)
    assert toxicity.toxicity(documents(spark, []), labels, F.lit(True)).count() == 0
    none = toxicity.toxicity(documents(spark, extra=True), labels.limit(0), F.lit(True)).collect()
    assert len(none) == len(texts()) and {r.score for r in none} == {0.5}
    twice = documents(spark, [(1, "a", "", "", 0), (1, "a", "", "", 0), (None, None, None, None, None)])
    odd = spark.createDataFrame([(1, 0, None), (1, 0, 1), (1, 0, 0), (None, 0, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(twice, odd, F.lit(True)).count() == 3


def tree(train: list[bytes], depth: int):
    """Context-tree weighting written as its definition, node by node."""
    nodes: dict = {}
    for t in train:
        t = b"\0" * depth + t + b"\0"
        for i in range(depth, len(t)):
            for d in range(depth + 1):
                for j in range(8):
                    node = nodes.setdefault((d, t[i - d : i], j, t[i] >> (8 - j)), [0, 0])
                    node[t[i] >> (7 - j) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    children: dict = {}
    for d, c, j, p in nodes:
        if d:
            children.setdefault((d - 1, c[1:], j, p), []).append((d, c, j, p))
    weighted: dict = {}

    def log_w(n):
        if n not in weighted:
            weighted[n] = kt(*nodes[n]) if n[0] == depth else np.logaddexp(kt(*nodes[n]), sum(map(log_w, children[n]))) - math.log(2)
        return weighted[n]

    def p_byte(context, byte, d):
        """Probability of a byte seen after this context of d bytes."""
        out = 1.0
        for j in range(8):
            at, left = 0.0, 1.0
            for k in range(d + 1):
                n = (k, context[len(context) - k :], j, byte >> (8 - j))
                a, b = nodes[n] if n in nodes else (0, 0)
                est = (b + 0.5) / (a + b + 1)
                w = 1.0 if k == d or k == depth else math.exp(kt(a, b) - math.log(2) - log_w(n))
                at, left = at + left * w * est, left * (1 - w)
            out *= at if byte >> (7 - j) & 1 else 1 - at
        return out

    seen: dict = {}
    for d, c, j, p in nodes:
        if j == 7:
            zeros, ones = nodes[d, c, j, p]
            seen.setdefault((d, c), set()).update({p * 2} if zeros else set(), {p * 2 + 1} if ones else set())

    def prob(context, byte, d):
        if d == 0:
            out = 1.0
            for j in range(8):
                a, b = nodes.get((0, b"", j, byte >> (8 - j)), (0, 0))
                w = 1.0 if depth == 0 else 0.0
                est = (b + 0.5) / (a + b + 1)
                out *= est if byte >> (7 - j) & 1 else 1 - est
            return out
        own = seen.get((d, context[len(context) - d :]))
        if own is None:
            return prob(context, byte, d - 1)
        if byte in own:
            return p_byte(context, byte, d)
        rest = 1 - sum(p_byte(context, x, d) for x in own)
        return prob(context, byte, d - 1) * rest / (1 - sum(prob(context, x, d - 1) for x in own))

    return prob


def test_scores_are_those_of_the_definition(spark):
    train = ["abracadabra", "abracadabra banana", "banana band", "çà et là", ""]
    test = ["abra", "band", "zzz", "ça", ""]
    s = ctw.Settings(depth=3)
    docs = documents(spark, [(i, t, "", "", 0) for i, t in enumerate(train + test)], extra=True)
    got = {r.doc_id: r for r in ctw.lm_scores(docs, F.col("doc_id") < len(train), s).collect()}
    prob = tree([t.encode() for t in train], 3)
    for i, t in enumerate(train + test):
        full = b"\0" * 3 + t.encode() + b"\0"
        expected = sum(math.log10(prob(full[k - 3 : k], full[k], 3)) for k in range(3, len(full)))
        assert abs(got[i].score - expected) < 1e-4, t
    context = b"\0\0b"
    assert abs(sum(prob(context, b, 3) for b in range(256)) - 1) < 1e-9


def test_base_scores_match_brute_force(spark):
    docs = documents(spark)
    learns = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in ctw.lm_scores(docs, learns).collect()}
    words = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for i, t in enumerate(texts())}
    count = Counter(w for i, x in words.items() if i % 3 for w in x)
    ends = sum(1 for i in words if i % 3)
    total, kinds = count.total() + ends, len(count) + 1
    for i, x in words.items():
        expected = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in x) + math.log10((ends + 1) / (total + kinds + 1))
        assert abs(got[i].base_score - expected) < 1e-6
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(x) + 1, sum(count[w] > 0 for w in x) + 1, total)


def test_what_is_not_broadcast_is_joined_and_changes_no_score(spark):
    docs = documents(spark)
    learns = F.col("doc_id") % 3 != 1
    scores = lambda s: {r.doc_id: r for r in ctw.lm_scores(docs, learns, s).collect()}
    whole = scores(ctw.Settings())
    for grams in (0, 50, 2000):
        got = scores(ctw.Settings(common=0.5, grams=grams))
        assert len(got) == len(texts())
        for i, r in got.items():
            assert abs(r.base_score - whole[i].base_score) < 1e-6 * max(1, abs(r.base_score))
            assert abs(r.score - whole[i].score) < 1e-5 * max(1, abs(r.score)), (grams, i)


def test_the_broadcast_part_keeps_to_its_bound(spark):
    learned = ctw.written(ctw.counted(documents(spark), ctw.Settings()), "counts").where("kind = 1").selectExpr("key AS gram", "n")
    whole, none = ctw.train(learned, ctw.Settings())
    assert none is None and whole.whole
    for most in (0, 50, 2000):
        part, others = ctw.train(learned, ctw.Settings(grams=most))
        assert len(part.grams) <= most and len(part.contexts) <= most
        assert len(part.grams) + others.where("kind = 0").count() == len(whole.grams)
        assert len(part.contexts) + others.where("kind = 1").count() == len(whole.contexts)


def test_lm_of_odd_tables(spark):
    assert ctw.lm_scores(documents(spark, []), F.lit(True)).count() == 0
    rows = ctw.lm_scores(documents(spark, [(1, "ab", "", "", 0), (1, "ab", "", "", 0), (None, None, "", "", 0)]), F.lit(False)).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert abs(rows[0].score + (rows[0].n_bytes + 1) * math.log10(256)) < 1e-6


def test_a_table_is_made_within_little_more_than_its_own_size():
    import tracemalloc

    keys = np.random.default_rng(3).permutation(np.arange(1, 2_000_001, dtype=np.uint64)) * np.uint64(977)
    values = np.arange(len(keys), dtype=np.float32)
    tracemalloc.start()
    table = ctw.Table(keys, values)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most - table.keys.nbytes - table.values.nbytes < 40_000_000
    got, found = table.get(np.r_[keys[::7], np.uint64(976)])
    assert found[:-1].all() and not found[-1] and (got[:-1] == values[::7]).all()
