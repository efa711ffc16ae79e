"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each has a tree of contexts made of the bytes before it. Counts of
(context, byte) come from a distributed count of byte n-grams. At every node the
Krichevsky-Trofimov estimate of its own counts and the product of its children are weighted half and
half, bottom-up; going down, the weights give the mixture of the estimates of all depths. Bytes that
a context never saw share the probability that the mixture leaves them, in the proportions of the
next shorter context, so every context has a distribution. A text is scored with an end byte (0).

The counts lie spread over tasks by the last two bytes of the context: those tasks make all nodes of
depth two and more. Depths 0 and 1 (65,280 nodes at most) are made on the driver.

The contexts met most often, up to a bound, are broadcast for scoring. The others stay in a table:
bytes after those contexts are looked up there by a join, so that the score is the whole model's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, encoded, partitions, rows, saved, written

#: Keys put into a table, and bytes of texts scored, at a time: what a worker holds beside the model follows these.
STRETCH = 1 << 18
#: Words whose counts a worker keeps.
WORDS = 100_000
#: A key that no word can have: it counts the ends of texts.
END = xxhash.xxh64_intdigest(b"\n") - (1 << 64 if xxhash.xxh64_intdigest(b"\n") >> 63 else 0)


@dataclass(frozen=True)
class Settings:
    """depth: most bytes of context (2 at least). grams: most (context, byte) pairs that are broadcast,
    those of the most frequent contexts; the others are joined, so it changes no score. common: words
    of at least this share of all tokens have their counts broadcast (so at most 1/common words);
    others are joined."""

    depth: int = 5
    grams: int = 4_000_000
    common: float = 3e-6


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for positive arguments (Stirling's series after a shift by 8)."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


class Level:
    """Nodes of one depth: per decision j their ids (context << j | bits so far), counts, estimates."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts  # sorted (context << 8 | byte)
        self.ids, self.of, self.ones, self.est, self.log_kt = [], [], [], [], []
        for j in range(8):
            node = keys >> np.uint64(8 - j)
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            bit = (keys >> np.uint64(7 - j) & np.uint64(1)).astype(np.float64)
            total, ones = np.add.reduceat(counts, start), np.add.reduceat(counts * bit, start)
            self.ids.append(node[start])
            self.of.append(np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(node)])))
            self.est.append((ones + 0.5) / (total + 1))
            self.log_kt.append(log_kt(total - ones, ones))
        self.log_w: list[np.ndarray] = []
        self.own: list[np.ndarray] = []

    def weigh(self, below: list[np.ndarray] | None) -> None:
        """below: ln of the product over the children, None at the deepest level."""
        for j in range(8):
            kt = self.log_kt[j]
            log_w = kt if below is None else np.logaddexp(kt, below[j]) - math.log(2)
            self.log_w.append(log_w)
            self.own.append(np.ones_like(kt) if below is None else np.exp(kt - math.log(2) - log_w))

    def up(self, depth: int, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Sums of ln weighted probability for the parents' ids, one context byte shorter."""
        return [np.bincount(self.parent(j, depth, ids[j]), self.log_w[j], len(ids[j])) for j in range(8)]

    def parent(self, j: int, depth: int, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(ids, self.ids[j] & np.uint64((1 << (8 * (depth - 1) + j)) - 1))

    def log_p(self, at: list[np.ndarray], left: list[np.ndarray]) -> np.ndarray:
        """log10 of each byte's probability, when this level is the last; at, left: mixture so far."""
        out = np.zeros(len(self.keys))
        for j in range(8):
            p = (at[j] + left[j] * self.est[j])[self.of[j]]
            out += np.log10(np.where(self.keys >> np.uint64(7 - j) & np.uint64(1) == 1, p, 1 - p))
        return out

    def down(self, at: list[np.ndarray], left: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [a + r * w * e for a, r, w, e in zip(at, left, self.own, self.est)], [r * (1 - w) for r, w in zip(left, self.own)]


def shorter(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (context << 8 | byte) with one context byte less."""
    unique, back = np.unique(keys & np.uint64((1 << (8 * depth)) - 1), return_inverse=True)
    return unique, np.bincount(back, counts)


def rest(level: Level, log_p: np.ndarray, log_p_above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, and log10 of the factor by which bytes unseen there take their probability in the shorter context."""
    context = level.keys >> np.uint64(8)
    start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    seen, above = (1 - np.add.reduceat(10**x, start) for x in (log_p, log_p_above))
    return context[start], np.log10(np.maximum(seen, 1e-12)) - np.log10(np.maximum(above, 1e-12))


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, upto: int) -> dict[int, Level]:
    """Weighted levels depth..upto of the nodes over these n-grams."""
    made, below = {}, None
    for d in range(depth, upto - 1, -1):
        made[d] = Level(keys, counts)
        if d < depth:
            below = made[d + 1].up(d + 1, made[d].ids)
        made[d].weigh(below)
        keys, counts = shorter(keys, counts, d)
    return made


def totals(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a level's contexts: where each begins, its number of pairs, its count."""
    context = level.keys >> np.uint64(8)
    start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    return start, np.diff(np.r_[start, len(context)]), np.add.reduceat(level.counts, start)


def step(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of eight steps to each doubling, so a histogram over them stays small."""
    return np.floor(8 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def least_step(steps: np.ndarray, pairs: np.ndarray, most: int) -> int:
    """The lowest step such that contexts from it on have `most` pairs together or fewer. A context's
    count is at most that of each of its suffixes, so the suffixes of a context kept are kept."""
    order = np.argsort(-steps)
    fits = np.cumsum(pairs[order]) <= most
    if fits.all():
        return 0
    return int(steps[order][fits.sum() - 1]) if fits.any() else int(steps.max()) + 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(float)) for b in batches]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    return keys[order], counts[order]


@dataclass
class Model:
    """Sorted tagged keys (depth << 56 | context << 8 | byte) with log10 probabilities, tagged
    contexts (depth << 56 | context) with factors, and a full table for contexts of one byte.
    whole: whether these are all contexts."""

    depth: int
    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    factor: np.ndarray
    one: np.ndarray
    whole: bool = True


def train(grams: DataFrame, s: Settings) -> tuple[Model, DataFrame | None]:
    """grams (gram, n): all byte n-grams (context << 8 | byte) of the training texts -> the model of
    the frequent contexts, and (kind, key, value) of the others (None where there are none): kind 0
    has log10 probabilities by tagged key, kind 1 factors by tagged context."""
    spark, depth = grams.sparkSession, s.depth
    dealt = saved(grams.select("gram", "n").repartition(partitions(spark), (F.col("gram").bitwiseAND(0xFFFFFF) / 256).cast("long")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _gathered(batches)
        schema = pa.schema([("j", pa.int32()), ("id", pa.int64()), ("value", pa.float64())])
        if len(keys):
            made = levels(keys, counts, depth, 2)
            two = made[2]
            pairs = np.zeros(8 * 64)
            for level in made.values():
                _, n, total = totals(level)
                pairs += np.bincount(step(total), n, len(pairs))
            met = np.flatnonzero(pairs)
            yield rows(schema, j=np.full(len(met), 9, np.int32), id=met, value=pairs[met])
            k, c = shorter(two.keys, two.counts, 2)
            yield rows(schema, j=np.full(len(k), 8, np.int32), id=k.astype(np.int64), value=c)
            for j in range(8):
                ids = np.unique(two.ids[j] & np.uint64((1 << (8 + j)) - 1))
                value = np.bincount(two.parent(j, 2, ids), two.log_w[j], len(ids))
                yield rows(schema, j=np.full(len(ids), j, np.int32), id=ids.astype(np.int64), value=value)

    sums = dealt.mapInArrow(first, "j int, id long, value double").groupBy("j", "id").agg(F.sum("value").alias("value")).toPandas().sort_values("id")
    full = np.full((256, 256), math.log10(1 / 256))
    if sums.empty:
        return Model(depth, np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.uint64), np.empty(0, np.float32), full), None
    of = {j: x for j, x in sums.groupby("j")}
    one = Level(of[8]["id"].to_numpy().astype(np.uint64), of[8]["value"].to_numpy())
    one.weigh([of[j]["value"].to_numpy() for j in range(8)])
    zero = Level(*shorter(one.keys, one.counts, 1))
    zero.weigh(one.up(1, zero.ids))
    root = [np.zeros_like(x) for x in zero.est], [np.ones_like(x) for x in zero.est]
    every = np.zeros(256)
    for j in range(8):
        p = np.full(256, 0.5)
        p[zero.ids[j].astype(int)] = zero.est[j]
        byte = np.arange(256)
        q = p[byte >> (8 - j)]
        every += np.log10(np.where(byte >> (7 - j) & 1 == 1, q, 1 - q))
    at0, left0 = zero.down(*root)
    at1, left1 = [a[one.parent(j, 1, zero.ids[j])] for j, a in enumerate(at0)], [a[one.parent(j, 1, zero.ids[j])] for j, a in enumerate(left0)]
    log_p1 = one.log_p(at1, left1)
    contexts, factor = rest(one, log_p1, every[(one.keys & np.uint64(255)).astype(int)])
    full = np.tile(every, (256, 1))
    full[contexts.astype(int)] += factor[:, None]
    full[(one.keys >> np.uint64(8)).astype(int), (one.keys & np.uint64(255)).astype(int)] = log_p1
    at2, left2 = one.down(at1, left1)
    # What the deeper levels need of depths 0 and 1, by (context byte << j | bits so far).
    ground = [(np.zeros(256 << j), np.ones(256 << j)) for j in range(8)]
    for j in range(8):
        ground[j][0][one.ids[j].astype(int)], ground[j][1][one.ids[j].astype(int)] = at2[j], left2[j]
    sent = spark.sparkContext.broadcast((ground, full))
    enough = least_step(of[9]["id"].to_numpy(), of[9]["value"].to_numpy(), s.grams)
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("value", pa.float32()), ("frequent", pa.bool_())])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _gathered(batches)
        if not len(keys):
            return
        ground, full = sent.value
        made = levels(keys, counts, depth, 2)
        at = [g[0][(i & np.uint64((1 << (8 + j)) - 1)).astype(int)] for j, (g, i) in enumerate(zip(ground, made[2].ids))]
        left = [g[1][(i & np.uint64((1 << (8 + j)) - 1)).astype(int)] for j, (g, i) in enumerate(zip(ground, made[2].ids))]
        shorter_p = full[(made[2].keys >> np.uint64(8) & np.uint64(255)).astype(int), (made[2].keys & np.uint64(255)).astype(int)]
        for d in range(2, depth + 1):
            level = made[d]
            log_p = level.log_p(at, left)
            contexts, factor = rest(level, log_p, shorter_p)
            _, n, total = totals(level)
            frequent = step(total) >= enough
            tag = np.uint64(d << 56)
            yield rows(schema, kind=np.zeros(len(log_p), np.int32), key=(level.keys | tag).astype(np.int64), value=log_p.astype(np.float32), frequent=np.repeat(frequent, n))
            yield rows(schema, kind=np.ones(len(contexts), np.int32), key=(contexts | tag).astype(np.int64), value=factor.astype(np.float32), frequent=frequent)
            if d < depth:
                at, left = level.down(at, left)
                nxt = made[d + 1]
                where = [nxt.parent(j, d + 1, level.ids[j]) for j in range(8)]
                at, left = [a[w] for a, w in zip(at, where)], [a[w] for a, w in zip(left, where)]
                shorter_p = log_p[np.searchsorted(level.keys, nxt.keys & np.uint64((1 << (8 * (d + 1))) - 1))]

    made, others = dealt.mapInArrow(second, "kind int, key long, value float, frequent boolean"), None
    if enough:
        made = written(made, "lm-model")
        others = made.where("not frequent").drop("frequent")
    table = made.where("frequent").drop("frequent").toArrow()
    kind, key, value = (table.column(i).to_numpy() for i in range(3))
    pick = kind == 0
    return Model(depth, key[pick].view(np.uint64), value[pick], key[~pick].view(np.uint64), value[~pick], full, others is None), others


class Table:
    """Open-addressing hash table from unsigned 64-bit keys to floats, for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, np.uint64(0)), np.zeros(1 << self.bits, np.float32)
        for i in range(0, len(keys), STRETCH):
            self._put(keys[i : i + STRETCH], values[i : i + STRETCH])

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, one stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and whether the keys are there."""
        slot = self.slot(keys)
        met = self.keys[slot]
        out, found = self.values[slot], met == keys
        left = np.flatnonzero(~found & (met != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[left]]
            hit = met == keys[left]
            out[left[hit]], found[left[hit]] = self.values[slot[left[hit]]], True
            left = left[~hit & (met != 0)]
        out[~found] = 0
        return out, found


class Scorer:
    def __init__(self, model: Model):
        self.depth, self.one, self.whole = model.depth, model.one, model.whole
        self.grams, self.contexts = Table(model.grams, model.log_p), Table(model.contexts, model.factor)

    def log_p(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each byte by the contexts here, and the depth of the longest of its
        contexts that is here; keys: context of full depth << 8 | byte."""
        out, left, known = np.zeros(len(keys)), np.arange(len(keys)), np.full(len(keys), self.depth, np.int32)
        for d in range(self.depth, 1, -1):
            tag, own = np.uint64(d << 56), keys[left] & np.uint64((1 << (8 * (d + 1))) - 1)
            value, found = self.grams.get(own | tag)
            out[left] += value
            left, own = left[~found], own[~found]
            if not len(left):
                return out, known
            value, found = self.contexts.get(own >> np.uint64(8) | tag)
            out[left] += value
            known[left[~found]] = d - 1
        own = keys[left]
        out[left] += self.one[(own >> np.uint64(8) & np.uint64(255)).astype(int), (own & np.uint64(255)).astype(int)]
        return out, known

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """log10 probability of each text with its end by the contexts here, and what has to be looked
        up in the others: per text its distinct bytes in context, their times, values so far, known depths."""
        out, open_, i = np.zeros(len(texts)), [()] * len(texts), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (size < STRETCH or j == i):
                size += len(texts[j]) + 1
                j += 1
            keys, start = grams_of(texts[i:j], self.depth)
            value, known = self.log_p(keys)
            out[i:j] = np.add.reduceat(value, start)
            if not self.whole:
                for k, (a, b) in enumerate(zip(start.tolist(), [*start[1:].tolist(), len(keys)])):
                    short = a + np.flatnonzero(known[a:b] < self.depth)
                    gram, first, times = np.unique(keys[short], return_index=True, return_counts=True)
                    open_[i + k] = gram.view(np.int64), times, value[short][first], known[short][first]
            i = j
        return out, open_


def looked_up(wanted: DataFrame, others: DataFrame, depth: int) -> DataFrame:
    """wanted (gram, so_far, known), distinct -> gram, plus: what the contexts in `others`, longer than
    `known`, change in the log10 probability. The longest context after which the byte was seen gives
    the probability; each longer one multiplies it by its factor. At most depth - 1 rows a gram."""
    probes = wanted.select("*", F.explode(F.sequence(F.col("known") + 1, F.lit(depth))).alias("d")).withColumn("own", F.expr("gram & (shiftleft(1L, 8 * (d + 1)) - 1)"))
    probes = probes.select("*", F.expr("own | shiftleft(cast(d AS long), 56)").alias("k0"), F.expr("shiftright(own, 8) | shiftleft(cast(d AS long), 56)").alias("k1"))
    seen = others.where("kind = 0").select(F.col("key").alias("k0"), F.col("value").cast("double").alias("log_p"))
    factors = others.where("kind = 1").select(F.col("key").alias("k1"), F.col("value").cast("double").alias("factor"))
    met = probes.join(factors, "k1").join(seen, "k0", "left")  # a context that isn't there changes nothing
    by = met.groupBy("gram").agg(
        F.first("so_far").alias("so_far"), F.max(F.when(F.col("log_p").isNotNull(), F.struct("d", "log_p"))).alias("longest"), F.collect_list(F.struct("d", "factor")).alias("steps")
    )
    further = F.filter("steps", lambda x: x["d"] > F.coalesce(F.col("longest.d"), F.lit(0)))
    factor = F.aggregate(further, F.lit(0.0), lambda a, x: a + x["factor"])
    return by.select("gram", (F.coalesce("longest.log_p", "so_far") + factor - F.col("so_far")).alias("plus"))


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams (context << 8 | byte, the latest context byte lowest) of texts and their ends, and where each text begins."""
    pad = b"\0" * depth
    raw = np.frombuffer(pad + pad.join(t + b"\0" for t in texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    start = np.cumsum(size + depth) - size
    keep = np.zeros(len(raw), bool)
    for a, n in zip(start.tolist(), size.tolist()):
        keep[a : a + n] = True
    wide = raw.astype(np.uint64)
    keys = wide.copy()
    for k in range(1, depth + 1):
        keys[k:] |= wide[:-k] << np.uint64(8 * k)
    return keys[keep], np.cumsum(size) - size


def counted(docs: DataFrame, s: Settings) -> DataFrame:
    """text -> (kind, key, n): counts of words (kind 0, by hash) and of byte n-grams (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
    depth = s.depth

    def words_out(words: Counter) -> pa.RecordBatch:
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)
        return rows(schema, kind=np.zeros(len(words), np.int32), key=keys, n=np.fromiter(words.values(), np.int64, len(words)))

    def grams_out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return rows(schema, kind=np.ones(len(keys), np.int32), key=keys.view(np.int64), n=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ends, held, size = Counter(), 0, [], 0

        def folded(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)

        for batch in batches:
            part, bulk = [], 0
            texts = list(encoded(batch.column(0)))
            for i, text in enumerate(texts):
                words.update(text.lower().split())
                part.append(text)
                bulk += len(text)
                if bulk > 4 << 20 or i == len(texts) - 1:
                    held.append(np.unique(grams_of(part, depth)[0], return_counts=True))
                    size += len(held[-1][0])
                    part, bulk = [], 0
                if len(words) > 500_000:
                    yield words_out(words)
                    words = Counter()
                if size > 4_000_000:
                    held = [folded(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield grams_out(*held[0])
                        held = []
                    size = sum(len(k) for k, _ in held)
            ends += len(texts)
        yield words_out(words)
        yield rows(schema, kind=[0], key=[END], n=[ends])
        if held:
            yield grams_out(*folded(held))

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")


def lm_scores(docs: DataFrame, learns, s: Settings | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows for which the column expression learns holds teach both models: add-one word frequencies
    (A-Z lower-cased, ASCII white space splits, one end for each text) and context-tree weighting.
    Null texts count as empty: their only token is the end. Repeated rows repeat in the result;
    without any row to learn from all bytes are equally likely. An empty table gives an empty one.
    """
    s = s or Settings()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = written(counted(docs.where(learns), s), "lm-counts")
    words, grams = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select(F.col("key").alias("gram"), "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, others = train(grams, s)
    often = words.where((F.col("n") >= F.lit(s.common) * F.lit(total)) | (F.col("key") == END)).toPandas()
    sent = spark.sparkContext.broadcast((dict(zip(often["key"].tolist(), often["n"].tolist())), model))
    size = math.log10(total + kinds + 1)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("sum", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("open", pa.list_(pa.int64())), ("open_times", pa.list_(pa.int64())), ("so_far", pa.list_(pa.float64())), ("known_depth", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, model = sent.value
        scorer, cache = Scorer(model), {}
        ends = often.get(END, 0)
        for batch in batches:
            for part in by_size(batch, 1, STRETCH):
                texts = list(encoded(part.column(1)))
                out = []
                for text in texts:
                    n, known, total, rare, times = 1, int(ends > 0), math.log10(ends + 1), [], []
                    for word, c in Counter(text.lower().split()).items():
                        if (met := cache.get(word)) is None:
                            if len(cache) > WORDS:
                                cache.clear()
                            key = xxhash.xxh64_intdigest(word)
                            key -= (key >> 63) << 64
                            met = cache[word] = (key, often.get(key, 0), math.log10(often.get(key, 0) + 1))
                        n += c
                        if met[1]:
                            known += c
                            total += c * met[2]
                        else:
                            rare.append(met[0])
                            times.append(c)
                    out.append((n, known, total, rare, times))
                score, open_ = scorer.texts(texts)
                yield rows(
                    schema, row=[xxhash.xxh64_intdigest(t, 1) >> 1 for t in texts], doc_id=part.column(0), n_tokens=[x[0] for x in out], known=[x[1] for x in out], sum=[x[2] for x in out],
                    score=score, n_bytes=list(map(len, texts)), rare=[x[3] for x in out], times=[x[4] for x in out],
                    **{name: [x[k] if x else None for x in open_] for k, name in enumerate(("open", "open_times", "so_far", "known_depth"))},
                )

    made = written(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, sum double, score double, n_bytes long, rare array<long>, times array<long>, open array<long>, open_times array<long>, so_far array<double>, known_depth array<int>"), "lm-rows")
    # Equal texts have equal words: each text's rare words are joined once.
    texts = made.groupBy("row").agg(F.first("rare").alias("rare"), F.first("times").alias("times"))
    pairs = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    met = pairs.join(words.where(F.col("n") < F.lit(s.common) * F.lit(total)), "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("plus"))
    if others is not None:
        once = made.groupBy("row").agg(*(F.first(c).alias(c) for c in ("open", "open_times", "so_far", "known_depth")))
        zipped = once.select("row", F.explode(F.arrays_zip("open", "open_times", "so_far", "known_depth")).alias("x"))
        each = zipped.select("row", F.col("x.open").alias("gram"), F.col("x.open_times").alias("times"), F.col("x.so_far").alias("so_far"), F.col("x.known_depth").alias("known"))
        wanted = each.groupBy("gram").agg(F.first("so_far").alias("so_far"), F.first("known").alias("known"))
        more = each.select("row", "gram", "times").join(looked_up(wanted, others, s.depth), "gram")
        change = more.groupBy("row").agg(F.sum(F.col("times") * F.col("plus")).alias("change"))
        made = made.join(change, "row", "left").withColumn("score", F.col("score") + F.coalesce("change", F.lit(0.0)))
    n = F.col("n_tokens")
    return made.drop("rare", "times", "open", "open_times", "so_far", "known_depth").join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("plus", F.lit(0.0)) - n * F.lit(size)).alias("base_score"), "score", "n_bytes",
        (F.col("score") * (-math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
