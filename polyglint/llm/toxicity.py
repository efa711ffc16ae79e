"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams, trigrams and skip-grams (one word left out) of a
text. Unigrams are taken of the words and of their stems (words cut to 3 to 7 letters), so that other
endings of a word that was learned count too. FTRL keeps a learning rate for every coordinate and
drives weak ones to exactly zero (L1), so the model is a short list of slots and weights with a fixed
bound (2**bits), sent to the tasks.

Texts may be of any length: features are made MB by MB of text, and one text's own features are all
that grows with it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, columns_of, rows, strings

WORD = re.compile(r"[^\W_]+")
#: Letters that stems of a word keep.
STEMS = (3, 4, 5, 6, 7)
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the hashed slots. sample: most labelled rows used to fit (by smallest hash of
    the id). alpha, beta, l1, l2: of FTRL-proximal. epochs: passes over the sample. threshold: score
    from which a text is toxic."""

    bits: int = 20
    sample: int = 12_000
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 4
    threshold: float = 0.7


class Words(dict):
    """Word -> row of `hashed` (its hash), `own` (its unigram and those of its stems; for stems no
    shorter than the word, its own unigram again) and `active` (whether one of these is in `live`).
    Forgets all when it grows beyond its bound."""

    most = 400_000

    def __init__(self, bits: int, live: np.ndarray | None = None) -> None:
        super().__init__()
        self.bits, self.live = bits, np.zeros(1 << bits, bool) if live is None else live
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list = []
        self.hashed, self.own, self.active = np.empty(0, np.uint64), np.empty((0, 1 + len(STEMS)), np.int32), np.empty(0, bool)

    def __missing__(self, word: str) -> int:
        hashed, n, whole = zlib.crc32, len(word), word.encode()
        if len(whole) == n:
            stems = [hashed(whole[:k]) if k < n else -1 for k in STEMS]
        else:
            stems = [hashed(word[:k].encode()) if k < n else -1 for k in STEMS]
        self.fresh.append([hashed(whole), *stems])
        self[word] = at = len(self)
        return at

    def rows_of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.fresh:
            raw = np.array(self.fresh, dtype=np.int64)
            kind = np.where(raw < 0, 1, np.array([1, *(10 + k for k in STEMS)]))
            slots = _slot(np.where(raw < 0, raw[:, :1], raw).astype(np.uint64) * _K[0] + kind.astype(np.uint64), self.bits)
            self.hashed = np.concatenate([self.hashed, raw[:, 0].astype(np.uint64)])
            self.own = np.concatenate([self.own, slots])
            self.active = np.concatenate([self.active, self.live[slots].any(axis=1)])
            self.fresh = []
        return at


def _slot(mixed: np.ndarray, bits: int) -> np.ndarray:
    return ((mixed ^ mixed >> np.uint64(29)) * _K[3] >> np.uint64(64 - bits)).astype(np.int32)


def _grams(w: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slots of the bigrams, skip-grams and trigrams that begin at each word."""
    two, skip, three = w[:-1] * _K[1] ^ w[1:] * _K[2], w[:-2] * _K[1] ^ w[2:] * _K[2], w[:-2] * _K[1] ^ w[1:-1] * _K[2] ^ w[2:] * _K[3]
    return [_slot(x * _K[0] + np.uint64(k), bits) for k, x in ((2, two), (3, skip), (4, three))]


def features(text: str, ids: Words) -> np.ndarray:
    """Sorted distinct slots of a text."""
    at = ids.rows_of(WORD.findall(text.lower()))
    return np.unique(np.concatenate([ids.own[np.unique(at)].ravel(), *_grams(ids.hashed[at], ids.bits)]))


def sums(texts: list[str], ids: Words, weights: np.ndarray) -> np.ndarray:
    """For each text the sum of the weights of its features (ids.live: those that have one). Only
    these are told apart, for they are few."""
    found = [WORD.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    at, doc = ids.rows_of([w for words in found for w in words]), np.repeat(np.arange(len(found)), n)
    k = np.flatnonzero(ids.active[at])
    pairs = [(np.repeat(doc[k], ids.own.shape[1]), ids.own[at[k]].ravel())]
    for slots in _grams(ids.hashed[at], ids.bits):
        k = np.flatnonzero(ids.live[slots])
        k = k[doc[k] == doc[k + len(doc) - len(slots)]]  # not across texts
        pairs.append((doc[k], slots[k]))
    pair = np.unique(np.concatenate([d * (1 << ids.bits) + x for d, x in pairs]))
    return np.bincount(pair >> ids.bits, weights=weights[pair & ((1 << ids.bits) - 1)], minlength=len(texts))


def ftrl(values: np.ndarray, ends: np.ndarray, labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that are not zero, and the bias. Example k has the slots values[ends[k]:ends[k + 1]]."""
    size = (1 << s.bits) + 1  # the last slot is the bias
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([size - 1])

    def weights(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == size - 1, 0.0, s.l1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for x in order.permutation(len(labels)):
            i = np.concatenate([values[ends[x] : ends[x + 1]], bias])
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[x]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size - 1))
    kept = np.flatnonzero(w)
    return kept, w[kept], float(weights(bias)[0])


def fit(labelled: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """labelled (doc_id, text, label 0/1; at most s.sample ids) -> the model. Features are made where
    the rows lie; one task fits on them, for their number is bounded."""
    bits = s.bits
    chosen = labelled.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    schema = pa.schema([("label", pa.int32()), ("slots", pa.list_(pa.int32()))])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Words(bits)
        for batch in (x for b in batches for x in by_size(b, 1)):
            yield rows(schema, label=batch.column(0).cast(pa.int32()), slots=[features(t, ids) for t in strings(batch.column(1))])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, size, values = [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for batch in batches:
            labels.append(batch.column(0).to_numpy(zero_copy_only=False).astype(float))
            size.append(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            values.append(batch.column(1).flatten().to_numpy())
        y, ends, x = np.concatenate(labels), np.r_[0, np.cumsum(np.concatenate(size))], np.concatenate(values)
        out = pa.schema([("slot", pa.int64()), ("weight", pa.float64())])
        if len(y):
            slots, weights, bias = ftrl(x, ends, y, s)
            yield rows(out, slot=np.append(slots, -1), weight=np.append(weights, bias))

    # In an order of their own, so that the model does not depend on how rows arrive.
    made = chosen.select("label", "text").mapInArrow(prepare, "label int, slots array<int>")
    one = made.withColumn("place", F.xxhash64("slots")).repartition(1).sortWithinPartitions("place", "label").select("label", "slots")
    model = one.mapInArrow(learn, "slot long, weight double").toPandas()
    if model.empty:
        return np.empty(0, np.int64), np.empty(0), 0.0
    bias = model["slot"] == -1
    return model.loc[~bias, "slot"].to_numpy(), model.loc[~bias, "weight"].to_numpy(), float(model.loc[bias, "weight"].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], s: Settings) -> DataFrame:
    """docs with all their columns, score (0 to 1) and predicted (1 from the threshold on). Null and
    empty texts get the score of the bias; columns of docs named score or predicted give way."""
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index("text")
    picked = columns_of(docs, *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = sent.value
        dense = np.zeros(1 << s.bits)
        dense[slots] = weights
        ids = Words(s.bits, dense != 0)
        for batch in (x for b in batches for x in by_size(b, at)):
            found = sums(strings(batch.column(at)), ids, dense)
            p = 1 / (1 + np.exp(-np.clip(found + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = StructType(list(picked.schema)).add("score", DoubleType()).add("predicted", IntegerType())
    return picked.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, learns, s: Settings | None = None) -> DataFrame:
    """docs (doc_id, text, ...) scored by a model fitted to the rows of labels (doc_id, toxic) for
    which the column expression learns (over doc_id) holds. Labels without a document, null labels
    and null ids are not learned from; of several labels of one id the larger counts. Without any
    label every score is 0.5."""
    s = s or Settings()
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label")).where(learns)
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    labelled = columns_of(docs, "doc_id", "text").join(F.broadcast(few), "doc_id")
    return score(docs, fit(labelled, s), s)
