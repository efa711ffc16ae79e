"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code over the fingerprint's bits. A fingerprint's home is its
nearest anchor, D its distance from home. Distances to a code differ by at most d between two
fingerprints d apart, so with D(x) <= D(y) the home of x lies within D(x) + t <= D(y) + t of y.
Hence it is enough to copy every fingerprint to the anchors within D + t of it (never beyond
covering radius plus threshold) and to compare, at every anchor, the fingerprints at home there
with all that were copied there. No pair within t is lost.

Bits may be cut into blocks with a code each: a pair t apart is at most t // blocks apart in one
of them. One block and the product of two Golay codes and two repetition codes give 2**26 anchors
(covering radius 14) for small thresholds; three blocks of one Golay code each reach 8 bits.
Links by similarity are found with several fingerprints of each text: see neardup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, columns_of, encoded, partitions, rows, saved, written
from .components import components

SEED = 42
#: Generator polynomial of the binary Golay code of length 23 (a fixed value of that code).
GOLAY = 0b101011100011


@dataclass(frozen=True)
class Part:
    """Bits [shift, shift + width) of a fingerprint, covered by a Golay ("golay", up to 23 bits) or a repetition code ("rep", odd width)."""

    shift: int
    width: int
    kind: str


@dataclass(frozen=True)
class Cover:
    """blocks: the parts of each block; threshold: the most bits in which linked fingerprints differ."""

    blocks: tuple[tuple[Part, ...], ...]
    threshold: int

    @property
    def within(self) -> int:
        return self.threshold // len(self.blocks)


def narrow_cover(threshold: int = 2) -> Cover:
    """All 64 bits in one block: thresholds of about 3 bits."""
    return Cover(((Part(0, 23, "golay"), Part(23, 23, "golay"), Part(46, 9, "rep"), Part(55, 9, "rep")),), threshold)


def wide_cover(threshold: int = 8) -> Cover:
    """Three blocks of 21, 21 and 22 bits: thresholds up to 8 bits."""
    return Cover(((Part(0, 21, "golay"),), (Part(21, 21, "golay"),), (Part(42, 22, "golay"),)), threshold)


def golay_syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=16)
def patterns(kind: str, width: int, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every class of words (syndrome or word) the error patterns that lead to anchors at most
    within beyond the nearest: first index of each class, patterns, distance beyond the nearest."""
    if kind == "golay":
        errors = np.array([sum(1 << i for i in c) for w in range(3 + within + 1) for c in combinations(range(23), w)], dtype=np.int64)
        classes, n = golay_syndrome(errors), 1 << 11
    else:
        words = np.arange(1 << width, dtype=np.int64)
        classes, n = np.concatenate([words, words]), 1 << width
        errors = np.concatenate([words, words ^ (n - 1)])
    weight = np.bitwise_count(errors).astype(np.int64)
    least = np.full(n, 99, dtype=np.int64)
    np.minimum.at(least, classes, weight)
    beyond = weight - least[classes]
    keep = beyond <= within
    classes, errors, beyond = classes[keep], errors[keep], beyond[keep]
    order = np.lexsort((errors, beyond, classes))
    return np.searchsorted(classes[order], np.arange(n + 1)), errors[order], beyond[order]


def anchors(fingerprints: np.ndarray, parts: tuple[Part, ...], within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and distance beyond home for every anchor that a fingerprint is copied to."""
    row = np.arange(len(fingerprints))
    key = np.zeros(len(fingerprints), dtype=np.uint64)
    beyond = np.zeros(len(fingerprints), dtype=np.int64)
    place = 0
    for part in parts:
        first, errors, more = patterns(part.kind, part.width, within)
        word = (fingerprints >> np.uint64(part.shift) & np.uint64((1 << part.width) - 1)).astype(np.int64)
        kind = golay_syndrome(word) if part.kind == "golay" else word
        n = (first[kind + 1] - first[kind])[row]
        at = np.repeat(first[kind][row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, key, beyond = np.repeat(row, n), np.repeat(key, n), np.repeat(beyond, n) + more[at]
        keep = beyond <= within
        row, key, beyond, at = row[keep], key[keep], beyond[keep], at[keep]
        key = key | (word[row] ^ errors[at]).astype(np.uint64) << np.uint64(place)
        place += 23 if part.kind == "golay" else part.width
    return row, key, beyond


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of the width-word shingles of a text (A-Z lower-cased, ASCII white space splits)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    return _vote(words, joined, width)


def _hashes(words: list[bytes], joined: bytes, width: int) -> np.ndarray:
    """Hashes of all shingles, repeated ones too; a text of fewer words than a shingle is one."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end[width - 1 :].tolist())), dtype=np.uint64, count=len(start))


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The hashes as those of another seed, by the finalizer of splitmix64; seed 0 leaves them."""
    if seed == 0:
        return hashes
    x = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _vote(words: list[bytes], joined: bytes, width: int) -> int:
    return _majority(_hashes(words, joined, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, fingerprint, content) as longs; content is a hash of the sequence of words.
    Texts of fewer words than a shingle hash as a whole; texts without words (null and empty ones
    too) get 0. Null ids stay null."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("content", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, content = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.uint64)
            for i, text in enumerate(encoded(batch.column(1))):
                words = text.lower().split()
                joined = b" ".join(words)
                found[i], content[i] = _vote(words, joined, width) if words else 0, xxhash.xxh64_intdigest(joined)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64)), pa.array(content.view(np.int64))], schema=schema)

    return columns_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long, content long")


REPLICA = pa.schema([("block", pa.int32()), ("anchor", pa.int64()), ("beyond", pa.int32()), ("id", pa.int64()), ("fingerprint", pa.int64())])


def replicas(members: DataFrame, cover: Cover) -> DataFrame:
    """(id, fingerprint) -> one row for every anchor that it is copied to; beyond is 0 at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids, found = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for b, parts in enumerate(cover.blocks):
                    row, key, beyond = anchors(found.view(np.uint64), parts, cover.within)
                    yield rows(REPLICA, block=np.full(len(row), b, dtype=np.int32), anchor=key.view(np.int64), beyond=beyond.astype(np.int32), id=ids[row], fingerprint=found[row])

    return members.select("id", "fingerprint").mapInArrow(run, "block int, anchor long, beyond int, id long, fingerprint long")


class _Anchor:
    """Compares what arrives at one anchor with the fingerprints at home there; those come first."""

    def __init__(self, threshold: int):
        self.threshold, self.ids, self.found = threshold, np.empty(0, np.int64), np.empty(0, np.uint64)
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.root.get(x, x) != x:
            self.root[x] = x = self.root.get(self.root[x], self.root[x])
        return x

    def add(self, ids: np.ndarray, found: np.ndarray, home: np.ndarray, out: list) -> None:
        if home.any():
            self.ids, self.found = np.concatenate([self.ids, ids[home]]), np.concatenate([self.found, found[home]])
        if len(self.ids) == 0:
            return
        step = max(1, 2_000_000 // len(self.ids))
        for i in range(0, len(ids), step):
            apart = np.bitwise_count(found[i : i + step, None] ^ self.found[None, :])
            member, at = np.nonzero(apart <= self.threshold)
            other = self.ids[at]
            keep = ids[i + member] != other
            if not keep.any():
                continue
            member, other, bits = member[keep] + i, other[keep], apart[member[keep], at[keep]]
            order = np.lexsort((other, bits, member))
            for m, h, d in zip(ids[member[order]].tolist(), other[order].tolist(), bits[order].tolist()):
                a, b = self.find(m), self.find(h)
                if a != b:  # only links that join two groups: as many as members, not as pairs
                    self.root[max(a, b)] = min(a, b)
                    out.append((m, h, d))


def links(members: DataFrame, cover: Cover) -> DataFrame:
    """(id, fingerprint), both unique -> (a, b, bits): links within the threshold that join the same
    groups as all links do. At each anchor nearest pairs come first and a link is given only if it
    joins two groups there, so a group of n near copies yields about n links for each anchor."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = None, None
        for batch in batches:
            block, key, beyond, ids, found = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            found = found.view(np.uint64)
            out: list = []
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]) if len(key) else []
            stop = np.r_[start[1:], len(key)] if len(key) else []
            homes = np.add.reduceat((beyond == 0).astype(np.int64), start) if len(key) else []
            for s, e, h in zip(start, stop, homes):
                name = (block[s], key[s])
                if name != last:
                    last, anchor = name, None
                    if e - s < 2 and e < len(key) or not h:
                        continue
                    anchor = _Anchor(cover.threshold)
                if anchor is not None:
                    anchor.add(ids[s:e], found[s:e], beyond[s:e] == 0, out)
            if out:
                a, b, d = zip(*out)
                yield rows(schema, a=a, b=b, bits=d)

    n = partitions(members.sparkSession)
    dealt = replicas(members, cover).repartition(n, "block", "anchor").sortWithinPartitions("block", "anchor", "beyond")
    return dealt.mapInArrow(run, "a long, b long, bits int").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("bits").alias("bits"))


def near_duplicates(docs: DataFrame, width: int = 3, cover: Cover | None = None, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """docs -> (doc_id, fingerprint, component_id), one row for each row of docs.

    Members are the distinct fingerprints, named by the smallest doc_id; links join members whose
    fingerprints differ in at most cover.threshold bits; component_id is the smallest doc_id that
    can be reached. With a similarity, members are the distinct sequences of words, linked as in
    neardup.near_copies. Rows with a null id are left out; repeated rows give repeated results; an
    empty table an empty one.
    """
    docs = columns_of(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col).toDF("doc_id", "text")
    if similarity is not None:
        from .neardup import near_copies

        return near_copies(docs, width, similarity, cover).select("doc_id", "fingerprint", "component_id")
    found = saved(fingerprints(docs, width))
    members = saved(found.groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    label = components(links(members, cover or narrow_cover()))
    named = members.join(label, "id", "left").select("fingerprint", F.coalesce("label", "id").alias("component_id"))
    return found.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def similar(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least this Jaccard similarity of their distinct shingles.
    Only texts named in a pair move."""
    return judged(pairs, docs, width, similarity).where("ok").select("a", "b")


def judged(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) and ok: whether they have this similarity."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return compared(pairs, shingle_sets(docs.join(named, "doc_id").dropDuplicates(["doc_id"]), width), similarity)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) -> a written table (id, shingles): the distinct hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in (x for b in batches for x in by_size(b, 1)):
            out = []
            for text in encoded(batch.column(1)):
                words = text.lower().split()
                found = np.unique(_hashes(words, b" ".join(words), width)) if words else np.empty(0, np.uint64)
                out.append(found.view(np.int64))
            yield rows(schema, id=batch.column(0), shingles=out)

    return written(docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>"), "shingles")


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) and ok, by their texts' shingle_sets."""
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", (shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).alias("ok"))
