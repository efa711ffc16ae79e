"""Line dedup with two Bloom filters.

A first pass puts the hash of every line key into two bit fields: once, and again where the key was
met before (in the same task, or in another one: the AND of two tasks' fields marks what both have
seen). Only lines whose bits are all set in the second field are suspected repeats; they alone are
shuffled, as 128-bit digests of their keys, counted exactly, and the first occurrence of each confirmed
key is chosen. False positives of the filters cost some shuffle and never change the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, encoded, partitions, rows, saved

SPACE = b" \t\n\x0b\x0c\r"
#: Least and most log2 of the bits of one filter: at most 2**29, so 64 MB are broadcast.
BITS = (23, 29)
HASHES = 3
SEGMENT = 1 << 16  # bytes of a filter that are merged together
#: Most bytes of confirmed keys that are broadcast; beyond it, they are joined by document.
BROADCAST_BYTES = 32_000_000


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def digest_of(key: bytes) -> bytes:
    """What a key is told apart by: 128 bits, however long the line."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions for each hash."""
    low, high = hashes & np.uint64((1 << bits) - 1), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(k) * high) & np.uint64((1 << bits) - 1) for k in range(HASHES)])


class Twice:
    """Once-seen and twice-seen bits of the hashes added."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)

    @staticmethod
    def _put(field: np.ndarray, slots: np.ndarray) -> None:
        np.bitwise_or.at(field, (slots >> np.uint64(3)).ravel(), (np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8)).ravel())

    @staticmethod
    def has(field: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return (field[(slots >> np.uint64(3))] >> (slots & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        unique, n = np.unique(hashes, return_counts=True)
        slots = _slots(unique, self.bits)
        again = (n > 1) | self.has(self.once, slots)
        self._put(self.twice, slots[:, again])
        self._put(self.once, slots)


def _keys(text: bytes, least: int) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and their keys; b"" for keys that are too short to be dropped."""
    lines = text.split(b"\n")
    keys = [key_of(x) for x in lines]
    if least > 1:
        keys = [k if len(k) >= least and len(k.decode()) >= least else b"" for k in keys]
    return lines, keys


def fitting_bits(docs: DataFrame) -> int:
    """log2 of a filter's bits: 16 for each line of the texts, within BITS. More lines fill the
    filters, which costs shuffle (more lines are suspected) and never changes the result."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = docs.agg(F.coalesce(F.sum(breaks), F.lit(0))).first()[0]
    return min(max(int(16 * lines - 1).bit_length(), BITS[0]), BITS[1])


def twice_seen(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The twice-seen filter of all line keys (each counted once a document). Every task gives the
    segments of its fields that have bits, compressed, so what is shuffled follows the lines; each
    segment's pieces are merged one after another as they arrive."""
    segments = (1 << (bits - 3)) // SEGMENT or 1
    size = (1 << (bits - 3)) // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, schema = Twice(bits), pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
        digest, some = xxhash.xxh64_intdigest, False
        for batch in (x for b in batches for x in by_size(b, 0)):
            found = [digest(k) for t in encoded(batch.column(0)) for k in set(_keys(t, least)[1]) if k]
            if found:
                some = True
                seen.add(np.array(found, dtype=np.uint64))
        if some:
            for s in range(segments):
                once, twice = seen.once[s * size : (s + 1) * size], seen.twice[s * size : (s + 1) * size]
                if once.any():
                    yield rows(schema, segment=[s], once=[zlib.compress(once.tobytes(), 1)], twice=[zlib.compress(twice.tobytes(), 1)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int32()), ("twice", pa.binary())])
        last, once, twice = None, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for segment, *pieces in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != last:
                    if last is not None:
                        yield rows(schema, segment=[last], twice=[zlib.compress(twice.tobytes(), 1)])
                    last, once, twice = segment, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in pieces)
                twice |= b | once & a
                once |= a
        if last is not None:
            yield rows(schema, segment=[last], twice=[zlib.compress(twice.tobytes(), 1)])

    parts = docs.select("text").mapInArrow(run, "segment int, once binary, twice binary")
    dealt = parts.repartition(min(segments, partitions(docs.sparkSession)), "segment").sortWithinPartitions("segment")
    field = np.zeros(1 << (bits - 3), np.uint8)
    for row in dealt.mapInArrow(merge, "segment int, twice binary").toLocalIterator():  # at most one filter in all
        field[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return field


def _suspected(text: bytes, least: int, field: np.ndarray, bits: int) -> list[bytes]:
    """The keys of a text whose bits are all set in the twice-seen filter, once each."""
    keys = [k for k in set(_keys(text, least)[1]) if k]
    if not keys:
        return []
    slots = _slots(np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64), bits)
    return [keys[i] for i in np.flatnonzero(Twice.has(field, slots)).tolist()]


def repeated_keys(docs: DataFrame, sent: Broadcast, documents: int = 10, least: int = 1, passage: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (key, n_documents, first): digests of the line keys of at least `least`
    code points that are found in at least `documents` rows (in two, for lines of `passage` words or
    more), and the smallest doc_id with it. sent: the twice-seen filter and the log2 of its bits."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("enough", pa.int64())])

    def given(count: dict[bytes, list]) -> pa.RecordBatch:
        return rows(schema, key=list(count), first=[x[0] for x in count.values()], n=[x[1] for x in count.values()], enough=[x[2] for x in count.values()])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, bits = sent.value
        count: dict[bytes, list] = {}
        for batch in (x for b in batches for x in by_size(b, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                for key in _suspected(text, least, field, bits):
                    if (met := count.get(name := digest_of(key))) is None:
                        met = count[name] = [doc, 0, min(2, documents) if passage is not None and len(key.split()) >= passage else documents]
                    met[1] += 1
                    if doc is not None and (met[0] is None or doc < met[0]):
                        met[0] = doc
            if len(count) > 200_000:
                yield given(count)
                count = {}
        if count:
            yield given(count)

    counted = docs.select("doc_id", "text").mapInArrow(suspects, "key binary, first long, n long, enough long")
    found = counted.groupBy("key").agg(F.sum("n").alias("n_documents"), F.min("first").alias("first"), F.min("enough").alias("enough"))
    return found.where("n_documents >= enough").drop("enough")


def line_dedup(docs: DataFrame, documents: int = 10, least: int = 1, keep_first: bool = False, bits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, passage: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with all their columns, text without the lines whose key (ASCII white
    space stripped, A-Z lower-cased, at least `least` code points) occurs in at least `documents`
    rows, and n_lines, n_dropped. Lines of `passage` words or more count from two rows on. keep_first leaves such lines in the document with the smallest id.

    A null or empty text is one empty line, which is never dropped, and comes back as ''. A text all
    of whose lines go becomes ''. Each row counts as one document, whatever its id. Columns of docs
    named n_lines or n_dropped give way. Texts are worked on in slices of about a MB; a longer text,
    or one of very many lines, alone.
    """
    from pyspark.sql.types import LongType, StructType

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    bits = bits or fitting_bits(docs)
    twice = docs.sparkSession.sparkContext.broadcast((twice_seen(docs, least, bits), bits))
    keys = saved(repeated_keys(docs, twice, documents, least, passage))
    size = keys.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]
    schema = StructType(list(docs.schema)).add("n_lines", LongType()).add("n_dropped", LongType())
    at, id_at = kept.index("text"), kept.index("doc_id")

    def apply(batches: Iterator[pa.RecordBatch], drops) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in by_size(b, at)):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(at).cast(pa.binary()).to_pylist(), drops(batch)):
                lines, keys = _keys(text or b"", least)
                left = [x for x, k in zip(lines, keys) if not k or digest_of(k) not in gone]
                texts.append(b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    if size <= broadcast_bytes:
        first = {bytes(r["key"]): r["first"] for r in keys.select("key", "first").toLocalIterator()}
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = sent.value

            class Others:
                def __init__(self, doc):
                    self.doc = doc

                def __contains__(self, key: bytes) -> bool:
                    return key in first and first[key] != self.doc

            return apply(batches, lambda b: [Others(d) for d in b.column(id_at).to_pylist()] if keep_first else [first] * b.num_rows)

        return docs.mapInArrow(run, schema)

    # Too many keys to send: join them with the documents' suspected keys, then bring each document its own.
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, bits = twice.value
        out = pa.schema([("row", pa.binary()), ("doc", pa.int64()), ("key", pa.binary())])
        for batch in (x for b in batches for x in by_size(b, 1)):
            row, docs_, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                if met := _suspected(text, least, field, bits):
                    row += [_row(doc, text)] * len(met)
                    docs_ += [doc] * len(met)
                    found += map(digest_of, met)
            if found:
                yield rows(out, row=row, doc=docs_, key=found)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return apply(batches, lambda b: [set(map(bytes, x or ())) for x in b.column(len(kept)).to_pylist()])

    pairs = docs.select("doc_id", "text").mapInArrow(own, "row binary, doc long, key binary")
    hit = pairs.join(keys, "key").where(~F.col("doc").eqNullSafe(F.col("first")) if keep_first else F.lit(True))
    gone = hit.groupBy("row").agg(F.collect_set("key").alias("__gone")).withColumnRenamed("row", "__row")
    named = docs.withColumn("__row", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary"), 256)))
    return named.join(gone, "__row", "left").drop("__row").mapInArrow(joined, schema)


def _row(doc, text: bytes) -> bytes:
    return hashlib.sha256(f"{'-' if doc is None else doc}:".encode() + text).digest()
