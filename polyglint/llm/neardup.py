"""Near copies by SimHash with several fingerprints, every link verified.

Texts at a Jaccard similarity of 0.8 differ in 9.7 of 64 bits on average, with a wide spread, so the
links of one fingerprint within 8 bits lose many of them. Here each text has SEEDS independent
fingerprints. Two blocks of each are covered by anchors, and a pair meets wherever one block of one
fingerprint has an anchor of both: at a similarity of 0.8, 0.575 of all pairs meet at any one block
(measured on random bits), so about 2 of 10,000 meet at none of the ten. Pairs that met are
candidates if all their fingerprints together differ in at most reach() bits.

Candidates are thinned only by links that passed the Jaccard test: a candidate is left out where its
texts are in one verified group, or (for now) where others join the same groups. All pairs that met
are in one group of candidates then; where a test failed, the group's texts are compared with each
other, tile by tile, and tested where they are compared. So pairs that fail are never rows: what is
written are links that join texts of two tiles, however many pairs of a group are near.

An anchor with more than HOME_ROWS texts at home is dealt in as many parts as that takes: each part
holds its share of the texts at home and meets all that come to the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, encoded, partitions, row_digest, rows, written
from .components import components
from .simhash import Cover, Part, _hashes, _majority, _mixed, anchors, judged, shingle_sets

SEEDS = 5
#: Share of bits that differ at a similarity of 0.8: the angle of 2J / (1 + J), in half turns.
DIFFERENT = float(np.arccos(1.6 / 1.8) / np.pi)
#: Candidates may differ by so many standard deviations more than that.
DEVIATIONS = 3.0
#: Texts at home that one task holds for an anchor.
HOME_ROWS = 20_000
#: Most texts and hashes of shingles of a tile on average, and the fewest texts for which a group is cut in more tiles.
TILE_ROWS, TILE_HASHES, LEAST_ROWS = 4_000, 1_000_000, 50
#: Pairs of tiles for each partition that a large group is cut in, so that tasks are even.
TILES_EACH = 4
SEEN = [f"seen_{k}" for k in range(SEEDS)]
MEMBER = "id long, seed int, fingerprint long, check long, label long"


def reach(fingerprints: int) -> int:
    """Most bits in which so many fingerprints of candidates differ: 31 of 128, 67 of 320."""
    bits = 64 * fingerprints
    return int(bits * DIFFERENT + DEVIATIONS * (bits * DIFFERENT * (1 - DIFFERENT)) ** 0.5)


def four_blocks() -> Cover:
    """Four blocks of 16 bits, each with the anchors of one bit: all pairs within 7 bits meet."""
    return Cover(tuple((Part(16 * k, 16, "golay"),) for k in range(4)), 7)


def two_blocks() -> Cover:
    """Two blocks of 16 bits, each with the anchors of one bit: all pairs within 3 of these 32 bits meet."""
    return Cover(tuple((Part(16 * k, 16, "golay"),) for k in range(2)), 3)


def seen(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) -> row, doc_id, content (128 bits of hash of the sequence of words) and the fingerprints."""
    schema = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("content", pa.binary()), *((n, pa.int64()) for n in SEEN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in by_size(b, 2)):
            found, content = np.zeros((SEEDS, batch.num_rows), np.uint64), []
            for i, text in enumerate(encoded(batch.column(2))):
                words = text.lower().split()
                joined = b" ".join(words)
                content.append(xxhash.xxh3_128_digest(joined))
                if words:
                    hashes = _hashes(words, joined, width)
                    found[:, i] = [_majority(_mixed(hashes, k)) for k in range(SEEDS)]
            yield rows(schema, row=batch.column(0).cast(pa.string()), doc_id=batch.column(1).cast(pa.int64()), content=content, **{n: found[k].view(np.int64) for k, n in enumerate(SEEN)})

    return docs.select(row_digest().alias("row"), "doc_id", "text").mapInArrow(run, f"row string, doc_id long, content binary, {', '.join(f'{n} long' for n in SEEN)}")


class _Meeting:
    """Finds the candidates of what arrives at one anchor among the texts at home there; those come first."""

    def __init__(self, most: int | None, prints: int):
        self.most, self.reach = most, reach(prints)
        self.home = np.empty(0, np.int64), np.empty((prints, 0), np.uint64), np.empty(0, np.int64)
        self.root: dict[int, int] = {}
        self.used: dict[int, int] = {}
        self.short: set[int] = set()

    def find(self, x: int) -> int:
        while self.root.get(x, x) != x:
            self.root[x] = x = self.root.get(self.root[x], self.root[x])
        return x

    def roots(self, labels: np.ndarray) -> np.ndarray:
        return np.array([self.find(x) for x in labels.tolist()], dtype=np.int64) if self.root else labels

    def near(self, some: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs within reach, and their bits: all by three fingerprints, those left by the rest."""
        apart = np.bitwise_count(some[0][:, None] ^ found[0][None, :])
        for k in range(1, min(3, len(some))):
            apart += np.bitwise_count(some[k][:, None] ^ found[k][None, :])
        member, at = np.nonzero(apart <= self.reach)
        bits = apart[member, at].astype(np.int64)
        for k in range(3, len(some)):
            bits += np.bitwise_count(some[k][member] ^ found[k][at])
        keep = bits <= self.reach
        return member[keep], at[keep], bits[keep]

    def add(self, came: tuple[np.ndarray, np.ndarray, np.ndarray], at_home: np.ndarray, out: list) -> None:
        if at_home.any():
            self.home = tuple(np.concatenate([a, b[..., at_home]], axis=-1) for a, b in zip(self.home, came))
        ids, found, labels = self.home
        if len(ids) == 0:
            return
        step = 64 if len(ids) > 200 else max(64, 400_000 // len(ids))
        for i in range(0, len(came[0]), step):
            m_ids, m_found, m_labels = (x[..., i : i + step] for x in came)
            member, at, bits = self.near(m_found, found)
            keep = m_ids[member] != ids[at]
            if not keep.any():
                continue
            member, at, bits = member[keep], at[keep], bits[keep]
            a, b = self.roots(m_labels), self.roots(labels)
            keep = a[member] != b[at]
            member, at, bits = member[keep], at[keep], bits[keep]
            order = np.lexsort((ids[at], bits, member))
            for m, h, x, y in zip(m_ids[member[order]].tolist(), ids[at[order]].tolist(), m_labels[member[order]].tolist(), labels[at[order]].tolist()):
                if self.most is None:
                    x, y = self.find(x), self.find(y)
                    if x != y:
                        self.root[max(x, y)] = min(x, y)
                        out.append((m, h, False))
                elif self.used.get(m, 0) < self.most and self.used.get(h, 0) < self.most:
                    self.used[m], self.used[h] = self.used.get(m, 0) + 1, self.used.get(h, 0) + 1
                    out.append((m, h, False))
                else:
                    out.extend((x, x, True) for x in {m, h} - self.short)
                    self.short |= {m, h}


def _dealt(members: DataFrame, cover: Cover, prints: list[str], within: int) -> DataFrame:
    """members -> one row for each anchor that a fingerprint is copied to; away is 0 at home."""
    replica = pa.schema([("block", pa.int32()), ("anchor", pa.int64()), ("away", pa.int32()), *((n, pa.int64()) for n in ("id", "label", *prints))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                seed, ids, label, *found = (x.to_numpy(zero_copy_only=False) for x in batch.slice(i, 2000).columns)
                for b, parts in enumerate(cover.blocks):
                    row, key, beyond = anchors(found[0].view(np.uint64), parts, within)
                    yield rows(replica, block=(seed[row] * len(cover.blocks) + b).astype(np.int32), anchor=key.view(np.int64), away=(beyond > 0).astype(np.int32), id=ids[row], label=label[row], **{n: x[row] for n, x in zip(prints, found)})

    return members.select("seed", "id", "label", *prints).mapInArrow(run, f"block int, anchor long, away int, id long, label long, {', '.join(f'{n} long' for n in prints)}")


def candidates(members: DataFrame, cover: Cover, most: int | None = None, home_rows: int = HOME_ROWS) -> DataFrame:
    """members (MEMBER, any number of check columns) -> (a, b, more): pairs of different labels that
    meet at an anchor. Without most, those alone that join groups there; else up to most for each
    text and anchor, and for both texts of every pair left out a row (id, id) with more."""
    prints = ["fingerprint", *(n for n in members.columns if n.startswith("check"))]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, meeting = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block, key, part, away, ids, label, *found = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            came = (ids, np.array(found).view(np.uint64), label)
            out: list = []
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
            stop = np.r_[start[1:], len(key)]
            for s, e in zip(start.tolist(), stop.tolist()):
                if (name := (block[s], key[s], part[s])) != last:
                    # Those at home come first; with none there, nothing is compared.
                    last, meeting = name, _Meeting(most, len(prints)) if away[s] == 0 and (e - s > 1 or e == len(key)) else None
                if meeting is not None:
                    meeting.add(tuple(x[..., s:e] for x in came), away[s:e] == 0, out)
            if out:
                a, b, more = zip(*out)
                yield rows(schema, a=a, b=b, more=more)

    n = partitions(members.sparkSession)
    parts = F.ceil(F.col("count") / home_rows).cast("int")
    crowded = _dealt(members, cover, prints, 0).groupBy("block", "anchor").count().where(F.col("count") > home_rows).select("block", "anchor", parts.alias("parts"))
    # Written first: few rows, mostly none, whose size is known when the join is planned, so the copies move once.
    crowded = written(crowded, "crowded")
    dealt = _dealt(members, cover, prints, cover.within).join(crowded, ["block", "anchor"], "left")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    own = F.col("part") == F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("block", "anchor", "part", F.when(own, F.col("away")).otherwise(1).alias("away"), "id", "label", *prints)
    dealt = dealt.repartition(n, "block", "anchor", "part").sortWithinPartitions("block", "anchor", "part", "away")
    return dealt.mapInArrow(run, "a long, b long, more boolean").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "more").distinct()


def _joining(key: tuple, tile: pa.Table, similarity: float) -> tuple[list, list]:
    """The links between two tiles (or inside one) of a group that join their texts as all their links do."""
    ids, label, own, *found = (tile.column(n).to_numpy() for n in ("id", "label", "own", *SEEN))
    found = np.array(found).view(np.uint64)
    of = tile.column("shingles").combine_chunks()
    at, hashes = of.offsets.to_numpy(), of.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    meeting, out = _Meeting(None, len(SEEN)), []
    left, right = (np.flatnonzero(own == k) for k in key[1:])
    step = max(1, 400_000 // max(1, len(right)))
    for i in range(0, len(left), step):
        some = left[i : i + step]
        x, y, bits = meeting.near(found[:, some], found[:, right])
        x, y = some[x], right[y]
        least = np.minimum(size[x], size[y])
        roots = meeting.roots(label)
        # A pair can't have the similarity unless all of the smaller set could be in the larger one.
        keep = (roots[x] != roots[y]) & (least >= similarity * (size[x] + size[y] - least))
        x, y, bits = x[keep], y[keep], bits[keep]
        order = np.lexsort((ids[y], ids[x], bits))
        for m, h in zip(x[order].tolist(), y[order].tolist()):
            a, b = meeting.find(int(label[m])), meeting.find(int(label[h]))
            if a != b:
                shared = len(np.intersect1d(hashes[at[m] : at[m + 1]], hashes[at[h] : at[h + 1]], assume_unique=True))
                if shared >= similarity * (size[m] + size[h] - shared):
                    meeting.root[max(a, b)] = min(a, b)
                    out.append((int(ids[m]), int(ids[h])))
    return [a for a, _ in out], [b for _, b in out]


def links_inside(live: DataFrame, similarity: float, tile_rows: int = TILE_ROWS, tile_hashes: int = TILE_HASHES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """live (group, id, label, fingerprints, shingles) -> (a, b): links of the groups' texts that join
    them as all their links within reach do. A group is cut in tiles by hashes of the ids; every two
    tiles meet in one task, which holds no more than these."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            start = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            for s, e in zip(start.tolist(), [*start[1:].tolist(), batch.num_rows]):
                if (key := tuple(int(k[s]) for k in keys)) != last:
                    if held:
                        a, b = _joining(last, pa.Table.from_batches(held), similarity)
                        yield rows(schema, a=a, b=b)
                    last, held = key, []
                held.append(batch.slice(s, e - s))
        if held:
            a, b = _joining(last, pa.Table.from_batches(held), similarity)
            yield rows(schema, a=a, b=b)

    n = partitions(live.sparkSession)
    size = live.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.size("shingles").cast("long")).alias("hashes"))
    even = F.least(F.lit(int((2 * TILES_EACH * n) ** 0.5) + 1), F.ceil(F.col("n") / least_rows))
    tiles = F.greatest(even, F.ceil(F.col("n") / tile_rows), F.ceil(F.col("hashes") / tile_hashes)).cast("int")
    dealt = live.join(written(size.select("group", tiles.alias("tiles")), "tiles"), "group")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", "own", *SEEN, "shingles")
    dealt = dealt.repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(members: DataFrame, docs: DataFrame, width: int, similarity: float, cover: Cover) -> DataFrame:
    """members (id, row, fingerprints), docs (row, text) -> (id, label) of all that are in a group."""

    def turned(k: int) -> Column:
        return F.struct(*(F.col(SEEN[(k + j) % SEEDS]).alias(f"check_{j}" if j else "fingerprint") for j in range(SEEDS)))

    seed = F.posexplode(F.array(*(turned(k) for k in range(SEEDS))))

    def labelled(of: DataFrame, label: DataFrame | None) -> DataFrame:
        known = of.withColumn("label", F.col("id")) if label is None else of.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        return known.select("id", "label", seed.alias("seed", "x")).select("id", "seed", "label", "x.*")

    def texts(named: DataFrame) -> DataFrame:
        return docs.join(members.join(named, "id", "left_semi").select("row", F.col("id").alias("doc_id")), "row").select("doc_id", "text")

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        return judged(pairs, texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), width, similarity)

    def joined(label: DataFrame, pairs: DataFrame) -> DataFrame:
        """The labels with the links of the pairs: groups are stars already, so few rounds are left."""
        stars = label.select(F.col("id").alias("a"), F.col("label").alias("b"))
        return components(stars.unionByName(pairs.where("ok").select("a", "b")))

    # The first fingerprint alone, so that the others leave out what it has united.
    known = written(tested(candidates(labelled(members, None).where("seed = 0"), cover).select("a", "b")), "tested")
    label = components(known.where("ok"))
    fresh = written(tested(candidates(labelled(members, label).where("seed > 0"), cover).select("a", "b")), "tested")
    label, known = joined(label, fresh), known.unionByName(fresh)
    failed = known.where("not ok")
    if failed.isEmpty():
        return label
    group = written(components(known).withColumnRenamed("label", "group"), "groups")
    again = written(group.join(failed.select(F.col("a").alias("id")), "id", "left_semi").select("group").distinct(), "again")
    live = members.join(group.join(again, "group", "left_semi"), "id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    live = written(live.select("group", "id", "label", *SEEN), "live")
    sets = shingle_sets(texts(live.select("id")).dropDuplicates(["doc_id"]), width)
    fresh = written(links_inside(live.join(sets, "id"), similarity), "tested")
    return joined(label, fresh.withColumn("ok", F.lit(True)))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, cover: Cover | None = None) -> DataFrame:
    """docs (doc_id, text) -> (row, doc_id, fingerprint, component_id, kept_row), one row for each row
    of docs with an id: row tells it by id and text, component_id is the smallest id of its group of
    texts linked by the similarity, and kept_row the row of that id. Null and blank texts are copies
    of each other; rows without an id are left out; repeated rows give repeated results; an empty
    table an empty one; texts of any length count whole."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    found = written(seen(docs, width), "seen")
    # Numbers are given once and written; members are told apart by 128 bits, so hashes that meet unite nothing.
    members = found.groupBy("content").agg(F.min("row").alias("row"), *(F.min(n).alias(n) for n in SEEN))
    members = written(members.withColumn("id", F.monotonically_increasing_id()), "members")
    label = linked(members.drop("content"), docs.select(row_digest().alias("row"), "text"), width, similarity, cover or two_blocks())
    groups = members.select("content", "id").join(label, "id", "left").select("content", F.coalesce("label", "id").alias("label"))
    named = found.select("row", "doc_id", F.col(SEEN[0]).alias("fingerprint"), "content").join(groups, "content")
    first = named.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    return named.join(first, "label").select("row", "doc_id", "fingerprint", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept_row"))
