"""Append logs: sequences, fencing by epoch, replay and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def appended(log: DataFrame, heads: DataFrame, room: str, order: str) -> DataFrame:
    """New updates numbered on after each room's last sequence."""
    w = Window.partitionBy(room).orderBy(order)
    joined = log.join(heads.select(room, F.col("seq").alias("__h")), room, "left")
    return joined.withColumn("seq", (F.coalesce("__h", F.lit(0)) + F.row_number().over(w)).cast("bigint")).drop("__h")


def fenced(updates: DataFrame, rooms: DataFrame, room: str) -> DataFrame:
    """Updates of a room's current epoch; those of retired epochs or unknown rooms are rejected."""
    r = rooms.select(room, F.col("epoch").alias("__e"))
    return updates.join(r, room, "left").withColumn("accepted", F.coalesce(F.col("epoch") == F.col("__e"), F.lit(False))).drop("__e")


def bad_checksums(updates: DataFrame, payload: str, digest: str) -> DataFrame:
    return updates.where(F.sha2(F.col(payload).cast("binary"), 256) != F.col(digest))


def replayed(snapshots: DataFrame, updates: DataFrame, room: str, seq: str, payload: str) -> DataFrame:
    """A room's snapshot followed by its later updates, in order, as one text."""
    s = snapshots.select(room, F.col("seq").alias("__s"), F.col("body").alias("__b"))
    later = updates.join(s, room, "left").where(F.col(seq) > F.coalesce("__s", F.lit(0)))
    tail = later.groupBy(room).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, payload))), lambda x: x[payload]), "\n").alias("__t"), F.max(seq).alias("__m"))
    both = s.join(tail, room, "full_outer")
    return both.select(room, F.concat_ws("\n", "__b", "__t").alias("body"), F.coalesce("__m", "__s").alias("seq"))


def compacted(snapshots: DataFrame, updates: DataFrame, room: str, seq: str, payload: str, every: int) -> tuple[DataFrame, DataFrame]:
    """Rooms with at least `every` updates are folded into their snapshot: next snapshots, rest of the log."""
    due = updates.groupBy(room).agg(F.count("*").alias("n")).where(F.col("n") >= every).select(room)
    folded = replayed(snapshots.join(due, room, "left_semi"), updates.join(due, room, "left_semi"), room, seq, payload)
    kept = snapshots.select(room, "body", "seq").join(due, room, "left_anti")
    return kept.unionByName(folded.select(room, "body", "seq")), updates.join(due, room, "left_anti")


def retired(rooms: DataFrame) -> DataFrame:
    """All rooms start a new epoch."""
    return rooms.withColumn("epoch", F.col("epoch") + 1)


def checkpointed(ledger: DataFrame, commits: DataFrame, room: str) -> DataFrame:
    """commits (room, authority, base_revision) -> outcome: committed on the current revision, else why not."""
    l = ledger.select(room, F.col("authority").alias("__a"), F.col("revision").alias("__r"))  # noqa: E741
    joined = commits.join(l, room, "left")
    outcome = F.when(F.col("__r").isNull(), "not_found").when(F.col("__a") != F.col("authority"), "wrong_authority").when(F.col("__r") != F.col("base_revision"), "stale_base").otherwise("committed")
    return joined.select(room, outcome.alias("outcome"), (F.col("__r") + (outcome == "committed").cast("bigint")).alias("revision"))


def newest_generation(builds: DataFrame, track: str, generation: str) -> DataFrame:
    """Builds of the latest generation of each track; older ones discard themselves."""
    last = builds.groupBy(track).agg(F.max(generation).alias("__g"))
    return builds.join(last, track).where(F.col(generation) == F.col("__g")).drop("__g")
