"""Window-shaped operators: streaks, anchors, reordering, tiers, fallback chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def anchors(rows: DataFrame, group: str, key: str, full: Column) -> DataFrame:
    """Anchor of each group: its only full row, else its smallest key."""
    w = Window.partitionBy(group)
    n = F.count_if(full).over(w)
    only = F.max(F.when(full, F.col(key))).over(w)
    return rows.withColumn("anchor", F.when(n == 1, only).otherwise(F.min(key).over(w)))


def settled_reason(rows: DataFrame, group: str, order: str, reason: str, overwriting: Sequence[str]) -> DataFrame:
    """The reason of each group when rows are taken in order: some reasons overwrite what is there,
    others only fill an empty one, so it is the last overwriting one, else the first of the others."""
    strong = F.col(reason).isin(*overwriting)
    last = F.max_by(F.when(strong, F.col(reason)), F.when(strong, F.col(order)))
    weak = F.col(reason).isNotNull() & (F.col(reason) != "") & ~strong
    first = F.min_by(F.when(weak, F.col(reason)), F.when(weak, F.col(order)))
    return rows.groupBy(group).agg(F.coalesce(last, first, F.lit("")).alias("reason"))


def reordered(rows: DataFrame, keys: Sequence[str], key: str, position: str, wanted: DataFrame) -> DataFrame:
    """New positions from 0: listed keys first in the list's order (wanted: keys, key, place), then the rest in theirs."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("__p", F.lit(2**62)), F.col(position))
    joined = rows.join(wanted.select(*keys, key, F.col("place").cast("bigint").alias("__p")), [*keys, key], "left")
    return joined.withColumn("new_position", (F.row_number().over(w) - 1).cast("bigint")).drop("__p")


def streak_stop(rows: DataFrame, group: str, order: str, hit: Column, misses: int = 3) -> DataFrame:
    """The order value at which a run of misses in a row reaches its limit for the first time, null if never."""
    w = Window.partitionBy(group).orderBy(order)
    islands = rows.select(group, order, hit.alias("__h")).withColumn("__i", F.sum(F.col("__h").cast("int")).over(w))
    n = F.count_if(~F.col("__h")).over(Window.partitionBy(group, "__i").orderBy(order))
    return islands.withColumn("__n", n).groupBy(group).agg(F.min(F.when(~F.col("__h") & (F.col("__n") >= misses), F.col(order))).alias("stop"))


def stanzas(rows: DataFrame, keys: Sequence[str], position: str, text: str) -> DataFrame:
    """Filled lines with a mark where blank lines stood since the filled line before; never on the first."""
    blank = F.trim(text) == ""
    w = Window.partitionBy(*keys).orderBy(position)
    made = rows.withColumn("__b", blank).withColumn("__last", F.lag(F.col("__b")).over(w)).where("not __b")
    return made.withColumn("stanza_break", F.coalesce("__last", F.lit(False)) & (F.row_number().over(w) > 1)).drop("__b", "__last")


def blank_runs_collapsed(rows: DataFrame, keys: Sequence[str], position: str, text: str) -> DataFrame:
    """Only the first of blank lines in a row stays."""
    w = Window.partitionBy(*keys).orderBy(position)
    made = rows.withColumn("__b", F.trim(text) == "")
    return made.withColumn("__p", F.lag("__b").over(w)).where("not __b or not coalesce(__p, false)").drop("__b", "__p")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "n", start: int = 0) -> DataFrame:
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start).cast("bigint"))


def tiered_pick(rows: DataFrame, keys: Sequence[str], tier: str, value: str, newest: str, name: str) -> DataFrame:
    """Of the rows of the best (largest) tier the newest, of these the smallest name; conflict where
    rows of the best tier have different values."""
    top = rows.withColumn("__t", F.max(tier).over(Window.partitionBy(*keys))).where(F.col(tier) == F.col("__t"))
    best = F.min_by(F.struct(tier, value, newest, name), F.struct(-F.col(newest), F.col(name)))
    return top.groupBy(*keys).agg(best.alias("__b"), (F.count_distinct(value) > 1).alias("conflict")).select(*keys, "__b.*", "conflict")


def fallback_chain(outcomes: DataFrame, keys: Sequence[str], rank: str, allows: Column) -> DataFrame:
    """Outcomes that are reached: those before which every provider allowed to go on; stops marks the last."""
    w = Window.partitionBy(*keys).orderBy(rank)
    before = F.min(allows.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    reached = outcomes.withColumn("__a", F.coalesce(before, F.lit(1))).where("__a = 1").drop("__a")
    return reached.withColumn("stops", ~allows | (F.col(rank) == F.max(rank).over(Window.partitionBy(*keys))))


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Number of the batch of `size` rows that each row falls into."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("bigint"))


def changes(rows: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Rows whose value differs from the one before it; the first value of a key is its baseline."""
    w = Window.partitionBy(key).orderBy(*order)
    made = rows.withColumn("previous", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return made.where((F.col("__n") > 1) & ~F.col(value).eqNullSafe(F.col("previous"))).drop("__n")
