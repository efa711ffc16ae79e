"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs -> (id, label): label is the smallest id that can be reached.

    A large-star step links every neighbour above a node to the node's smallest neighbour, a
    small-star step links the node and its neighbours below to the smallest of these; both keep the
    components and never add edges beyond those there were. Between the two, paths are cut to half
    and less, so rounds grow with the logarithm of the longest path. It ends when a round changes
    nothing; then every node hangs on the smallest of its component. Each step is a shuffle with
    partial aggregation and a join by node that Spark splits where one node has many edges; the
    steps' results are written tables read again, so that plans and estimates begin anew. The
    driver only learns the number and the checksum of the edges. Loops, repeated edges and nulls
    are harmless; no edges give an empty result.
    """
    live = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    live = written(live.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(live)
    while state[0]:
        live, before = written(_small_star(_large_star(live)), "edges"), live
        removed(before)
        after = _state(live)
        if after == state:
            break
        state = after
    ends = live.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("id"), F.col("v").alias("label"))
    return live.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(ends)


def _state(live: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(live.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(live: DataFrame) -> DataFrame:
    """Edges (u > v) -> for every node, its neighbours above it linked to its smallest neighbour or itself."""
    least = live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    # A node without a neighbour below it is the smallest of its own star; its edges stay.
    joined = live.join(least, live.v == least.node, "left")
    return joined.select("u", F.coalesce("least", "v").alias("v")).distinct()


def _small_star(live: DataFrame) -> DataFrame:
    """Edges (u > v) -> every node and its neighbours below it linked to the smallest of these."""
    least = live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    joined = live.join(least, live.u == least.node)
    below = joined.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return below.unionByName(least.select(F.col("node").alias("u"), F.col("least").alias("v"))).distinct()
