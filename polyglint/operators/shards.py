"""Shards under two ceilings: items in order fill a shard until the next would pass a ceiling.

Each shard starts anew, so that where one ends depends on where it began. That is a function of the
position alone: prefix sums (of ranges, then within them) give for every position how far a shard that
starts there goes, and pointer jumping from the first one marks the positions where shards do start.
A shard's overhead holds its ordinal's digits, so that ordinals of 1, 2, 3, ... digits are walked one
after another. No step orders all items in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: A shard around its items (a fixed value of the format); N stands for the ordinal.
ENVELOPE = ('{"schemaVersion":1,"ordinal":', ',"items":[', "]}")
#: How many ceilings' worth of encoded bytes make a bucket of positions.
SPAN = 16


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(df: DataFrame) -> DataFrame:
    """A table with a row for each item, which joins meet sorted: sent to all tasks, it would pass through
    the driver in every round."""
    return df.hint("merge")


def overhead(digits: int) -> int:
    return sum(map(len, ENVELOPE)) + digits


def positions(items: DataFrame, order: str, encoded: str, raw: str) -> DataFrame:
    """(p, id, e, r): the item's place from 1, and its sums of encoded sizes (with a separator each) and of
    raw ones up to it; p = 0 comes before the first. Equal keys follow each other by size."""
    own = items.select(F.col(order).alias("id"), F.coalesce(F.col(encoded), F.lit(0)).cast("bigint").alias("e"), F.coalesce(F.col(raw), F.lit(0)).cast("bigint").alias("r"))
    ranged = _written(own.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "shard-items")
    sums = ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("e") + 1).alias("e"), F.sum("r").alias("r"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "e", "r")))
    upto = Window.partitionBy("part").orderBy("id", "e", "r").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.select("id", "part", F.count("*").over(upto).alias("p"), F.sum(F.col("e") + 1).over(upto).alias("e"), F.sum("r").over(upto).alias("r"))
    found = placed.join(F.broadcast(offsets), "part").select((F.col("p") + F.col("n0")).alias("p"), "id", (F.col("e") + F.col("e0")).alias("e"), (F.col("r") + F.col("r0")).alias("r"))
    first = items.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("p"), F.lit(None).cast(own.schema["id"].dataType).alias("id"), F.lit(0).cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("r"))
    return _written(found.unionByName(first), "shard-positions")


def _furthest(places: DataFrame, sums: str, ceiling: int, span: int) -> DataFrame:
    """For every p the last place whose sum is within `ceiling` of its own, as far as two buckets reach.

    Places are dealt by their encoded sum, each to its own bucket and the one before, and meet the
    questions sorted by the sum asked for."""
    home = F.floor(F.col("e") / span)
    there = places.select("p", F.col(sums).alias("v"), F.lit(0).alias("asks"), F.explode(F.array(home, home - 1)).alias("bucket"))
    asked = places.select("p", (F.col(sums) + ceiling).alias("v"), F.lit(1).alias("asks"), home.alias("bucket"))
    w = Window.partitionBy("bucket").orderBy("v", "asks", "p").rowsBetween(Window.unboundedPreceding, 0)
    met = there.unionByName(asked).withColumn("upto", F.last(F.when(F.col("asks") == 0, F.col("p")), ignorenulls=True).over(w))
    return met.where("asks = 1").select("p", "upto")


def _ends(places: DataFrame, digits: int, most_encoded: int, most_raw: int) -> DataFrame:
    """(p, upto): where a shard that starts after p ends, if its ordinal has so many digits; no row where
    the next item fits no shard or there is none."""
    room = most_encoded - overhead(digits) + 1  # the sums hold a separator too many
    span = max(1, SPAN * max(room, 1))
    a = _furthest(places, "e", room, span)
    b = _furthest(places, "r", most_raw, span).withColumnRenamed("upto", "by_raw")
    return a.join(_met(b), "p").select("p", F.least("upto", "by_raw").alias("upto")).where("upto > p")


def planned(items: DataFrame, order: str, encoded: str, raw: str, most_encoded: int, most_raw: int) -> tuple[DataFrame, DataFrame]:
    """(shards, unfit) of items in order.

    shards: ordinal, after and upto (its items are places after+1 to upto), n_items, encoded_bytes,
    raw_bytes, first_id, last_id. unfit: the id of an item that alone passes a ceiling; the shards before
    it are given, none behind it. No items, no shards."""
    places = positions(items, order, encoded, raw)
    n = places.agg(F.max("p")).first()[0]
    spark, starts, at, lo, digits = items.sparkSession, [], 0, 0, 1
    while at < n:
        hi = 10**digits
        jump = _written(_ends(places.where(F.col("p") >= at), digits, most_encoded, most_raw), "shard-ends")
        reached, step, top = spark.createDataFrame([(at, lo)], "p long, ordinal long"), 1, at
        while True:
            on = reached.join(_met(jump), "p").select(F.col("upto").alias("p"), (F.col("ordinal") + step).alias("ordinal")).where(F.col("ordinal") <= hi)
            reached = _written(reached.unionByName(on), "shard-starts")
            last = reached.agg(F.max("p").alias("p"), F.max("ordinal").alias("o")).first()
            if last["p"] in (top, n) or last["o"] >= hi:
                break
            top, step = last["p"], step * 2
            twice = jump.select(F.col("p").alias("from"), F.col("upto").alias("p")).join(_met(jump), "p")
            jump = _written(twice.select(F.col("from").alias("p"), "upto"), "shard-ends")
        starts.append(reached.withColumn("digits", F.lit(digits)))
        if last["p"] == n or last["o"] < hi:
            at = last["p"]
            break
        at, lo, digits = last["p"], hi, digits + 1
    if not starts:
        starts = [spark.createDataFrame([], "p long, ordinal long, digits int")]
    marks = starts[0]
    for more in starts[1:]:
        marks = marks.unionByName(more)
    # The ordinal that ends a walk of some digits starts the next one with more digits.
    marks = marks.groupBy("ordinal").agg(F.max("p").alias("p"), F.max("digits").alias("digits"))
    after = marks.select((F.col("ordinal") - 1).alias("ordinal"), F.col("p").alias("upto"))
    x, y = (places.select(F.col("p").alias(k), F.col("e").alias(f"e_{k}"), F.col("r").alias(f"r_{k}"), F.col("id").alias(f"id_{k}")) for k in ("after", "upto"))
    first = places.select((F.col("p") - 1).alias("after"), F.col("id").alias("first_id"))
    shards = marks.withColumnRenamed("p", "after").join(after, "ordinal").join(_met(x), "after").join(_met(y), "upto").join(_met(first), "after")
    frame = F.lit(sum(map(len, ENVELOPE))) + F.length(F.col("ordinal").cast("string")) - 1
    shards = shards.select(
        "ordinal", "after", "upto", (F.col("upto") - F.col("after")).alias("n_items"), (F.col("e_upto") - F.col("e_after") + frame).alias("encoded_bytes"),
        (F.col("r_upto") - F.col("r_after")).alias("raw_bytes"), "first_id", F.col("id_upto").alias("last_id"),
    )
    return shards, places.where((F.col("p") == at + 1) & F.lit(at < n)).select("id")


def sealed(items: DataFrame, order: str, body: str, raw: str, most_encoded: int, most_raw: int) -> tuple[DataFrame, DataFrame]:
    """planned() over items whose encoded size is their body's, with each shard's body and its SHA-256.

    Keys are unique here. A shard's body is at most most_encoded bytes, so it is put together in one row."""
    sized = items.select(F.col(order).alias("id"), F.octet_length(body).alias("e"), F.col(raw).alias("r"), F.col(body).alias("body"))
    shards, unfit = planned(sized, "id", "e", "r", most_encoded, most_raw)
    shards = _written(shards, "shard-plan")
    places = positions(sized, "id", "e", "r").select("p", "id")
    own = shards.select("ordinal", F.explode(F.sequence(F.col("after") + 1, F.col("upto"))).alias("p")).join(_met(places), "p").join(_met(sized.select("id", "body")), "id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "body"))), lambda x: x["body"]), ",")
    bodies = own.groupBy("ordinal").agg(F.concat(F.lit(ENVELOPE[0]), F.col("ordinal").cast("string"), F.lit(ENVELOPE[1]), joined, F.lit(ENVELOPE[2])).alias("body"))
    return shards.join(bodies, "ordinal").withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256)), unfit
