"""Integrity as queries for violations: an empty result means sound."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str]) -> DataFrame:
    """Rows whose parent does not exist; null keys refer to nothing."""
    p = parent.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(parent_key))).distinct()
    on = reduce(lambda a, b: a & b, (child[k] == p[f"__{i}"] for i, k in enumerate(child_key)))
    return child.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in child_key))).join(p, on, "left_anti")


def foreign_key_counts(named: dict[str, tuple[DataFrame, DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Number of orphans for each named foreign key."""
    return reduce(DataFrame.unionByName, (orphans(*x).agg(F.lit(n).alias("fk"), F.count("*").alias("violations")) for n, x in named.items()))


def digest_mismatches(rows: DataFrame, key: str, body: str, digest: str) -> DataFrame:
    return rows.where(F.sha2(F.col(body).cast("binary"), 256) != F.col(digest)).select(key)


def check_violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, check) for each row and each check that is false; a null result passes, as in SQL."""
    broken = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())))
    return rows.select(key, F.explode(broken).alias("check"))


def counter_differences(actual: DataFrame, declared: dict[str, int]) -> DataFrame:
    """(counter, actual, declared) where a one-row table of sums differs from what is declared."""
    parts = F.array(*(F.struct(F.lit(n).alias("counter"), F.col(n).cast("bigint").alias("actual"), F.lit(v).cast("bigint").alias("declared")) for n, v in declared.items()))
    return actual.select(F.explode(parts).alias("p")).select("p.*").where("actual <> declared")


def gaps(items: DataFrame, group: str, number: str) -> DataFrame:
    """Items whose number is not above the one before it."""
    w = Window.partitionBy(group).orderBy("position")
    return items.withColumn("__p", F.lag(number).over(w)).where(F.col(number) <= F.col("__p")).drop("__p")


def coverage_difference(items: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone."""
    a, b = items.select(key).distinct().withColumn("__a", F.lit(1)), catalog.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "not_covered").otherwise("not_in_catalog").alias("problem"))


def record_problems(rows: DataFrame, key: str, name: str, least: int) -> DataFrame:
    """Problems of a masterdata file: ids that aren't positive, blank names, repeated ids, too few records."""
    one = rows.select(F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(F.when(F.coalesce(F.col(key), F.lit(0)) <= 0, "bad_id"), F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "blank_name")))).alias("problem"))
    twice = rows.groupBy(F.col(key).cast("string").alias("id")).count().where("count > 1").select("id", F.lit("repeated_id").alias("problem"))
    few = rows.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit("").alias("id"), F.lit("too_few").alias("problem"))
    return one.unionByName(twice).unionByName(few)


def representation_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys at which two representations of one index differ, or that only one has."""
    right = b.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(1).alias("__b"))
    both = a.select(*keys, *columns, F.lit(1).alias("__a")).join(right, list(keys), "full_outer")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))
    return both.where(F.col("__a").isNull() | F.col("__b").isNull() | ~same).select(*keys, F.when(F.col("__a").isNull(), "only_second").when(F.col("__b").isNull(), "only_first").otherwise("different").alias("problem"))


def snapshot_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that went and rows that came, repeated ones counted."""
    return old.exceptAll(new).withColumn("side", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("side", F.lit("added")))


def immutability_violations(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the older snapshot that were changed or deleted."""
    right = new.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(1).alias("__b"))
    joined = old.select(key, *columns).join(right, key, "left")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))
    return joined.select(key, F.when(F.col("__b").isNull(), "deleted").when(~same, "updated").alias("problem")).where("problem is not null")


def json_violations(rows: DataFrame, key: str, json: str, required: dict[str, str]) -> DataFrame:
    """JSON columns that are invalid, or whose required paths are absent or no such type
    (text, integer): (key, problem)."""
    valid = F.try_parse_json(json).isNotNull()
    problems = [F.when(~valid, F.lit("invalid"))]
    for path, kind in required.items():
        value = F.get_json_object(json, path)
        ok = value.isNotNull() if kind == "text" else F.coalesce(value.rlike(r"^-?\d+$"), F.lit(False))
        problems.append(F.when(valid & ~ok, F.lit(path)))
    return rows.select(key, F.explode(F.array_compact(F.array(*problems))).alias("problem"))
