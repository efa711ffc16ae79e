"""Composition of components from ranked providers, failing closed on disagreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import fallback_chain, tiered_pick


def composed(parts: DataFrame, keys: Sequence[str], component: str, value: str, source: str, visible: str) -> DataFrame:
    """For each key and component the value of the smallest source key, if all sources agree on the
    visible text and on the value; else no value and conflict."""
    got = parts.where(F.col(value).isNotNull()).groupBy(*keys, component)
    out = got.agg(F.count_distinct(visible).alias("__t"), F.count_distinct(value).alias("__v"), F.min_by(value, source).alias(value), F.min(source).alias("owner"), F.count("*").alias("n_sources"))
    conflict = (F.col("__t") > 1) | (F.col("__v") > 1)
    return out.select(*keys, component, F.when(~conflict, F.col(value)).alias(value), F.when(~conflict, F.col("owner")).alias("owner"), "n_sources", conflict.alias("conflict"))


def with_base(base: DataFrame, parts: DataFrame, keys: Sequence[str], component: str, value: str) -> DataFrame:
    """Components that the base lacks from the composed parts; what the base has stays its own."""
    c = parts.where("not conflict").select(*keys, component, F.col(value).alias("__v"), F.col("owner").alias("__o"))
    both = base.select(*keys, component, value, F.lit(True).alias("__b")).join(c, [*keys, component], "full_outer")
    own = F.col("__b").isNotNull() & F.col(value).isNotNull()
    return both.select(*keys, component, F.coalesce(value, "__v").alias(value), F.when(own, "base").otherwise(F.col("__o")).alias("owner"))


def complete(parts: DataFrame, keys: Sequence[str], component: str, needed: Sequence[str]) -> DataFrame:
    """Whether all needed components are there without conflict."""
    have = F.collect_set(F.when(~F.col("conflict"), F.col(component)))
    return parts.groupBy(*keys).agg((F.size(F.array_except(F.array(*map(F.lit, needed)), have)) == 0).alias("complete"), F.bool_or("conflict").alias("conflict"))


def tier_of(provider: str, preferred: str):
    return F.when(F.col(provider) == preferred, 2).otherwise(1)


def fresh(parts: DataFrame, fetched: str, updated: str) -> DataFrame:
    """Parts that are not older than what they describe."""
    return parts.where(F.col(fetched) >= F.col(updated))


def picked(parts: DataFrame, keys: Sequence[str], provider: str, preferred: str, value: str, newest: str, name: str) -> DataFrame:
    return tiered_pick(parts.withColumn("tier", tier_of(provider, preferred)), keys, "tier", value, newest, name)


def preferred_view(parts: DataFrame, keys: Sequence[str], newest: str, name: str, values: Sequence[str]) -> DataFrame:
    """The newest view, of equally new ones the smallest name."""
    best = F.min_by(F.struct(newest, name, *values), F.struct(-F.col(newest), F.col(name)))
    return parts.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


#: Provider outcomes after which the next provider is asked (fixed values).
GOES_ON = ("not_found", "unavailable", "unsupported")


def replayed(outcomes: DataFrame, keys: Sequence[str], rank: str, outcome: str, whole: str) -> DataFrame:
    """Decision over providers in order: an outcome of GOES_ON, or a candidate whose composition is
    still incomplete, goes on; a complete candidate is taken; anything else fails."""
    allows = F.col(outcome).isin(*GOES_ON) | ((F.col(outcome) == "candidate") & ~F.col(whole))
    reached = fallback_chain(outcomes, keys, rank, allows)
    last = F.max_by(F.struct(outcome, whole), rank)
    out = reached.groupBy(*keys).agg(last.alias("__l"), F.count("*").alias("asked"), F.bool_or(F.col(outcome) == "candidate").alias("__some"))
    decision = F.when((F.col(f"__l.{outcome}") == "candidate") & F.col(f"__l.{whole}"), "complete").when(~F.col(f"__l.{outcome}").isin("candidate", *GOES_ON), "failed").when(F.col("__some"), "incomplete").otherwise("none")
    return out.select(*keys, "asked", decision.alias("decision"))
