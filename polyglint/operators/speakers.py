"""Speakers of a scene resolved to the characters of a dimension, by rules in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("exact", "model", "part", "prefix")


def _names_in(text: Column, possessive: str) -> Column:
    """What can be a name in a text: all of it, and what stands before each possessive particle. No
    more than the longest name and one character is read, so long texts stay small."""
    pieces = F.split(F.substring(text, F.lit(1), F.col("longest") + 1), possessive)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), possessive)))


def resolved(lines: DataFrame, characters: DataFrame, models: DataFrame, separators: Sequence[str] = ("・", "＆"), possessive: str = "の", unknown: str = "？?") -> DataFrame:
    """lines (speaker, model, ...), characters (index, name), models (model, index) -> lines with the
    columns index and rule.

    The first rule that finds a character decides: the speaker is a name ("exact"); its model belongs
    to one ("model"); a part between separators is a name, or a name and the possessive particle
    ("part": the separators in the order given, the parts from the left); so is the whole ("prefix").
    Of several characters the one of the smallest index is taken. Speakers that are null, empty or
    only question marks stay without one, as do those that no rule finds; repeated lines are resolved
    alike.

    Each distinct speaker becomes the texts that can be names in it, with the rank of the rule, so
    all rules are one join by equality, whatever the number of characters, and the least rank counts.
    """
    rank = lambda rule, at, part: F.struct(F.lit(rule).alias("rule"), at.alias("at"), part.alias("part"))
    none = F.lit(0)
    asked = lines.select("speaker", "model").where(F.translate("speaker", unknown, "") != "").distinct()
    speaker = F.col("speaker")

    def named(text: Column, order: Column) -> Column:
        return F.transform(_names_in(text, possessive), lambda name: F.struct(order.alias("order"), name.alias("name")))

    def of_parts(place: int, separator: str) -> Column:
        parts = F.transform(F.split(speaker, separator), lambda part, i: named(part, rank(2, F.lit(place), i)))
        return F.when(F.contains(speaker, F.lit(separator)), F.flatten(parts)).otherwise(F.filter(named(speaker, rank(2, none, none)), lambda _: F.lit(False)))

    keys = F.concat(F.array(F.struct(rank(0, none, none).alias("order"), speaker.alias("name"))), *(of_parts(k, s) for k, s in enumerate(separators)), named(speaker, rank(3, none, none)))
    by_name = characters.groupBy("name").agg(F.min("index").alias("index"))
    by_model = models.groupBy("model").agg(F.min("index").alias("index"))
    # Names are looked up once for each speaker, however many models it comes with.
    longest = F.broadcast(characters.agg(F.coalesce(F.max(F.length("name")), F.lit(0)).alias("longest")))  # one row
    found = asked.select("speaker").distinct().crossJoin(longest).select("speaker", F.explode(keys).alias("key")).select("speaker", "key.*").join(by_name, "name").select("speaker", "order", "index")
    found = asked.join(found, "speaker").unionByName(asked.join(by_model, "model").select("speaker", "model", rank(1, none, none).alias("order"), "index"))
    best = found.groupBy("speaker", "model").agg(F.min(F.struct("order", "index")).alias("best"))
    rule = F.element_at(F.array(*map(F.lit, RULES)), F.col("best.order.rule") + 1)
    best = best.select(F.col("speaker").alias("__speaker"), F.col("model").alias("__model"), F.col("best.index").alias("index"), rule.alias("rule"))
    own = [c for c in lines.columns if c not in ("index", "rule")]
    joined = lines.select(*(F.col(f"`{c}`") for c in own)).join(best, F.col("speaker").eqNullSafe(F.col("__speaker")) & F.col("model").eqNullSafe(F.col("__model")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in own), "index", "rule")
