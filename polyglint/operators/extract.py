"""Joins that pair records of two editions of master data, field by field."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlay import fields_long


def paired_fields(jp: DataFrame, cn: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, key, jp, cn) for every filled field of a record and the other edition's text, '' where
    there is none or the same. Of a repeated id the largest text of a field counts."""
    one = lambda df, out: fields_long(df, [key], fields).groupBy(key, "field").agg(F.max(F.trim("text")).alias(out))
    both = one(jp, "jp").join(one(cn, "cn"), [key, "field"], "left").where("jp <> ''")
    return both.select("field", key, "jp", F.when(F.col("cn") == F.col("jp"), "").otherwise(F.coalesce("cn", F.lit(""))).alias("cn"))


def united(parts: dict[str, tuple[DataFrame, DataFrame, str, Sequence[str]]]) -> DataFrame:
    """paired_fields of several files (jp, cn, key, fields), each named in the column file; ids as texts."""
    made = (paired_fields(jp, cn, key, fields).select(F.lit(name).alias("file"), "field", F.col(key).cast("string").alias("id"), "jp", "cn") for name, (jp, cn, key, fields) in parts.items())
    return reduce(DataFrame.unionByName, made)


def alias_rows(documents: DataFrame, key: str, text: str, member: str = "musics") -> DataFrame:
    """(document, music_id, position, alias) of documents {member: [{music_id, aliases}]}."""
    schema = f"{member} array<struct<music_id:bigint,aliases:array<string>>>"
    each = documents.select(key, F.explode(F.from_json(text, schema)[member]).alias("m"))
    return each.select(key, F.col("m.music_id").alias("music_id"), F.posexplode("m.aliases").alias("position", "alias"))


def alias_problems(aliases: DataFrame, key: str) -> DataFrame:
    """Aliases that are blank, padded, hold control characters, or occur twice for one id."""
    n = aliases.groupBy(key, "music_id", "alias").agg(F.count("*").alias("n"))
    a = F.col("alias")
    problem = F.when(F.trim(F.coalesce(a, F.lit(""))) == "", "blank").when(a.rlike(r"\p{Cc}"), "control").when(a != F.trim(a), "padded").when(F.col("n") > 1, "repeated")
    return n.select(key, "music_id", "alias", problem.alias("problem")).where("problem is not null")
