"""JSON documents as sources of records, and the exchange of whole categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _objects(array: Column) -> Column:
    """JSON texts of the objects in a JSON array's text; other elements are left out."""
    return F.filter(F.from_json(array, "array<string>"), lambda x: x.startswith("{"))


def json_records(rows: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """Records of a document that is an array of objects."""
    each = rows.select(key, F.explode(_objects(F.col(text))).alias("__o"))
    return each.select(key, F.from_json("__o", schema).alias("__r")).select(key, "__r.*")


def json_member_records(rows: DataFrame, key: str, text: str, member: str, schema: str) -> DataFrame:
    """Records of an array that is one member of a document."""
    return json_records(rows.select(key, F.get_json_object(text, f"$.{member}").alias("__a")), key, "__a", schema)


def ordered_members(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Members of a document's object in the order in which they stand there: (key, position, name, value)."""
    return rows.select(key, F.posexplode(F.map_entries(F.from_json(text, "map<string,string>"))).alias("position", "__m")).select(key, "position", F.col("__m.key").alias("name"), F.col("__m.value").alias("value"))


def legacy_entries(full: DataFrame, flat: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Entries of the full form with the text of the flat one, which counts where both have it."""
    side = flat.select(*keys, F.col(text).alias("__t"))
    return full.join(side, list(keys), "left").select(*(F.coalesce("__t", F.col(text), F.lit("")).alias(text) if c == text else F.col(c) for c in full.columns))


def imported(current: DataFrame, incoming: DataFrame, group: str, source: str = "source") -> DataFrame:
    """Groups that come replace those there as a whole; a blank source becomes unknown."""
    clean = incoming.withColumn(source, F.coalesce(F.nullif(F.trim(F.col(source)), F.lit("")), F.lit("unknown")))
    return current.join(incoming.select(group).distinct(), group, "left_anti").unionByName(clean.select(*current.columns))


def set_problems(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of a seed or backup that are missing, and such that nobody expects."""
    e, f = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return e.join(f, list(keys), "left_anti").withColumn("problem", F.lit("missing")).unionByName(f.join(e, list(keys), "left_anti").withColumn("problem", F.lit("unexpected")))
