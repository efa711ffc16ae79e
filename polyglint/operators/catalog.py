"""Catalogue identity: classification by normalised title, fingerprints, signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import anchors

#: Words of version tags that exclude a title (fixed values).
MEDLEY = "メドレー"


def is_medley(title: Column) -> Column:
    """Titles that contain the Japanese word, or the token medley."""
    return F.contains(title, F.lit(MEDLEY)) | F.array_contains(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), "medley")


def reserved(text: Column, tokens: Sequence[str], substrings: Sequence[str]) -> Column:
    """Whether a disambiguator has a reserved token or contains a reserved word."""
    low = F.lower(text)
    return F.arrays_overlap(F.split(low, r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, tokens))) | F.exists(F.array(*map(F.lit, substrings)), lambda s: F.contains(low, s))


def numeric_version(token: Column) -> Column:
    return token.rlike(r"^(ver|version)\p{N}+$")


def fields(text: Column) -> Column:
    """Parts of an identity between white space and marks."""
    return F.filter(F.split(text, r"[\s|/／,，;；:=：\[\]{}()（）<>\"']+"), lambda x: x != "")


def has_field(text: Column, wanted: Column, suffixes: Sequence[str] = ("さん", "ちゃん", "くん", "様")) -> Column:
    """Whether a part is the wanted one, also with one of some suffixes."""
    tails = F.array(F.lit(""), *map(F.lit, suffixes))
    return F.exists(fields(text), lambda x: F.exists(tails, lambda t: x == F.concat(wanted, t)))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over a canonical JSON of identity columns (our own canonical form, version 1)."""
    named = [c.cast("string").alias(f"f{i}") for i, c in enumerate(columns)]
    return F.sha2(F.concat(F.lit("v1:"), F.to_json(F.struct(*(F.coalesce(c, F.lit("")).alias(f"f{i}") for i, c in enumerate(named))))).cast("binary"), 256)


def classified(rows: DataFrame, key: str, title: str, full: Column, medley: Column, instrumental: Column) -> DataFrame:
    """Rows grouped by normalised title with their anchor, disposition and reason.

    The anchor is the only full row or the smallest key. Medleys and instrumentals are unsupported; a
    group with several full rows conflicts; other rows of a group derive from the anchor.
    """
    made = anchors(rows.withColumn("__full", full), title, key, F.col("__full"))
    from pyspark.sql import Window

    many = F.count_if(F.col("__full")).over(Window.partitionBy(title)) > 1
    reason = F.when(many, "multiple_explicit_full_targets").when(instrumental, "unsupported_instrumental").when(medley, "unsupported_medley").when(F.col(key) == F.col("anchor"), "").otherwise("derived")
    made = made.withColumn("reason", reason)
    kind = F.when(F.col("reason") == "", "target").when(F.col("reason") == "derived", "derived").otherwise("review")
    return made.withColumn("disposition", kind).drop("__full")


def performer_ids(vocals: Column, preferred: str) -> Column:
    """Distinct sorted performer ids of the preferred vocal type, of any type where that has none;
    vocals is an array of struct<kind, id>."""
    pick = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(a, lambda v: v["id"]), lambda x: x > 0)))
    own = pick(F.filter(vocals, lambda v: v["kind"] == preferred))
    return F.when(F.size(own) > 0, own).otherwise(pick(vocals))


def credits_agree(scopes: Column) -> Column:
    """Role-bound credits (array of struct<role, found, wanted>): every scope with a role agrees and at least one does."""
    stated = F.filter(scopes, lambda s: s["wanted"].isNotNull() & (s["wanted"] != ""))
    return (F.size(stated) > 0) & F.forall(stated, lambda s: s["found"] == s["wanted"])


def verification(title: Column, restricted: Column, version: Column, credit: Column) -> Column:
    """Outcome of a candidate by ordered gates."""
    return F.when(~title, "title_mismatch").when(version, "excluded_version").when(restricted, "restricted").when(~credit, "credit_mismatch").otherwise("verified")


def classified_targets(candidates: DataFrame, targets: DataFrame, key: str, most: int) -> DataFrame:
    """Each target by its candidates: missing, ambiguous (too many, or two of one provider), error
    (one identity twice), fixed."""
    by_provider = candidates.groupBy(key, "provider").agg(F.count("*").alias("n"))
    a = candidates.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("identity").alias("identities"))
    b = by_provider.groupBy(key).agg(F.max("n").alias("most_of_one"))
    joined = targets.select(key).join(a, key, "left").join(b, key, "left")
    kind = F.when(F.col("n").isNull(), "missing").when((F.col("n") > most) | (F.col("most_of_one") > 1), "ambiguous").when(F.col("identities") < F.col("n"), "error").otherwise("fixed")
    return joined.select(key, F.coalesce("n", F.lit(0)).alias("candidates"), kind.alias("class"))


def routed(candidates: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """No candidate: none; one: fetch it; several: review."""
    n = candidates.groupBy(key).agg(F.count("*").alias("n"), F.min("identity").alias("only"))
    joined = targets.select(key).join(n, key, "left")
    route = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "fetch").otherwise("review")
    return joined.select(key, route.alias("route"), F.when(F.col("n") == 1, F.col("only")).alias("fetch_id"))


def first_variant(hits: DataFrame, key: str, variant: str, verified: Column) -> DataFrame:
    """Hits of the first query variant that has a verified one."""
    first = hits.where(verified).groupBy(key).agg(F.min(variant).alias("__v"))
    return hits.join(first, key).where(verified & (F.col(variant) == F.col("__v"))).drop("__v")


def all_resolved(aliases: DataFrame, known: DataFrame, page: str, alias: str) -> DataFrame:
    """Pages all of whose aliases are known, with the ids they stand for."""
    joined = aliases.join(known.select(F.col("alias").alias(alias), "id"), alias, "left")
    return joined.groupBy(page).agg(F.bool_and(F.col("id").isNotNull()).alias("__all"), F.array_sort(F.collect_set("id")).alias("ids")).where("__all").drop("__all")
