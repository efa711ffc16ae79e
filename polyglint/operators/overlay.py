"""Localised projections, set operations and filters over entries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["category", "field", "jp_key"]


def overlaid(entries: DataFrame, localizations: DataFrame, locale: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every entry with its text and source in a locale ('' and unknown where there is none)."""
    own = localizations.where(F.col("locale") == locale).select(*keys, F.col("text").alias("__t"), F.col("source").alias("__s"))
    return entries.drop("source").join(own, list(keys), "left").select(*entries.drop("source").columns, F.coalesce("__t", F.lit("")).alias("text"), F.coalesce("__s", F.lit("unknown")).alias("source"))


def orphans(entries: DataFrame, localizations: DataFrame, locale: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Localisations whose entry is gone."""
    return localizations.where(F.col("locale") == locale).join(entries.select(*keys), list(keys), "left_anti")


def with_orphans(entries: DataFrame, localizations: DataFrame, locale: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both: a full outer join in which entries lead; orphan marks rows without an entry."""
    own = localizations.where(F.col("locale") == locale).select(*keys, F.col("text").alias("__t"), F.col("source").alias("__s"))
    base = entries.select(*keys).withColumn("__e", F.lit(True))
    return base.join(own, list(keys), "full_outer").select(*keys, F.coalesce("__t", F.lit("")).alias("text"), F.coalesce("__s", F.lit("unknown")).alias("source"), F.col("__e").isNull().alias("orphan"))


def locale_view(entries: DataFrame, localizations: DataFrame, locale: str, base_locale: str = "ja-JP", main_locale: str = "zh-CN") -> DataFrame:
    """The view of a locale: the key itself (source unknown, no orphans) in the base language, the
    entry's own text in the main one, else the overlay with its orphans."""
    if locale == base_locale:
        return entries.select(*KEYS, F.col("jp_key").alias("text"), F.lit("unknown").alias("source"), F.lit(False).alias("orphan"))
    if locale == main_locale:
        return entries.select(*KEYS, F.col("cn_text").alias("text"), "source", F.lit(False).alias("orphan"))
    return with_orphans(entries, localizations, locale)


def propagation_pairs(entries: DataFrame, category: str, from_field: str, to_field: str) -> DataFrame:
    """Keys of one category that stand in two fields with different texts: (jp_key, from_text, to_text).
    An empty text of unknown source is nothing to propagate."""
    own = entries.where(F.col("category") == category)
    a = own.where((F.col("field") == from_field) & ~((F.col("cn_text") == "") & (F.col("source") == "unknown"))).select("jp_key", F.col("cn_text").alias("from_text"), F.col("source").alias("from_source"))
    b = own.where(F.col("field") == to_field).select("jp_key", F.col("cn_text").alias("to_text"), F.col("source").alias("to_source"))
    return a.join(b, "jp_key").where((F.col("from_text") != F.col("to_text")) | (F.col("from_source") != F.col("to_source")))


def star(base: DataFrame, *sides: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Chained left joins of a base with its dimensions; Spark sends small sides to all tasks by itself."""
    return reduce(lambda df, s: df.join(s[0], list(s[1]), "left"), sides, base)


def latest(rows: DataFrame, key: str, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """The first row of each key by an order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, *values)


def latest_value(rows: DataFrame, key: str, value: str, order: Sequence[str], out: str) -> DataFrame:
    """One value of each key's largest row, by aggregation alone (no sort of the group)."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(out))


def exploded_names(rows: DataFrame, ids: Column, key: str, text: Column, order: str) -> DataFrame:
    """(id, name) for every numeric id of a row; of several rows with an id the last one counts."""
    each = rows.select(F.explode(ids).alias("id"), text.alias("name"), F.col(order).alias("__o"), F.col(key).alias("__k"))
    return each.withColumn("id", F.col("id").try_cast("bigint")).where("id is not null and name <> ''").groupBy("id").agg(F.max_by("name", F.struct("__o", "__k")).alias("name"))


def paired(jp: DataFrame, cn: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(jp key text, cn text) by a shared id; of repeated ids on the cn side the last one counts. A cn
    text equal to the jp one is ''; empty jp texts are dropped."""
    side = cn.groupBy(key).agg(F.max_by(text, order).alias("__c"))
    joined = jp.join(side, key, "left")
    jp_text, cn_text = F.trim(F.col(text)), F.trim(F.coalesce("__c", F.lit("")))
    return joined.where(jp_text != "").select(key, jp_text.alias("jp"), F.when(cn_text == jp_text, "").otherwise(cn_text).alias("cn"))


def nested_parts(jp: DataFrame, cn: DataFrame, id_col: str, parts: str, kind: str, bundle: str, name: str) -> DataFrame:
    """Names of nested parts paired by (id, kind, bundle); parts is an array of structs."""
    flat = lambda df, out: df.select(id_col, F.explode(parts).alias("p")).select(id_col, f"p.{kind}", f"p.{bundle}", F.col(f"p.{name}").alias(out))
    right = flat(cn, "cn").groupBy(id_col, kind, bundle).agg(F.max("cn").alias("cn"))
    return flat(jp, "jp").join(right, [id_col, kind, bundle], "left").withColumn("cn", F.coalesce("cn", F.lit("")))


def fields_long(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row for each filled field of a record."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields)))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.field", "p.text").where("text is not null and text <> ''")


def by_text(names: DataFrame, dictionary: DataFrame, text: str, out: str) -> DataFrame:
    """The dictionary's text for a name, null where there is none or the same."""
    side = dictionary.select(F.col("jp_key").alias(text), F.col("cn_text").alias("__c"))
    return names.join(side, text, "left").withColumn(out, F.when((F.col("__c") != "") & (F.col("__c") != F.col(text)), F.col("__c"))).drop("__c")


def mismatched(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of one key in both tables of which any attribute differs (null equals null)."""
    right = b.select(key, *(F.col(c).alias(f"other_{c}") for c in columns))
    differ = reduce(lambda x, y: x | y, (~F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in columns))
    return a.select(key, *columns).join(right, key).where(differ)


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    return reduce(lambda a, b: a.crossJoin(b), aggregates)


def not_in_list(rows: DataFrame, column: str, json_array: str) -> DataFrame:
    """Rows whose value is not an element of a JSON array given as a parameter."""
    listed = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json_array), "array<string>")).alias("__v"))
    return rows.join(F.broadcast(listed), rows[column].cast("string") == F.col("__v"), "left_anti")


def strictly_rising(a: Column) -> Column:
    """Whether each element of an array is larger than the one before it."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: x < y), lambda ok: ok)


def zipped_lines(rows: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Lines of two arrays paired by position, only where both have the same number."""
    same = rows.where(F.size(left) == F.size(right))
    return same.select(*keys, F.posexplode(F.transform(left, lambda x, i: F.struct(x.alias("jp"), F.get(F.col(right), i).alias("cn")))).alias("position", "p")).select(*keys, "position", "p.jp", "p.cn")


def partitioned(source: DataFrame, catalog: DataFrame, key: str, supported: Column, excluded: Column) -> DataFrame:
    """Keys of either side by class: mapped, source_only, unsupported or catalog_excluded."""
    s = source.groupBy(key).agg(F.max(supported).alias("__s"))
    c = catalog.groupBy(key).agg(F.max(excluded).alias("__x"))
    both = s.join(c, key, "full_outer")
    kind = F.when(F.col("__x").isNull(), "source_only").when(F.col("__x"), "catalog_excluded").when(F.col("__s").isNull() | ~F.col("__s"), "unsupported").otherwise("mapped")
    return both.select(key, kind.alias("class"))


def resolved_aliases(layers: Sequence[DataFrame]) -> DataFrame:
    """(alias, id) of all layers; later layers overwrite earlier ones."""
    all_ = reduce(DataFrame.unionByName, (df.select("alias", "id", F.lit(i).alias("__layer")) for i, df in enumerate(layers)))
    return all_.where("alias <> ''").groupBy("alias").agg(F.max_by("id", F.struct("__layer", "id")).alias("id"))


def first_owner(layers: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each key the row of the first layer that has it, with the layer's number as owner."""
    all_ = reduce(DataFrame.unionByName, (df.select(*keys, *values, F.lit(i).alias("owner")) for i, df in enumerate(layers)))
    return all_.groupBy(*keys).agg(F.min(F.struct("owner", *values)).alias("__v")).select(*keys, "__v.*")


def publication_owner(state: Column, database_revision: Column, bundle_revision: Column) -> Column:
    """Whether the database owns an entry: always where the bundle has none; complete and game_only
    entries only by a strictly newer revision; a draft never replaces a reviewed one."""
    return F.when(database_revision.isNull(), False).when(bundle_revision.isNull(), True).when(state.isin("complete", "game_only"), database_revision > bundle_revision).otherwise(False)


def first_observations(pages: DataFrame, keys: Sequence[str], order: str, evidence: str) -> DataFrame:
    """The first observation of each page and whether its observations disagree."""
    return pages.groupBy(*keys).agg(F.min_by(evidence, order).alias("evidence"), (F.count_distinct(evidence) > 1).alias("ambiguous"))


def exactly_one(catalog: DataFrame, mapped: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Catalogue keys that are in both or in neither of the two lists, and listed keys that are not in the catalogue."""
    m, x = mapped.select(key).distinct().withColumn("__m", F.lit(1)), excluded.select(key).distinct().withColumn("__x", F.lit(1))
    c = catalog.select(key).distinct().withColumn("__c", F.lit(1))
    all_ = c.join(m, key, "full_outer").join(x, key, "full_outer")
    n = F.coalesce("__m", F.lit(0)) + F.coalesce("__x", F.lit(0))
    return all_.where(F.col("__c").isNull() | (n != 1)).select(key, F.col("__c").isNotNull().alias("in_catalog"), n.alias("listed"))


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """Values that should be unique and are not, for each of the columns."""
    parts = [rows.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1") for c in columns]
    return reduce(DataFrame.unionByName, parts)
