"""Filters of the catalogue and the JSON documents that are published from entries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_like


def machine_candidates(entries: DataFrame) -> DataFrame:
    """Entries without a text that neither a person nor an official source has claimed."""
    return entries.where(~F.coalesce("source", F.lit("")).isin("human", "pinned", "cn") & (F.coalesce("cn_text", F.lit("")) == ""))


def catalog_search(rows: DataFrame, key: str, titles: Sequence[str], needle: str, number: int, after: int, also: Column) -> DataFrame:
    """Rows after a key for which `also` holds and of which a title contains the needle or the key is the number."""
    hit = reduce(lambda a, b: a | b, (ascii_like(F.col(t), needle) for t in titles)) | (F.col(key) == number)
    return rows.where((F.col(key) > after) & also & hit)


def flat_json(entries: DataFrame, keys: Sequence[str], key: str, text: str, out: str = "body") -> DataFrame:
    """One JSON object of key and text for each group, keys in order; of a repeated key the largest text stays."""
    one = entries.groupBy(*keys, key).agg(F.max(F.coalesce(text, F.lit(""))).alias("__t"))
    return one.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__t"))))).alias(out))


def full_json(entries: DataFrame, keys: Sequence[str], key: str, text: str, source: str, ids: str, out: str = "body") -> DataFrame:
    """The same with {text, source, ids}; ids are left out where there are none."""
    value = F.struct(F.col(text).alias("text"), F.col(source).alias("source"), F.when(F.size(ids) > 0, F.col(ids)).alias("ids"))
    one = entries.groupBy(*keys, key).agg(F.max(value).alias("__v"))
    return one.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__v"))))).alias(out))


def search_index(groups: dict[str, DataFrame]) -> DataFrame:
    """(id, n, g, cn) of all groups in one table; cn only where it is filled and differs from the name."""
    parts = []
    for group, df in groups.items():
        parts.append(df.select(F.col("id").cast("bigint").alias("id"), "n", F.lit(group).alias("g"), F.when((F.col("cn") != "") & (F.col("cn") != F.col("n")), F.col("cn")).alias("cn")))
    return reduce(DataFrame.unionByName, parts)


def plain_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Trimmed filled lines of a text with their number."""
    each = rows.select(key, F.posexplode(F.split(text, "\n")).alias("n", "__l")).withColumn("line", F.regexp_replace("__l", r"^[ \t\r]+|[ \t\r]+$", ""))
    return each.where("line <> ''").select(key, "n", "line")


def html_paragraphs(rows: DataFrame, key: str, html: str) -> DataFrame:
    """Contents of the <p> elements of a page, tags removed."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    return rows.select(key, F.posexplode(found).alias("n", "__p")).select(key, "n", F.trim(F.regexp_replace("__p", r"<[^>]*>", "")).alias("line"))


def script_rows(rows: DataFrame, key: str, text: str, mark: str = ":") -> DataFrame:
    """Lines split at the first mark into speaker and body; without a mark the speaker is ''."""
    each = rows.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    at = F.locate(mark, F.col("line"))
    return each.select(key, "n", F.when(at > 0, F.substring(F.col("line"), F.lit(1), at - 1)).otherwise("").alias("speaker"), F.when(at > 0, F.substring(F.col("line"), at + len(mark), F.length("line"))).otherwise(F.col("line")).alias("body"))


def lyrics_status(draft: Column, published: Column, document: Column) -> Column:
    """none, draft, draft-published (another revision is published) or published."""
    both = draft.isNotNull() & published.isNotNull()
    return F.when(both & (draft == published), "published").when(both, "draft-published").when(draft.isNotNull() | document.isNotNull(), "draft").otherwise("none")


def searched(entries: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows of which a column contains the needle, case ignored."""
    return entries.where(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(needle.lower())) for c in columns)))


def narrowed(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values; a list admits several, None any."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return rows


def event_json(lines: DataFrame, event: str, episode: str, position: str, key: str, text: str, out: str = "body") -> DataFrame:
    """One JSON document for each event: episodes, and in each its texts by key, all in the order of
    their first position (not of their names). Texts are written as they are, but for what JSON escapes."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    name = lambda c: F.regexp_replace(quoted(F.coalesce(c, F.lit(""))), r"\]$", "")
    one = lines.groupBy(event, episode, key).agg(F.min(position).alias("__p"), F.max_by(text, position).alias("__t"))
    member = F.concat(name(F.col(key)), F.lit(":"), name(F.col("__t")))
    joined = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x["__m"]), ",")
    by_episode = one.withColumn("__m", member).groupBy(event, episode).agg(F.min("__p").alias("__first"), joined("__p", "__m").alias("__body"))
    of_episode = F.concat(name(F.col(episode)), F.lit(":{"), F.col("__body"), F.lit("}"))
    return by_episode.withColumn("__m", of_episode).groupBy(event).agg(F.concat(F.lit("{"), joined("__first", "__m"), F.lit("}")).alias(out))


def projection_matrix(entries: DataFrame, locales: dict[str, DataFrame], keys: Sequence[str], key: str) -> DataFrame:
    """(path, body) of all published documents: flat and full for every group, and flat for every
    locale's view of the entries."""
    at = lambda *parts: F.concat_ws("/", *parts)
    flat = flat_json(entries, keys, key, "cn_text").select(at(F.lit("flat"), *keys).alias("path"), "body")
    full = full_json(entries, keys, key, "cn_text", "source", "ids").select(at(F.lit("full"), *keys).alias("path"), "body")
    others = [flat_json(df, keys, key, "text").select(at(F.lit(locale), *keys).alias("path"), "body") for locale, df in locales.items()]
    return reduce(DataFrame.unionByName, [flat, full, *others])


def rebuilt(documents: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Published documents after the changed paths were built anew; a path that fresh lacks is gone."""
    kept = documents.join(changed.select(key), key, "left_anti")
    return kept.unionByName(fresh.join(changed.select(key), key, "left_semi"))


def script_dialogue(rows: DataFrame, key: str, text: str, mark: str = "：", within: str = r"\N") -> DataFrame:
    """Scripts as (key, n, speaker, sub, body, starts, ends): what stands before the first mark of a line
    is the speaker, bodies are cut at line breaks written as `within`, of several blank lines in a row
    the first stays."""
    from pyspark.sql import Window

    each = rows.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("__b", F.trim("line") == "")
    before = F.lag("__b").over(Window.partitionBy(key).orderBy("n"))
    kept = each.withColumn("__p", F.coalesce(before, F.lit(False))).where("not (__b and __p)")
    at = F.locate(mark, F.col("line"))
    said = kept.select(
        key, "n", F.when(at > 0, F.substring(F.col("line"), F.lit(1), at - 1)).otherwise("").alias("speaker"),
        F.when(at > 0, F.substring(F.col("line"), at + len(mark), F.length("line"))).when(F.col("__b"), "").otherwise(F.col("line")).alias("body"),
    )
    parts = said.withColumn("__s", F.split("body", "\\Q" + within + "\\E"))
    made = parts.select(key, "n", "speaker", F.size("__s").alias("__n"), F.posexplode("__s").alias("sub", "body"))
    return made.select(key, "n", "speaker", "sub", "body", (F.col("sub") == 0).alias("starts"), (F.col("sub") == F.col("__n") - 1).alias("ends"))
