"""Counting, reconciliation and digest operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("cn", "human", "pinned", "llm")


def category_counts(entries: DataFrame, known: Sequence[str] = SOURCES) -> DataFrame:
    """Entries for each category and field, in all and by source; sources not listed count as unknown."""
    source = F.coalesce(F.col("source"), F.lit(""))
    by = [F.count_if(source == s).alias(f"{s}_count") for s in known]
    return entries.groupBy("category", "field").agg(F.count("*").alias("total"), *by, F.count_if(~source.isin(*known)).alias("unknown_count"))


def in_order(df: DataFrame, column: str, order: Sequence[str], out: str = "ord") -> DataFrame:
    """The position of a column's value in a fixed list, after it for others."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn(out, F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("bigint"))


def histogram(df: DataFrame, column: str, buckets: Sequence[str]) -> DataFrame:
    """Rows in each bucket of a closed list, zero where there is none, and those outside it as one more bucket."""
    spark = df.sparkSession
    known = spark.createDataFrame([(b,) for b in buckets], "bucket string")
    counted = df.groupBy(F.when(F.col(column).isin(*buckets), F.col(column)).otherwise("(other)").alias("bucket")).agg(F.count("*").alias("n"))
    zero = known.unionByName(spark.createDataFrame([("(other)",)], "bucket string"))
    return zero.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def reconciled(declared: DataFrame, links: DataFrame, key: str, count: str, total: str, amount: str) -> DataFrame:
    """Keys whose declared count or sum differs from that of their links; keys without links have 0."""
    actual = links.groupBy(key).agg(F.count("*").alias("actual_count"), F.sum(amount).alias("actual_total"))
    joined = declared.join(actual, key, "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("actual_count", "actual_total")})
    return joined.where((F.col(count) != F.col("actual_count")) | (F.col(total) != F.col("actual_total"))).select(key, count, total, "actual_count", "actual_total")


def class_counts(rows: DataFrame, declared: DataFrame, column: str = "class") -> DataFrame:
    """Classes whose number of rows is not the declared one, classes known to one side alone too."""
    actual = rows.groupBy(column).agg(F.count("*").alias("actual"))
    both = actual.join(declared, column, "full_outer").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("actual", "declared")})
    return both.where("actual <> declared")


def next_sequence(log: DataFrame, key: str, seq: str) -> DataFrame:
    return log.groupBy(key).agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq"))


def in_first_order(rows: DataFrame, keys: Sequence[str], value: str, order: str, out: str) -> DataFrame:
    """Distinct values for each key in the order in which they first appear; '' and '0' are no values."""
    kept = rows.where(F.col(value).isNotNull() & ~F.col(value).cast("string").isin("", "0"))
    first = kept.groupBy(*keys, value).agg(F.min(order).alias("__o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda x: x[value]).alias(out))


def last_written(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """For each key the values of the row that comes last."""
    last = F.max_by(F.struct(*values), F.struct(order, *values)).alias("__v")
    return rows.groupBy(*keys).agg(last).select(*keys, "__v.*")


def versioned_max(rows: DataFrame, key: str, revision: str, updated: str, above: int | None = None) -> DataFrame:
    """Largest revision and update time of each key (0 where none); above keeps keys beyond a revision."""
    out = rows.groupBy(key).agg(F.coalesce(F.max(revision), F.lit(0)).alias("revision"), F.coalesce(F.max(updated), F.lit(0)).alias("updated_at"))
    return out if above is None else out.where(F.col("revision") > above)


def conditional_extremes(rows: DataFrame, key: str, number: str, official: Column, machine: Column) -> DataFrame:
    """Latest official, first machine-made and largest number of each key."""
    return rows.groupBy(key).agg(F.max(F.when(official, F.col(number))).alias("latest_official"), F.min(F.when(machine, F.col(number))).alias("first_machine"), F.max(number).alias("largest"))


def global_sums(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in columns))


def associations(links: DataFrame, item: str, event: str) -> DataFrame:
    """Smallest and all distinct sorted events of each item."""
    return links.groupBy(item).agg(F.min(event).alias("first_event"), F.sort_array(F.collect_set(event)).alias("events"))


def ordered_signals(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], out: str = "signals") -> DataFrame:
    """All rows of a key as one array, ordered by columns."""
    fields = [*order, *(v for v in values if v not in order)]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))


def digest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], out: str = "revision") -> DataFrame:
    """Revision token: SHA-256 over the ordered rows, fields joined by '|', rows by a line feed."""
    fields = [*order, *(v for v in values if v not in order)]
    line = lambda x: F.concat_ws("|", *(F.coalesce(x[c].cast("string"), F.lit("")) for c in fields))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), line), "\n")
    return rows.groupBy(*keys).agg(F.sha2(body.cast("binary"), 256).alias(out))


def framed_digest(rows: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "revision") -> DataFrame:
    """The same over values that are each preceded by their length in bytes (eight bytes), so that no
    two different lists have one form."""
    framed = lambda x: F.concat(F.lpad(F.hex(F.octet_length(x[value]).cast("bigint")), 16, "0"), F.hex(x[value].cast("binary")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), framed), "")
    return rows.groupBy(*keys).agg(F.sha2(F.unhex(body), 256).alias(out))


def ordered_text(rows: DataFrame, keys: Sequence[str], position: str, text: str, separator: str = "", out: str = "text") -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), separator)
    return rows.groupBy(*keys).agg(joined.alias(out))


def has_any(base: DataFrame, key: str, *parts: DataFrame, out: str = "protected") -> DataFrame:
    """Whether any of the tables has a row for the key."""
    found = parts[0].select(key)
    for p in parts[1:]:
        found = found.unionByName(p.select(key))
    marks = found.distinct().withColumn("__m", F.lit(True))
    return base.join(marks, key, "left").withColumn(out, F.coalesce("__m", F.lit(False))).drop("__m")


def chapters(lines: DataFrame, event: str, episode: str, position: str, text: str, untranslated: Column) -> DataFrame:
    """Lines, untranslated lines and the first line's text of each episode."""
    return lines.groupBy(event, episode).agg(F.count("*").alias("total"), F.count_if(untranslated).alias("untranslated"), F.min_by(text, position).alias("first_title"))


def outcome_counters(rows: DataFrame, key: str, outcome: str, values: Sequence[str]) -> DataFrame:
    return rows.groupBy(key).agg(*(F.count_if(F.col(outcome) == v).alias(v) for v in values))


def coverage_rollup(items: DataFrame, state: str, states: Sequence[str], size: str, acquisition: str, evidence: str) -> DataFrame:
    """One row: counts of a closed list of states, sum of references, distinct acquisitions and evidence."""
    by = [F.count_if(F.col(state) == s).alias(f"{s}_count") for s in states]
    return items.agg(*by, F.coalesce(F.sum(size), F.lit(0)).alias("total_refs"), F.count_distinct(acquisition).alias("acquisitions"), F.count_distinct(evidence).alias("evidence"))


def conflicting_ids(refs: DataFrame, key: str, *attributes: str) -> DataFrame:
    """Keys that stand for more than one combination of attributes (nulls count as a value)."""
    same = F.to_json(F.struct(*attributes))
    return refs.groupBy(key).agg(F.count_distinct(same).alias("variants")).where("variants > 1")


def coverage_gates(current: DataFrame, previous: DataFrame, key: str, floor: int) -> DataFrame:
    """Files whose record count is below a floor or below the previous one, files that vanished too."""
    now = current.groupBy(key).agg(F.count("*").alias("now"))
    before = previous.groupBy(key).agg(F.count("*").alias("before"))
    both = now.join(before, key, "full_outer").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("now", "before")})
    return both.where((F.col("now") < floor) | (F.col("now") < F.col("before")))


def event_summary(stories: DataFrame, episodes: DataFrame, segments: DataFrame, localizations: DataFrame, locale: str) -> DataFrame:
    """Each story with the numbers of its episodes and of its untranslated segments in a locale, and
    the last update of a translation (else the story's own). Children are aggregated before the join."""
    texts = localizations.where(F.col("locale") == locale).select("segment_id", "text", F.col("updated_at").alias("__u"))
    done = segments.join(texts, "segment_id", "left")
    by = done.groupBy("event_id").agg(F.count_if(F.coalesce("text", F.lit("")) == "").alias("untranslated"), F.max("__u").alias("__last"))
    n = episodes.groupBy("event_id").agg(F.count("*").alias("episode_count"))
    joined = stories.join(n, "event_id", "left").join(by, "event_id", "left")
    return joined.select("event_id", F.coalesce("episode_count", F.lit(0)).alias("episode_count"), F.coalesce("untranslated", F.lit(0)).alias("untranslated"), F.coalesce("__last", "last_updated").alias("last_updated"))


def official_state(canonical: DataFrame, localized: DataFrame, keys: Sequence[str], official: str = "cn") -> DataFrame:
    """matched, considered and official segments of each event; all_official only where every
    canonical segment is matched and all considered ones are official."""
    joined = canonical.join(localized.withColumn("__m", F.lit(True)), list(keys), "left")
    out = joined.groupBy("event_id").agg(F.count("*").alias("canonical"), F.count_if(F.col("__m")).alias("matched"), F.count_if(F.col("__m") & (F.col("text") != "")).alias("considered"), F.count_if(F.col("__m") & (F.col("text") != "") & (F.col("source") == official)).alias("official"))
    return out.withColumn("all_official", (F.col("matched") == F.col("canonical")) & (F.col("considered") > 0) & (F.col("considered") == F.col("official")))
