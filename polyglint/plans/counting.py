"""Queries of counting, reconciliation and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import merged_ids
from ..operators import overlay, stats
from .relations import LOCALE, Tables, query

_COUNTS = """count(*) AS total, count(*) FILTER (WHERE source = 'cn') AS cn_count, count(*) FILTER (WHERE source = 'human') AS human_count, count(*) FILTER (WHERE source = 'pinned') AS pinned_count,
  count(*) FILTER (WHERE source = 'llm') AS llm_count, count(*) FILTER (WHERE source NOT IN ('cn', 'human', 'pinned', 'llm')) AS unknown_count"""


@query(f"SELECT category, field, {_COUNTS} FROM entries GROUP BY category, field")
def a01_category_counts(t: Tables) -> DataFrame:
    return stats.category_counts(t.entries)


@query(f"l AS (SELECT e.category, e.field, coalesce(o.source, 'unknown') AS source FROM entries e LEFT JOIN overlay o USING (category, field, jp_key)) SELECT category, field, {_COUNTS} FROM l GROUP BY category, field")
def a02_category_counts_locale(t: Tables) -> DataFrame:
    return stats.category_counts(overlay.overlaid(t.entries, t.overlay, LOCALE))


@query("""
n AS (SELECT event_id, count(DISTINCT episode) AS episode_count FROM lines GROUP BY event_id),
u AS (SELECT event_id, count(*) FILTER (WHERE coalesce(z.text, '') = '') AS untranslated, max(updated_at) AS last FROM lines l LEFT JOIN localized z USING (segment_id) GROUP BY event_id)
SELECT event_id, episode_count, untranslated, coalesce(last, event_id) AS last_updated FROM n JOIN u USING (event_id)""")
def a04_event_summary(t: Tables) -> DataFrame:
    stories = t.lines.select("event_id").distinct().withColumn("last_updated", F.col("event_id"))
    return stats.event_summary(stories, t.lines.select("event_id", "episode").distinct(), t.lines.drop("text"), t.localized, LOCALE)


@query("""
o AS (SELECT event_id, count(*) AS canonical, count(z.segment_id) AS matched, count(*) FILTER (WHERE z.text <> '') AS considered, count(*) FILTER (WHERE z.text <> '' AND z.source = 'cn') AS official FROM lines l LEFT JOIN localized z USING (segment_id) GROUP BY event_id)
SELECT *, matched = canonical AND considered > 0 AND considered = official AS all_official FROM o""")
def a05_official_state(t: Tables) -> DataFrame:
    return stats.official_state(t.lines.select("event_id", "segment_id"), t.localized.select("segment_id", "text", "source"), ["segment_id"])


@query("SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS latest_official, min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS first_machine, max(o_orderkey) AS largest FROM orders GROUP BY o_custkey")
def a06_conditional_extremes(t: Tables) -> DataFrame:
    return stats.conditional_extremes(t.orders, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


@query("SELECT l_orderkey, max(l_linenumber) AS revision, max(l_partkey) AS updated_at FROM lineitem GROUP BY l_orderkey")
def a07_latest_revision(t: Tables) -> DataFrame:
    return stats.versioned_max(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, max(l_linenumber) AS revision, max(l_partkey) AS updated_at FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) > 5")
def a08_having_revision(t: Tables) -> DataFrame:
    return stats.versioned_max(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey", above=5)


@query("""
a AS (SELECT l_orderkey, count(*) AS actual_count, sum(l_partkey)::BIGINT AS actual_total FROM lineitem GROUP BY l_orderkey),
d AS (SELECT o_orderkey AS l_orderkey, coalesce(actual_count, 0) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS n, coalesce(actual_total, 0) + CASE WHEN o_orderkey % 15 = 0 THEN 7 ELSE 0 END AS total FROM orders LEFT JOIN a ON o_orderkey = l_orderkey)
SELECT l_orderkey, n, total, coalesce(actual_count, 0) AS actual_count, coalesce(actual_total, 0) AS actual_total FROM d LEFT JOIN a USING (l_orderkey) WHERE n <> coalesce(actual_count, 0) OR total <> coalesce(actual_total, 0)""")
def a09_reconcile_links(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("c"), F.sum("l_partkey").alias("s"))
    k = F.col("l_orderkey")
    declared = t.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(a, "l_orderkey", "left").select(
        "l_orderkey", (F.coalesce("c", F.lit(0)) + F.when(k % 10 == 0, 1).otherwise(0)).alias("n"), (F.coalesce("s", F.lit(0)) + F.when(k % 15 == 0, 7).otherwise(0)).alias("total")
    )
    return stats.reconciled(declared, t.lineitem, "l_orderkey", "n", "total", "l_partkey")


@query("SELECT count(*) FILTER (WHERE l_linestatus = 'F') AS \"F_count\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O_count\", sum(l_suppkey)::BIGINT AS total_refs, count(DISTINCT l_orderkey) AS acquisitions, count(DISTINCT l_partkey) AS evidence FROM lineitem")
def a10_distinct_requests(t: Tables) -> DataFrame:
    return stats.coverage_rollup(t.lineitem, "l_linestatus", ("F", "O"), "l_suppkey", "l_orderkey", "l_partkey")


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS sum_l_linenumber, sum(l_suppkey)::BIGINT AS sum_l_suppkey FROM lineitem")
def a11_global_sums(t: Tables) -> DataFrame:
    return stats.global_sums(t.lineitem, ["l_linenumber", "l_suppkey"])


@query("""
a AS (SELECT o_orderstatus AS class, count(*) AS actual FROM orders GROUP BY 1), d AS (SELECT class, actual + CASE WHEN class = 'P' THEN 1 ELSE 0 END AS declared FROM a UNION ALL SELECT 'X', 5)
SELECT class, coalesce(actual, 0) AS actual, coalesce(declared, 0) AS declared FROM a FULL JOIN d USING (class) WHERE coalesce(actual, 0) <> coalesce(declared, 0)""")
def a12_class_counts(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("class"))
    declared = rows.groupBy("class").agg((F.count("*") + F.when(F.col("class") == "P", 1).otherwise(0)).alias("declared"))
    return stats.class_counts(rows, declared.unionByName(t.spark.range(1).select(F.lit("X").alias("class"), F.lit(5).cast("bigint").alias("declared"))))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a13_outcome_counters(t: Tables) -> DataFrame:
    """A25."""
    return stats.outcome_counters(t.orders, "o_orderpriority", "o_orderstatus", ("F", "O", "P")).toDF("o_orderpriority", "f", "o", "p")


@query("SELECT user_id, max(event_id) + 1 AS next_seq FROM events GROUP BY user_id")
def a14_next_seq(t: Tables) -> DataFrame:
    return stats.next_sequence(t.events, "user_id", "event_id")


@query("f AS (SELECT p_type, p_brand, min(p_partkey) AS o FROM part GROUP BY ALL) SELECT p_type, string_agg(p_brand, ',' ORDER BY o) AS brands FROM f GROUP BY p_type")
def a15_trace_ids(t: Tables) -> DataFrame:
    return stats.in_first_order(t.part, ["p_type"], "p_brand", "p_partkey", "brands").withColumn("brands", F.array_join("brands", ","))


@query("""
a AS (SELECT p_partkey, [(p_partkey % 3)::VARCHAR, 'a'] AS old, ['a', (p_partkey % 5)::VARCHAR] AS new FROM part)
SELECT p_partkey, array_to_string(list_concat(old, list_filter(new, lambda x: NOT list_contains(old, x))), ',') AS ids FROM a""")
def a16_merge_ids(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k, F.array_join(merged_ids(F.array((k % 3).cast("string"), F.lit("a")), F.array(F.lit("a"), (k % 5).cast("string"))), ",").alias("ids"))


@query("SELECT p_name, max_by(p_brand, p_partkey) AS p_brand, max_by(p_type, p_partkey) AS p_type FROM part GROUP BY p_name")
def a17_last_write_pairs(t: Tables) -> DataFrame:
    return stats.last_written(t.part, ["p_name"], "p_partkey", ["p_brand", "p_type"])


@query("d AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) SELECT l_partkey, min(l_orderkey) AS first_event, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS events FROM d GROUP BY l_partkey")
def a18_associations(t: Tables) -> DataFrame:
    return stats.associations(t.lineitem, "l_partkey", "l_orderkey").withColumn("events", F.array_join(F.col("events").cast("array<string>"), ","))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS signals FROM lineitem GROUP BY l_orderkey")
def a19_signals(t: Tables) -> DataFrame:
    found = stats.ordered_signals(t.lineitem, "l_orderkey", ["l_linenumber"], ["l_partkey"])
    return found.withColumn("signals", F.array_join(F.transform("signals", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ","))


@query("""
b AS (SELECT unnest(['en', 'de', 'xx', '(other)']) AS bucket), c AS (SELECT CASE WHEN lang IN ('en', 'de', 'xx') THEN lang ELSE '(other)' END AS bucket, count(*) AS n FROM documents GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)""")
def a21_reason_histogram(t: Tables) -> DataFrame:
    return stats.histogram(t.documents, "lang", ("en", "de", "xx"))


@query("SELECT p_name, count(DISTINCT p_brand) AS variants FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def a22_conflicting_ids(t: Tables) -> DataFrame:
    return stats.conflicting_ids(t.part, "p_name", "p_brand")


@query("""
n AS (SELECT p_brand, count(*) AS now FROM part WHERE p_partkey % 3 <> 0 AND p_brand <> 'Brand#11' GROUP BY 1), b AS (SELECT p_brand, count(*) AS before FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT p_brand, coalesce(now, 0) AS now, coalesce(before, 0) AS before FROM n FULL JOIN b USING (p_brand) WHERE coalesce(now, 0) < 50 OR coalesce(now, 0) < coalesce(before, 0)""")
def a23_coverage_gates(t: Tables) -> DataFrame:
    return stats.coverage_gates(t.part.where("p_partkey % 3 <> 0 and p_brand <> 'Brand#11'"), t.part.where("p_partkey % 2 = 0"), "p_brand", 50)


@query("SELECT event_id, episode, count(*) AS total, count(*) FILTER (WHERE position % 3 = 0) AS untranslated, min_by(text, position) AS first_title FROM lines GROUP BY ALL")
def a24_chapters(t: Tables) -> DataFrame:
    return stats.chapters(t.lines, "event_id", "episode", "position", "text", F.col("position") % 3 == 0)


@query("SELECT conv_id, sha256(string_agg(turn || '|' || role || '|' || text, chr(10) ORDER BY turn, role, text)) AS revision FROM conversations GROUP BY conv_id")
def a26_snapshot_revision(t: Tables) -> DataFrame:
    return stats.digest(t.conversations, ["conv_id"], ["turn"], ["role", "text"])


@query("SELECT conv_id, sha256(unhex(string_agg(printf('%016X', octet_length(encode(text))) || hex(encode(text)), '' ORDER BY turn, text))) AS revision FROM conversations GROUP BY conv_id")
def a27_framed_revision(t: Tables) -> DataFrame:
    return stats.framed_digest(t.conversations, ["conv_id"], "turn", "text")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_custkey % 9 = 0 AS protected FROM customer")
def a28_has_any(t: Tables) -> DataFrame:
    """A29, U4."""
    marked = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return stats.has_any(t.customer.select("c_custkey"), "c_custkey", marked, t.customer.where("c_custkey % 9 = 0"))


@query("SELECT event_id, episode, string_agg(text, ' / ' ORDER BY position) AS text FROM lines GROUP BY ALL")
def a29_ordered_text(t: Tables) -> DataFrame:
    """A30."""
    return stats.ordered_text(t.lines, ["event_id", "episode"], "position", "text", " / ")
