"""Queries of projections, joins, set operations, windows and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_like, numeric_text_key, same_set
from ..operators import catalog, integrity, jobs, overlay, paging, projections, story, windows
from .relations import LOCALE, Tables, query

KEYS = overlay.KEYS


@query("SELECT category, field, jp_key, count(*) OVER () AS candidates FROM entries WHERE source NOT IN ('human', 'pinned', 'cn') AND cn_text = ''")
def p03_ai_candidates(t: Tables) -> DataFrame:
    found = projections.machine_candidates(t.entries)
    return found.select(*KEYS).crossJoin(F.broadcast(found.agg(F.count("*").alias("candidates"))))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 10 AND c_mktsegment = 'BUILDING' AND (lower(c_name) LIKE '%r#00000001%' OR c_custkey = 77)")
def p04_catalog_search(t: Tables) -> DataFrame:
    return projections.catalog_search(t.customer, "c_custkey", ["c_name"], "R#00000001", 77, 10, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("""
o AS (SELECT l.* FROM lines l LEFT JOIN (SELECT segment_id FROM localized WHERE text <> '') z USING (segment_id) WHERE z.segment_id IS NULL)
SELECT event_id, text, min_by(episode, episode || printf('%05d', position)) AS episode, min_by(position, episode || printf('%05d', position)) AS position, string_agg(segment_id, ',' ORDER BY segment_id) AS segments FROM o GROUP BY event_id, text""")
def p10_untranslated(t: Tables) -> DataFrame:
    found = story.untranslated_targets(t.lines, t.localized, LOCALE)
    return found.select("event_id", "text", "first.episode", "first.position", F.array_join("segments", ",").alias("segments"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS ids FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 20 <> 0)")
def p15_all_match(t: Tables) -> DataFrame:
    """G13."""
    aliases = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("alias"))
    known = t.part.where("p_partkey % 20 <> 0").select(F.col("p_partkey").cast("string").alias("alias"), F.col("p_partkey").cast("string").alias("id"))
    return catalog.all_resolved(aliases, known, "l_orderkey", "alias").withColumn("ids", F.array_join("ids", ","))


@query("""
s AS (SELECT o_orderkey, ['complete', 'game_only', 'draft'][o_orderkey % 3 + 1] AS state, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END AS d, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 END AS b FROM orders)
SELECT o_orderkey, CASE WHEN d IS NULL THEN false WHEN b IS NULL THEN true WHEN state IN ('complete', 'game_only') THEN d > b ELSE false END AS owned FROM s""")
def p21_ownership(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ("complete", "game_only", "draft"))), (k % 3 + 1).cast("int"))
    return t.orders.select(k, overlay.publication_owner(state, F.when(k % 7 != 0, k % 5), F.when(k % 11 != 0, k % 4)).alias("owned"))


@query("""
a AS (SELECT p_partkey, 1 AS c, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS listed FROM part UNION ALL SELECT -1, NULL, 1)
SELECT p_partkey, c IS NOT NULL AS in_catalog, listed FROM a WHERE c IS NULL OR listed <> 1""")
def p22_exactly_one(t: Tables) -> DataFrame:
    """U12."""
    mapped = t.part.where("p_partkey % 2 = 0").select("p_partkey").unionByName(t.spark.range(1).select(F.lit(-1).cast("bigint").alias("p_partkey")))
    return overlay.exactly_one(t.part, mapped, t.part.where("p_partkey % 3 = 0"), "p_partkey")


@query("""
l AS (SELECT o_custkey, o_orderkey * 7 % 100 AS v, lag(o_orderkey * 7 % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, coalesce(bool_and(before < v), true) AS rising FROM l GROUP BY o_custkey""")
def p23_rising(t: Tables) -> DataFrame:
    """I8."""
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") * 7 % 100).alias("v")))).alias("r"))
    return rows.select("o_custkey", overlay.strictly_rising(F.transform("r", lambda x: x["v"])).alias("rising"))


@query("SELECT category, field, jp_key, coalesce(o.text, '') AS text, coalesce(o.source, 'unknown') AS source FROM entries e LEFT JOIN overlay o USING (category, field, jp_key)")
def j01_overlay_left(t: Tables) -> DataFrame:
    """J1, J4."""
    return overlay.overlaid(t.entries, t.overlay, LOCALE).select(*KEYS, "text", "source")


@query("SELECT o.category, o.field, o.jp_key, o.text FROM overlay o ANTI JOIN entries USING (category, field, jp_key)")
def j02_orphans(t: Tables) -> DataFrame:
    return overlay.orphans(t.entries, t.overlay, LOCALE).select(*KEYS, "text")


@query("SELECT category, field, jp_key, coalesce(o.text, '') AS text, coalesce(o.source, 'unknown') AS source, e.p IS NULL AS orphan FROM entries e FULL JOIN overlay o USING (category, field, jp_key)")
def j03_with_orphans(t: Tables) -> DataFrame:
    return overlay.locale_view(t.entries, t.overlay, LOCALE)


_PAIRS = "a.jp_key = b.jp_key AND a.field = 'prefix' AND b.field = 'gacha' AND NOT (a.cn_text = '' AND a.source = 'unknown') AND (a.cn_text <> b.cn_text OR a.source <> b.source)"


@query(f"SELECT a.jp_key, a.cn_text AS from_text, a.source AS from_source, b.cn_text AS to_text, b.source AS to_source FROM pairs a JOIN pairs b ON {_PAIRS}")
def j04_propagation_pairs(t: Tables) -> DataFrame:
    return overlay.propagation_pairs(t.pairs, "cards", "prefix", "gacha")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j06_star_left(t: Tables) -> DataFrame:
    """J6, J20."""
    base = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return overlay.star(base, (t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"]), (t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])).select("o_orderkey", "c_name", "n_name")


@query("SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey")
def j07_latest_scalar(t: Tables) -> DataFrame:
    return overlay.latest_value(t.orders, "o_custkey", "o_orderstatus", ["o_orderkey"], "last_status")


@query("""
e AS (SELECT unnest([p_partkey % 50, p_size]) AS id, p_name, p_size, p_partkey FROM part)
SELECT id, p_name AS name FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_size DESC, p_partkey DESC) = 1""")
def j12_unnest_names(t: Tables) -> DataFrame:
    return overlay.exploded_names(t.part, F.array((F.col("p_partkey") % 50).cast("string"), F.col("p_size").cast("string")), "p_partkey", F.col("p_name"), "p_size")


@query("SELECT p_partkey AS id, p_name AS jp, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN '' ELSE upper(p_name) END AS cn FROM part")
def j13_pair_join(t: Tables) -> DataFrame:
    jp = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    cn = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name"), F.lit(1).alias("ord"))
    return overlay.paired(jp, cn, "id", "name", "ord")


@query("SELECT p_partkey, unnest(['brand', 'type']) AS field, unnest([p_brand, p_type]) AS text FROM part")
def j15_fields_long(t: Tables) -> DataFrame:
    return overlay.fields_long(t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), ["p_partkey"], ["brand", "type"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j24_semi(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)")
def j25_anti(t: Tables) -> DataFrame:
    """I2, J26, J27, J28."""
    return integrity.orphans(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.part.where("p_partkey % 5 <> 0"), ["l_partkey"], ["p_partkey"])


@query("SELECT p_partkey, p_brand, p_size, p_brand AS other_p_brand, (p_size + 1)::INTEGER AS other_p_size FROM part WHERE p_partkey % 4 = 0")
def j29_theta_mismatch(t: Tables) -> DataFrame:
    changed = t.part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("int").alias("p_size"))
    return overlay.mismatched(t.part, changed, "p_partkey", ["p_brand", "p_size"])


@query("SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT max(c_custkey) FROM customer) AS last_customer")
def j32_scalar_row(t: Tables) -> DataFrame:
    return overlay.one_row(t.orders.agg(F.count("*").alias("n_orders")), t.customer.agg(F.max("c_custkey").alias("last_customer")))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3)")
def j33_json_anti(t: Tables) -> DataFrame:
    return overlay.not_in_list(t.nation.select("n_nationkey", "n_name"), "n_nationkey", '["1","2","3","x"]')


@query("""
l AS (SELECT o_custkey, o_orderkey AS position, o_orderkey * 7 % 100 AS v, lag(o_orderkey * 7 % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, position, v FROM l WHERE v <= before""")
def j34_adjacent(t: Tables) -> DataFrame:
    return integrity.gaps(t.orders.select("o_custkey", F.col("o_orderkey").alias("position"), (F.col("o_orderkey") * 7 % 100).alias("v")), "o_custkey", "v")


@query("""
a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 6 <> 0), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey, CASE WHEN a.p_brand IS NULL THEN 'only_second' WHEN b.p_brand IS NULL THEN 'only_first' ELSE 'different' END AS problem FROM a FULL JOIN b USING (p_partkey) WHERE a.p_brand IS NULL OR b.p_brand IS NULL OR a.p_size <> b.p_size""")
def j38_drift(t: Tables) -> DataFrame:
    size = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return integrity.representation_differences(t.part.where("p_partkey % 6 <> 0"), t.part.where("p_partkey % 5 <> 0").withColumn("p_size", size), ["p_partkey"], ["p_brand", "p_size"])


@query("""
r AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(CASE WHEN turn % 2 = 0 THEN '~' || text ELSE text || ' x' END, ' ') AS b FROM conversations),
s AS (SELECT *, unnest(range(len(a))) AS position FROM r WHERE len(a) = len(b))
SELECT conv_id, turn, position::INTEGER AS position, a[position + 1] AS jp, b[position + 1] AS cn FROM s""")
def j39_zip_lines(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("a"), F.split(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("~"), "text")).otherwise(F.concat("text", F.lit(" x"))), " ").alias("b"))
    return overlay.zipped_lines(rows, ["conv_id", "turn"], "a", "b")


@query("""
s AS (SELECT p_partkey, p_partkey % 4 <> 0 AS ok FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT p_partkey, p_partkey % 10 = 0 AS gone FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, CASE WHEN gone IS NULL THEN 'source_only' WHEN gone THEN 'catalog_excluded' WHEN ok IS NULL OR NOT ok THEN 'unsupported' ELSE 'mapped' END AS class FROM s FULL JOIN c USING (p_partkey)""")
def j40_partition(t: Tables) -> DataFrame:
    """J43."""
    return overlay.partitioned(t.part.where("p_partkey % 3 <> 0"), t.part.where("p_partkey % 2 = 0"), "p_partkey", F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 10 == 0)


@query("SELECT p_name AS alias, coalesce(max(p_partkey * 10) FILTER (WHERE p_partkey % 3 = 0), max(p_partkey)) AS id FROM part GROUP BY p_name")
def j41_aliases(t: Tables) -> DataFrame:
    """J36."""
    own = t.part.select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("id"))
    return overlay.resolved_aliases([own, own.where("id % 3 = 0").withColumn("id", F.col("id") * 10)])


@query("SELECT category, field, jp_key FROM entries UNION ALL SELECT category, field, jp_key FROM overlay")
def u01_union_all(t: Tables) -> DataFrame:
    return t.entries.select(*KEYS).unionByName(t.overlay.select(*KEYS))


@query("SELECT category, field, jp_key FROM entries UNION SELECT category, field, jp_key FROM overlay")
def u02_union_distinct(t: Tables) -> DataFrame:
    return t.entries.select(*KEYS).unionByName(t.overlay.select(*KEYS)).distinct()


@query("SELECT category, field, jp_key, CASE WHEN o.text IS NOT NULL THEN 0 ELSE 1 END AS owner, coalesce(o.text, e.cn_text) AS text FROM overlay o FULL JOIN entries e USING (category, field, jp_key)")
def u08_priority_overlay(t: Tables) -> DataFrame:
    return overlay.first_owner([t.overlay, t.entries.withColumnRenamed("cn_text", "text")], KEYS, ["text"])


@query("SELECT source, lang, min_by(n_chars, doc_id) AS evidence, count(DISTINCT n_chars) > 1 AS ambiguous FROM documents GROUP BY source, lang")
def u09_first_observation(t: Tables) -> DataFrame:
    return overlay.first_observations(t.documents, ["source", "lang"], "doc_id", "n_chars")


@query("SELECT p_partkey, list_sort(list_distinct([p_partkey % 3, p_partkey % 5])) = list_sort(list_distinct([p_partkey % 5, p_partkey % 7])) AS same FROM part")
def u10_set_equality(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k, same_set(F.array(k % 3, k % 5), F.array(k % 5, k % 7)).alias("same"))


@query("SELECT column_name AS \"column\", value, n FROM (SELECT 'p_name' AS column_name, p_name AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2) WHERE n > 1")
def u11_repeated(t: Tables) -> DataFrame:
    return overlay.repeated(t.part, "p_name", "p_size")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w01_latest_row(t: Tables) -> DataFrame:
    return windows.latest_row(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""
g AS (SELECT c_custkey, c_mktsegment || c_nationkey % 5 AS grp, c_acctbal > 9500 AS whole FROM customer)
SELECT c_custkey, grp, CASE WHEN count(*) FILTER (WHERE whole) OVER w = 1 THEN max(CASE WHEN whole THEN c_custkey END) OVER w ELSE min(c_custkey) OVER w END AS anchor FROM g WINDOW w AS (PARTITION BY grp)""")
def w02_anchor(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey") % 5).alias("grp"), (F.col("c_acctbal") > 9500).alias("whole"))
    return windows.anchors(rows, "grp", "c_custkey", F.col("whole")).drop("whole")


@query("SELECT conv_id, turn, turn AS position, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(CASE WHEN turn % 3 = 0 THEN 1000 - turn END, 1000000), turn) - 1 AS new_position FROM conversations")
def w03_reorder(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.col("turn").alias("position"))
    return windows.reordered(rows, ["conv_id"], "turn", "position", rows.where("turn % 3 = 0").withColumn("place", F.lit(1000) - F.col("turn")))


@query("""
h AS (SELECT user_id, event_id, coalesce(value, 0) > 60 AS hit, sum((coalesce(value, 0) > 60)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
n AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM h)
SELECT user_id, min(CASE WHEN NOT hit AND n >= 3 THEN event_id END) AS stop FROM n GROUP BY user_id""")
def w04_streak_stop(t: Tables) -> DataFrame:
    return windows.streak_stop(t.events, "user_id", "event_id", F.coalesce("value", F.lit(0.0)) > 60)


@query("""
b AS (SELECT conv_id, turn, turn % 3 = 1 OR trim(text) = '' AS blank FROM conversations), l AS (SELECT *, lag(blank) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM b)
SELECT conv_id, turn, coalesce(before, false) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS stanza_break FROM l WHERE NOT blank""")
def w05_stanza(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("text", F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")))
    return windows.stanzas(rows, ["conv_id"], "turn", "text").select("conv_id", "turn", "stanza_break")


@query("""
b AS (SELECT conv_id, turn, turn % 4 IN (1, 2) OR trim(text) = '' AS blank FROM conversations), l AS (SELECT *, lag(blank) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM b)
SELECT conv_id, turn FROM l WHERE NOT blank OR NOT coalesce(before, false)""")
def w06_blank_runs(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("text", F.when((F.col("turn") % 4).isin(1, 2), " ").otherwise(F.col("text")))
    return windows.blank_runs_collapsed(rows, ["conv_id"], "turn", "text").select("conv_id", "turn")


@query("""
r AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'strong' WHEN 'O' THEN o_orderpriority ELSE '' END AS reason FROM orders)
SELECT o_custkey, coalesce(max_by(reason, o_orderkey) FILTER (WHERE reason = 'strong'), min_by(reason, o_orderkey) FILTER (WHERE reason NOT IN ('', 'strong')), '') AS reason FROM r GROUP BY o_custkey""")
def w07_settled_reason(t: Tables) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") == "F", "strong").when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise("")
    return windows.settled_reason(t.orders.withColumn("reason", reason), "o_custkey", "o_orderkey", "reason", ["strong"])


@query("""
k AS (SELECT source, doc_id % 3 AS tier, lang, n_chars, doc_id, max(doc_id % 3) OVER (PARTITION BY source) AS top FROM documents),
c AS (SELECT source, count(DISTINCT lang) > 1 AS conflict FROM k WHERE tier = top GROUP BY source)
SELECT source, tier, lang, n_chars, doc_id, conflict FROM k JOIN c USING (source) WHERE tier = top QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""")
def w09_tiered_pick(t: Tables) -> DataFrame:
    return windows.tiered_pick(t.documents.withColumn("tier", F.col("doc_id") % 3), ["source"], "tier", "lang", "n_chars", "doc_id")


@query("""
b AS (SELECT o_custkey, o_orderkey, o_orderstatus, coalesce(min((o_orderstatus <> 'F')::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS reached FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus = 'F' OR o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS stops FROM b WHERE reached = 1""")
def w10_fallback_chain(t: Tables) -> DataFrame:
    return windows.fallback_chain(t.orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") != "F").select("o_custkey", "o_orderkey", "stops")


@query("SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 7 AS batch FROM customer")
def w11_batches(t: Tables) -> DataFrame:
    return windows.batches(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], [F.col("c_custkey")], 7)


@query("""
l AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS previous, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, o_orderstatus, previous FROM l WHERE n > 1 AND o_orderstatus <> previous""")
def w12_changes(t: Tables) -> DataFrame:
    """Q16."""
    return windows.changes(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", [F.col("o_orderkey")], "o_orderstatus")


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INTEGER AS rank, c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_custkey > 10) > 50 AS more FROM customer WHERE c_custkey > 10 ORDER BY c_custkey LIMIT 50")
def o01_keyset(t: Tables) -> DataFrame:
    return paging.page(t.customer.select("c_custkey", "c_name"), "c_custkey", 10, 50)


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey < 20 OR (c_nationkey = 20 AND c_custkey > 5) ORDER BY c_nationkey DESC, c_custkey LIMIT 50")
def o03_keyset_mixed(t: Tables) -> DataFrame:
    return paging.mixed_page(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", (20, 5), 50)


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer ORDER BY rank LIMIT 50")
def o07_sort_modes(t: Tables) -> DataFrame:
    return paging.ranked(t.customer.select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 50)


@query("SELECT job_id, next_attempt_at FROM jobs WHERE state IN ('pending', 'retry_wait') AND next_attempt_at <= 500 ORDER BY next_attempt_at, job_id LIMIT 1")
def o08_queue_head(t: Tables) -> DataFrame:
    return jobs.head(t.jobs, 500).select("job_id", "next_attempt_at")


@query("SELECT p_partkey, row_number() OVER (ORDER BY coalesce(TRY_CAST(substr(p_type, 1, 3) AS INTEGER), 0), p_size, p_partkey)::INTEGER AS rank FROM part ORDER BY rank LIMIT 40")
def o09_numeric_text_sort(t: Tables) -> DataFrame:
    order = [numeric_text_key(F.substring("p_type", 1, 3)), F.col("p_size"), F.col("p_partkey")]
    return paging.ranked(t.part, order, 40).select("p_partkey", "rank")


@query("SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%supplier#00000000_%'")
def f40_ascii_like(t: Tables) -> DataFrame:
    return t.supplier.where(ascii_like(F.col("s_name"), "SUPPLIER#00000000_")).select("s_suppkey", "s_name")
