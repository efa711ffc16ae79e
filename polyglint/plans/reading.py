"""Queries of sources, filters, scalars, comparisons of snapshots and the remaining ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import catalog, integrity, jobs, logs, merge, projections, stats, story
from ..sources import exchange
from .relations import LOCALE, Tables, query

KEYS = ["category", "field", "jp_key"]


@query("SELECT category, field, jp_key, cn_text, CASE WHEN category < 'Brand#3' AND p % 4 = 0 THEN 'unknown' ELSE source END AS source FROM entries")
def s02_category_import(t: Tables) -> DataFrame:
    current = t.entries.select(*KEYS, "cn_text", F.when(F.col("category") < "Brand#3", "old").otherwise(F.col("source")).alias("source"))
    incoming = t.entries.where("category < 'Brand#3'").select(*KEYS, "cn_text", F.when(F.col("p") % 4 == 0, " ").otherwise(F.col("source")).alias("source"))
    return exchange.imported(current, incoming, "category")


def _documents(t: Tables) -> DataFrame:
    record = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return t.part.groupBy("p_brand").agg(F.concat(F.lit('[7,"x",null,'), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("body"))


@query("SELECT p_brand, p_partkey AS id, p_name AS name FROM part")
def s03_json_records(t: Tables) -> DataFrame:
    return exchange.json_records(_documents(t), "p_brand", "body", "id long, name string")


@query("SELECT p_brand, p_partkey AS id, p_name AS name FROM part")
def s04_json_member_records(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"n":1,"costumes":'), F.col("body"), F.lit("}"))
    return exchange.json_member_records(_documents(t).withColumn("body", body), "p_brand", "body", "costumes", "id long, name string")


@query("SELECT category, field, jp_key, CASE WHEN p % 5 = 0 THEN '' WHEN p % 5 = 1 THEN 'full' ELSE cn_text END AS cn_text, source FROM entries")
def s08_legacy_entries(t: Tables) -> DataFrame:
    text = F.when(F.col("p") % 5 != 0, F.lit("full"))
    return exchange.legacy_entries(t.entries.select(*KEYS, text.alias("cn_text"), "source"), t.entries.where("p % 5 > 1"), KEYS, "cn_text")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position, 't' || turn AS name, (turn * 2)::VARCHAR AS value FROM conversations")
def s09_ordered_members(t: Tables) -> DataFrame:
    member = lambda x: F.concat(F.lit('"t'), x, F.lit('":"'), x * 2, F.lit('"'))
    bodies = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list("turn"), False), member), ","), F.lit("}")).alias("body"))
    return exchange.ordered_members(bodies, "conv_id", "body")


@query("""
e AS (SELECT DISTINCT p_brand, p_type, p_name FROM part WHERE p_partkey % 3 <> 0), f AS (SELECT DISTINCT p_brand, p_type, p_name FROM part WHERE p_partkey % 4 <> 0)
SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM f EXCEPT SELECT * FROM e)""")
def s11_set_problems(t: Tables) -> DataFrame:
    return exchange.set_problems(t.part.where("p_partkey % 3 <> 0"), t.part.where("p_partkey % 4 <> 0"), ["p_brand", "p_type", "p_name"])


@query("SELECT category, field, jp_key, cn_text, source FROM entries WHERE field < 'M' AND source IN ('cn', 'llm')")
def p01_entries(t: Tables) -> DataFrame:
    return projections.narrowed(t.entries.where("field < 'M'"), category=None, source=["cn", "llm"]).select(*KEYS, "cn_text", "source")


@query("SELECT category, field, jp_key, cn_text FROM entries")
def p02_flat(t: Tables) -> DataFrame:
    return t.entries.select(*KEYS, "cn_text")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p05_review_filter(t: Tables) -> DataFrame:
    return projections.narrowed(t.orders, o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'draft' ELSE 'none' END WHEN o_orderkey % 3 = 0 THEN 'draft' WHEN o_orderkey % 4 = o_orderkey % 7 THEN 'published' ELSE 'draft-published' END AS status FROM orders")
def p08_status(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = projections.lyrics_status(F.when(k % 5 != 0, k % 4), F.when(k % 3 != 0, k % 7), F.when(k % 2 == 0, k))
    return t.orders.select(k, status.alias("status"))


@query("SELECT segment_id, l.text AS ja, coalesce(nullif(z.text, ''), 'old') AS zh, coalesce(z.text, '') AS en FROM lines l LEFT JOIN localized z USING (segment_id)")
def p09_localized_text(t: Tables) -> DataFrame:
    rows = t.lines.select("segment_id", "text").join(t.localized.select("segment_id", F.col("text").alias("own")), "segment_id", "left")
    text = lambda locale: story.localized_text(locale, F.col("text"), F.col("own"), F.lit("old"))
    return rows.select("segment_id", text("ja-JP").alias("ja"), text("zh-CN").alias("zh"), text(LOCALE).alias("en"))


@query("SELECT category, field, jp_key, cn_text FROM entries WHERE contains(lower(jp_key), 'ar') OR contains(lower(cn_text), 'ar')")
def p12_search(t: Tables) -> DataFrame:
    return projections.searched(t.entries, "AR", "jp_key", "cn_text").select(*KEYS, "cn_text")


@query("SELECT category, field, jp_key FROM entries WHERE p % 10 = 3 AND p < 120")
def p13_related(t: Tables) -> DataFrame:
    wanted = F.array(*(F.lit(str(i)) for i in range(3, 120, 10)))
    return t.entries.where(F.arrays_overlap("ids", wanted)).select(*KEYS)


@query("""
o AS (SELECT event_id, count(*) AS canonical, count(z.segment_id) AS matched, count(*) FILTER (WHERE z.text <> '') AS considered, count(*) FILTER (WHERE z.text <> '' AND z.source = 'cn') AS official FROM lines l LEFT JOIN localized z USING (segment_id) GROUP BY event_id)
SELECT event_id FROM o WHERE NOT (matched = canonical AND considered > 0 AND considered = official)""")
def p14_without_official(t: Tables) -> DataFrame:
    state = stats.official_state(t.lines.select("event_id", "segment_id"), t.localized.select("segment_id", "text", "source"), ["segment_id"])
    return state.where("not all_official").select("event_id")


@query("SELECT doc_id, contains(text, 'ver') OR contains(text, 'mix') OR contains(text, 'a b') AS excluded FROM documents")
def p17_excluded_signal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalars.contains_any(F.col("text"), ["ver", "mix", "a b"]).alias("excluded"))


def _token(k: Column) -> Column:
    return F.when(k % 3 == 0, F.concat(F.lit("ver"), k)).when(k % 3 == 1, F.concat(F.lit("version"), k % 7)).otherwise("verse2")


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS numeric_version, p_partkey % 4 = 0 AS medley FROM part")
def f08_title_tokens(t: Tables) -> DataFrame:
    """F8, P16."""
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, "Summer [MEDLEY] 2").otherwise("medleys and more")
    return t.part.select(k, catalog.numeric_version(_token(k)).alias("numeric_version"), catalog.is_medley(title).alias("medley"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 2 AS found FROM supplier")
def f10_identity_field(t: Tables) -> DataFrame:
    """F9, F10."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("(lyrics)="), F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, F.concat("s_name", F.lit("さん"))).otherwise(F.concat("s_name", F.lit("x"))), F.lit("; y"))
    text = F.regexp_replace(text, "#", "")
    return t.supplier.select(k, catalog.has_field(text, F.regexp_replace("s_name", "#", "")).alias("found"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || '-cn' END AS paired, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS safe, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS filled FROM part")
def f14_pair_texts(t: Tables) -> DataFrame:
    """F13, F14, F19."""
    k, name = F.col("p_partkey"), F.col("p_name")
    cn = F.when(k % 8 == 0, F.concat(F.lit("　"), name, F.lit(" "))).when(k % 4 == 0, None).otherwise(F.concat(F.lit(" "), name, F.lit("-cn")))
    safe = F.when(k % 3 == 0, " - ").otherwise(F.concat(name, F.lit("　")))
    filled = scalars.first_filled(F.when(k % 2 == 0, F.col("p_brand")), F.lit(" "), name)
    return t.part.select(k, scalars.pair_text(name, cn).alias("paired"), scalars.safe_text(safe).alias("safe"), filled.alias("filled"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE 'game' END AS version FROM orders")
def f18_vote(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    a, b = F.when(k == 0, "full").when(k == 3, "game").when(k == 1, "full"), F.when(k == 0, "full").when(k == 1, "game").when(k == 2, "")
    return t.orders.select("o_orderkey", scalars.vote(a, b).alias("version"))


@query("SELECT c_custkey, c_mktsegment || chr(31) || CASE WHEN c_custkey % 2 = 0 THEN '?' ELSE c_name END || chr(31) || '?' AS work, split_part(replace(c_name, '#', '_'), '_', 1) AS speaker FROM customer")
def f24_work_key(t: Tables) -> DataFrame:
    """F24, F38."""
    name = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", scalars.work_key(F.col("c_mktsegment"), name, F.lit(None).cast("string")).alias("work"), scalars.speaker_of(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("speaker"))


@query(r"SELECT c_custkey, coalesce(nullif(rtrim(substr(trim(regexp_replace(lower(v), '[^a-z0-9]+', '_', 'g'), '_'), 1, 12), '_'), ''), 'unknown_error') AS code FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '?!' ELSE '-' || c_name || ' Failed' END AS v FROM customer)")
def f28_error_code(t: Tables) -> DataFrame:
    v = F.when(F.col("c_custkey") % 5 == 0, "?!").otherwise(F.concat(F.lit("-"), F.col("c_name"), F.lit(" Failed")))
    return t.customer.select("c_custkey", scalars.error_code(v, 12).alias("code"))


@query("SELECT conv_id, string_agg(CASE WHEN turn % 3 = 2 THEN '' ELSE '<&' || turn END, '|' ORDER BY turn) AS texts FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) GROUP BY conv_id")
def f41_batch_reply(t: Tables) -> DataFrame:
    n = F.count("*").cast("int")
    part = lambda i: F.when(i % 3 != 2, F.concat(F.lit('<t id="'), i, F.lit('">'), scalars.xml_escaped(F.concat(F.lit("<&"), i)), F.lit("</t>"))).otherwise("")
    sized = t.conversations.groupBy("conv_id").agg(n.alias("n"))
    reply = F.array_join(F.transform(F.reverse(F.sequence(F.lit(0), F.col("n") - 1)), part), "\n")
    return sized.select("conv_id", F.array_join(scalars.batch_reply(reply, F.col("n")), "|").alias("texts"))


@query("SELECT c_custkey, rank, component, value FROM (SELECT c_custkey, 0 AS rank, 'segment' AS component, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 1, 'name', c_name FROM customer WHERE c_custkey % 3 <> 0)")
def n18_components(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), F.lit("").alias("none"))
    return story.components(rows, "c_custkey", {"segment": "c_mktsegment", "name": "c_name", "none": "none"})


@query("SELECT segment_id, CASE WHEN position % 4 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN position % 2 = 0 THEN 'new' WHEN position % 4 = 0 THEN NULL ELSE 'r' || position END AS ruby FROM lines")
def n14_kept_ruby(t: Tables) -> DataFrame:
    p = F.col("position")
    saved = t.lines.select("segment_id", F.when(p % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(p % 2 == 0, "new").alias("ruby"))
    return story.kept_ruby(saved, t.lines.select("segment_id", "text", F.concat(F.lit("r"), p).alias("ruby")), ["segment_id"])


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn DESC) AS lines FROM conversations GROUP BY conv_id")
def n19_projected_lines(t: Tables) -> DataFrame:
    full = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("full"))
    game = F.reverse(F.sequence(F.lit(0), F.size("full") - 1))
    return full.select("conv_id", F.array_join(story.projected_lines(game, F.col("full")), "|").alias("lines"))


@query("SELECT DISTINCT event_id, episode, CASE WHEN event_id % 4 = 0 THEN 'absent' WHEN event_id % 4 = 1 THEN 'digest' ELSE 'coverage' END AS reason FROM lines WHERE event_id % 4 <> 3")
def n10_missing_scenarios(t: Tables) -> DataFrame:
    episodes = t.lines.select("event_id", "episode").distinct()
    k, body = F.col("event_id"), F.concat_ws(":", "event_id", "episode")
    scenarios = episodes.where(k % 4 != 0).select("event_id", "episode", body.alias("json"), F.when(k % 4 == 1, "bad").otherwise(F.sha2(body.cast("binary"), 256)).alias("sha256"))
    return story.missing_scenarios(episodes, scenarios, episodes.where(k % 4 != 2).withColumn("complete", F.lit(True)))


@query("""
u AS (SELECT category, field, jp_key, CASE WHEN p % 2 = 0 THEN cn_text ELSE 'edit' END AS text, source, p FROM entries UNION ALL SELECT category, field, jp_key || '?', 'edit', source, NULL FROM entries WHERE p % 9 = 0)
SELECT category, field, jp_key, text, source, CASE WHEN p IS NULL THEN 'not_found' WHEN p % 2 = 0 THEN 'noop' ELSE 'ok' END AS outcome FROM u""")
def m04_single_update(t: Tables) -> DataFrame:
    own = t.entries.select(*KEYS, F.when(F.col("p") % 2 == 0, F.col("cn_text")).otherwise("edit").alias("text"), "source")
    unknown = t.entries.where("p % 9 = 0").select("category", "field", F.concat("jp_key", F.lit("?")).alias("jp_key"), F.lit("edit").alias("text"), "source")
    return merge.single_update(t.entries, own.unionByName(unknown))


@query("SELECT o_orderkey, 'unknown_identity' AS problem FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'repeated_identity' FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 'bad_source' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, p FROM orders, (VALUES ('unknown_identity'), ('bad_source')) v(p) WHERE o_orderkey % 10 = 0 AND CASE p WHEN 'bad_source' THEN o_orderstatus = 'P' ELSE o_orderkey % 6 = 0 END")
def m06_batch_problems(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("source"))
    return merge.batch_problems(rows.where("o_orderkey % 6 <> 0"), rows.unionByName(rows.where("o_orderkey % 10 = 0")), ["o_orderkey"], ["F", "O"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'inserted' WHEN o_orderkey % 5 = 0 THEN 'archived' ELSE 'kept' END AS outcome FROM orders WHERE o_orderkey % 15 <> 0")
def m13_reconciled_segments(t: Tables) -> DataFrame:
    """M15."""
    return merge.reconciled_segments(t.orders.where("o_orderkey % 3 <> 0"), t.orders.where("o_orderkey % 5 <> 0"), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS text, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN 'human' ELSE 'llm' END AS source, c_custkey % 4 + CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 = 0 THEN 1 ELSE 0 END AS revision FROM customer")
def m14_promoted(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(k, F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("text"), F.when(k % 5 == 0, "human").otherwise("llm").alias("source"), (k % 4).alias("revision"))
    return merge.promoted(rows, rows.where(k % 3 == 0), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM customer WHERE c_custkey % 7 <> 0 OR (c_custkey % 3 <> 0 AND c_custkey % 2 = 0)")
def m15_guarded_replace(t: Tables) -> DataFrame:
    """M11."""
    version = lambda name: t.customer.select("c_custkey", F.lit(name).alias("version"))
    return merge.guarded_replace(version("old").where("c_custkey % 7 <> 0"), version("new").where("c_custkey % 2 = 0"), t.customer.where("c_custkey % 3 = 0"), "c_custkey")


@query("SELECT c_custkey, 'm' AS text, CASE WHEN c_custkey % 7 = 0 THEN 'not_found' WHEN c_custkey % 2 = 0 THEN 'filled' WHEN c_custkey % 3 = 0 THEN 'source_changed' ELSE 'applied' END AS outcome FROM customer")
def m16_still_open(t: Tables) -> DataFrame:
    """M13."""
    k = F.col("c_custkey")
    targets = t.customer.where(k % 7 != 0).select(k, F.when(k % 2 == 0, "there").otherwise("").alias("text"), F.col("c_name").alias("source_text"))
    results = t.customer.select(k, F.lit("m").alias("text"), F.when(k % 3 == 0, "then").otherwise(F.col("c_name")).alias("source_text"))
    return merge.still_open(targets, results, "c_custkey")


@query("SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN 'gone' WHEN c_custkey % 3 = 0 THEN 'changed' WHEN c_mktsegment = 'BUILDING' THEN 'retry' ELSE 'kept' END AS outcome FROM customer")
def m24_resumed(t: Tables) -> DataFrame:
    """M31."""
    k = F.col("c_custkey")
    now = t.customer.where(k % 7 != 0).select(k, F.when(k % 3 == 0, "x").otherwise(F.col("c_name")).alias("c_name"))
    return merge.resumed(t.customer.select(k, "c_name", "c_mktsegment"), now, "c_custkey", ["c_name"], "c_mktsegment", ["BUILDING"])


@query("SELECT l_orderkey, l_partkey AS evidence, position, position % 3 = 0 AS repaired FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS position FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))")
def m25_repaired_links(t: Tables) -> DataFrame:
    """M30."""
    artifacts = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    links = artifacts.select("l_orderkey", F.posexplode("refs").alias("position", "evidence")).where("position % 3 <> 0")
    return merge.repaired_links(artifacts, links, "l_orderkey", "refs")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS n FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 4 = 0 OR c_custkey % 3 = 0)")
def m26_exclusion_problems(t: Tables) -> DataFrame:
    """M29."""
    rows = t.customer.select("c_custkey", "c_name")
    there = rows.where("c_custkey % 4 = 0 or c_custkey % 3 <> 0").unionByName(rows.where("c_custkey % 4 = 0"))
    return merge.exclusion_problems(there, rows.where("c_custkey % 2 = 0"), "c_custkey", "c_name")


@query("SELECT s_suppkey, c % 5 AS v, side FROM (SELECT s_suppkey, s_suppkey AS c, 'removed' AS side FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, s_suppkey + 1, 'added' FROM supplier WHERE s_suppkey % 4 = 0)")
def i13_snapshot_differences(t: Tables) -> DataFrame:
    """I13."""
    k = F.col("s_suppkey")
    return integrity.snapshot_differences(t.supplier.select(k, (k % 5).alias("v")), t.supplier.select(k, F.when(k % 4 == 0, (k + 1) % 5).otherwise(k % 5).alias("v")))


@query("SELECT user_id, count(*) AS connections FROM (SELECT user_id, event_type, max_by(event_id % 3 <> 0, event_id) AS joined FROM events GROUP BY ALL) WHERE joined GROUP BY user_id")
def q13_present(t: Tables) -> DataFrame:
    """Q19."""
    return jobs.present(t.events, "user_id", "event_type", "event_id", F.col("event_id") % 3 != 0)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v, c_custkey % 2 <> 0 AS stale FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def q18_cached(t: Tables) -> DataFrame:
    """Q17."""
    fresh = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("v"))
    return jobs.cached(fresh, t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("old").alias("v")), "c_custkey", "v")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'not_found' WHEN o_orderkey % 5 = 0 THEN 'wrong_authority' WHEN o_orderkey % 4 = 0 THEN 'stale_base' ELSE 'committed' END AS outcome, CASE WHEN o_orderkey % 6 <> 0 THEN 3 + CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0 THEN 1 ELSE 0 END END AS revision FROM orders")
def q14_checkpointed(t: Tables) -> DataFrame:
    """Q13."""
    k = F.col("o_orderkey")
    ledger = t.orders.where(k % 6 != 0).select(k, F.lit("a").alias("authority"), F.lit(3).cast("bigint").alias("revision"))
    commits = t.orders.select(k, F.when(k % 5 == 0, "b").otherwise("a").alias("authority"), F.when(k % 4 == 0, 2).otherwise(3).alias("base_revision"))
    return logs.checkpointed(ledger, commits, "o_orderkey")


@query("SELECT user_id, event_id % 5 AS generation, event_id FROM events QUALIFY event_id % 5 = max(event_id % 5) OVER (PARTITION BY user_id)")
def q17_newest_generation(t: Tables) -> DataFrame:
    """Q8."""
    return logs.newest_generation(t.events.select("user_id", (F.col("event_id") % 5).alias("generation"), "event_id"), "user_id", "generation")


@query("""
c AS (SELECT l_orderkey, count(*) AS n, max(per) AS most, count(DISTINCT l_partkey) AS ids FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS per FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY 1)
SELECT o_orderkey AS l_orderkey, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'missing' WHEN n > 2 OR most > 1 THEN 'ambiguous' WHEN ids < n THEN 'error' ELSE 'fixed' END AS class FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def g14_classified_targets(t: Tables) -> DataFrame:
    """G22."""
    found = t.lineitem.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("identity"))
    return catalog.classified_targets(found, t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", 2)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey)")
def g13_first_variant(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return catalog.first_variant(rows, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").drop("l_returnflag")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'title_mismatch' WHEN p_partkey % 3 = 0 THEN 'excluded_version' WHEN p_partkey % 5 = 0 THEN 'restricted' WHEN p_partkey % 7 = 0 THEN 'credit_mismatch' ELSE 'verified' END AS outcome FROM part")
def p20_verification(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k, catalog.verification(k % 2 != 0, k % 5 == 0, k % 3 == 0, k % 7 != 0).alias("outcome"))
