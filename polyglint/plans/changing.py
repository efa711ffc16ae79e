"""Queries of mutations, scalars, stories, composition, queues, logs, projections and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import align, catalog, compose, integrity, jobs, logs, merge, overlay, projections, story
from ..streaming import feeds
from .relations import LOCALE, Tables, query

KEYS = overlay.KEYS


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query("""
j AS (SELECT category, field, jp_key, e.cn_text AS old, e.source AS old_source, e.ids AS old_ids, e.p IS NOT NULL AS there, o.cn_text AS cn, o.ids AS new_ids FROM entries e FULL JOIN official o USING (category, field, jp_key) WHERE e.p IS NOT NULL OR o.cn_text IS NOT NULL),
k AS (SELECT *, cn IS NULL OR (cn <> '' AND coalesce(old_source, '') = 'pinned') OR (cn = '' AND coalesce(old, '') <> '') AS keeps, CASE WHEN new_ids IS NULL THEN old_ids ELSE list_concat(coalesce(old_ids, []), list_filter(new_ids, lambda x: NOT list_contains(coalesce(old_ids, []), x))) END AS ids FROM j),
n AS (SELECT *, CASE WHEN keeps THEN coalesce(old, '') ELSE cn END AS cn_text, CASE WHEN keeps THEN old_source WHEN cn <> '' THEN 'cn' ELSE 'unknown' END AS source FROM k)
SELECT category, field, jp_key, cn_text, source, array_to_string(ids, ',') AS ids, NOT there OR cn_text IS DISTINCT FROM old OR source IS DISTINCT FROM old_source OR ids IS DISTINCT FROM old_ids AS changed FROM n""")
def m01_official_merge(t: Tables) -> DataFrame:
    return merge.official_merge(t.entries, t.official).withColumn("ids", F.array_join("ids", ","))


@query("""
x AS (SELECT category, field, jp_key, jp_key || '-llm' AS text FROM keyed WHERE p % 2 = 0 UNION ALL SELECT category, field, jp_key || '-x', jp_key FROM keyed WHERE p % 17 = 0),
j AS (SELECT category, field, jp_key, e.cn_text, e.source, x.text, CASE WHEN x.text IS NULL THEN 'kept' WHEN e.p IS NULL THEN 'inserted' WHEN e.source IN ('pinned', 'human', 'cn') OR (e.cn_text <> '' AND e.source NOT IN ('unknown', 'llm')) THEN 'skipped' ELSE 'translated' END AS outcome FROM entries e FULL JOIN x USING (category, field, jp_key))
SELECT category, field, jp_key, CASE WHEN outcome IN ('inserted', 'translated') THEN text ELSE cn_text END AS cn_text, CASE WHEN outcome IN ('inserted', 'translated') THEN 'llm' ELSE source END AS source, outcome FROM j""")
def m02_ai_merge(t: Tables) -> DataFrame:
    a = t.keyed.where("p % 2 = 0").select("category", "field", "jp_key", F.concat("jp_key", F.lit("-llm")).alias("text"))
    b = t.keyed.where("p % 17 = 0").select("category", "field", F.concat("jp_key", F.lit("-x")).alias("jp_key"), F.col("jp_key").alias("text"))
    return merge.machine_merge(t.entries, a.unionByName(b))


@query("""
c AS (SELECT 'gacha' AS field, a.jp_key, a.cn_text, a.source FROM pairs a JOIN pairs b ON a.jp_key = b.jp_key AND a.field = 'prefix' AND b.field = 'gacha' AND NOT (a.cn_text = '' AND a.source = 'unknown') AND (a.cn_text <> b.cn_text OR a.source <> b.source))
SELECT category, field, jp_key, coalesce(c.cn_text, p.cn_text) AS cn_text, coalesce(c.source, p.source) AS source, c.cn_text IS NOT NULL AS changed FROM pairs p LEFT JOIN c USING (field, jp_key)""")
def m03_propagate(t: Tables) -> DataFrame:
    return merge.propagated(t.pairs, "cards", "prefix", "gacha")


@query("""
e AS (SELECT category, field, jp_key, CASE WHEN p % 5 = 0 THEN jp_key ELSE lower(jp_key) END AS text, 'human' AS source FROM keyed WHERE p % 9 <> 2),
j AS (SELECT category, field, jp_key, o.text AS old, o.source AS old_source, o.revision, e.text, e.source, e.text IS NOT NULL AND (o.text IS NULL OR e.text <> o.text OR e.source <> o.source) AS changed FROM overlay o FULL JOIN e USING (category, field, jp_key))
SELECT category, field, jp_key, CASE WHEN changed THEN text ELSE old END AS text, CASE WHEN changed THEN source ELSE old_source END AS source, coalesce(revision, 0) + changed::BIGINT AS revision, changed FROM j""")
def m05_upsert_revision(t: Tables) -> DataFrame:
    edits = t.keyed.where("p % 9 <> 2").select(*KEYS, F.when(F.col("p") % 5 == 0, F.col("jp_key")).otherwise(F.lower("jp_key")).alias("text"), F.lit("human").alias("source"))
    return merge.revision_upsert(t.overlay, edits, KEYS, ["text", "source"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS text, 'human' AS source, CASE WHEN c_custkey % 3 <> 0 THEN 'kept' WHEN c_mktsegment = 'BUILDING' THEN 'noop' ELSE 'applied' END AS outcome FROM customer")
def m06_batch_cas(t: Tables) -> DataFrame:
    current = t.customer.select("c_custkey", F.col("c_mktsegment").alias("text"), F.lit("human").alias("source"))
    batch = current.where("c_custkey % 3 = 0").withColumn("text", F.lit("BUILDING"))
    return merge.batch_with_token(current, batch, ["c_custkey"], ["human", "cn"], F.lit("r1"), F.lit("r1"))


@query("""
c AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name || '!' END AS n, CASE WHEN c_custkey % 8 = 0 THEN 'NEW' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 2 = 0),
j AS (SELECT c_custkey, c.c_name AS old, c.c_mktsegment AS old_m, n IS NOT NULL AS given, CASE WHEN n IS NOT NULL THEN coalesce(nullif(n, ''), c.c_name, '') ELSE c.c_name END AS c_name, CASE WHEN n IS NOT NULL THEN m ELSE c.c_mktsegment END AS c_mktsegment FROM c FULL JOIN i USING (c_custkey))
SELECT c_custkey, c_name, c_mktsegment, CASE WHEN old IS NULL THEN 'inserted' WHEN given AND (c_name <> old OR c_mktsegment <> old_m) THEN 'updated' ELSE 'same' END AS outcome FROM j""")
def m07_conditional_upsert(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    incoming = t.customer.where(k % 2 == 0).select(k, F.when(k % 4 == 0, "").otherwise(F.concat("c_name", F.lit("!"))).alias("c_name"), F.when(k % 8 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return merge.conditional_upsert(t.customer.where(k % 3 != 0), incoming, "c_custkey", ["c_name"], ["c_mktsegment"])


@query("""
r AS (SELECT o_orderkey, o_custkey, o_custkey % 10 AS fp, CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'approved' END AS state FROM orders), c AS (SELECT c_custkey AS o_custkey, c_custkey % 10 + (c_custkey % 7 = 0)::BIGINT AS now FROM customer WHERE c_custkey % 11 <> 0)
SELECT o_orderkey, o_custkey, fp, CASE WHEN state = 'pending' AND fp IS DISTINCT FROM now THEN 'superseded' ELSE state END AS state, state = 'pending' AND fp IS DISTINCT FROM now AS changed FROM r LEFT JOIN c USING (o_custkey)""")
def m09_cascade(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    reviews = t.orders.select("o_orderkey", k, (k % 10).alias("fp"), F.when(F.col("o_orderkey") % 2 == 0, "pending").otherwise("approved").alias("state"))
    current = t.customer.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("o_custkey")).withColumn("fp", k % 10 + (k % 7 == 0).cast("bigint"))
    return merge.superseded(reviews, current, "o_custkey", "fp")


@query("""
e AS (SELECT segment_id, CASE WHEN position % 5 = 0 THEN text ELSE text || '!' END AS text, position % 3 AS expected, CASE WHEN position % 7 = 0 THEN 'old' ELSE 'h' END AS source_hash FROM lines UNION ALL SELECT 'none', 'x', 0, 'h'),
j AS (SELECT segment_id, e.text, l.position % 2 AS r, CASE WHEN l.segment_id IS NULL THEN 'not_found' WHEN source_hash <> 'h' THEN 'source_changed' WHEN l.position % 2 <> expected THEN 'revision_conflict' WHEN e.text = l.text THEN 'noop' ELSE 'ok' END AS outcome FROM e LEFT JOIN lines l USING (segment_id))
SELECT segment_id, text, outcome, r + (outcome = 'ok')::BIGINT AS revision FROM j""")
def m12_row_cas(t: Tables) -> DataFrame:
    p = F.col("position")
    current = t.lines.select("segment_id", "text", (p % 2).alias("revision"), F.lit("h").alias("source_hash"))
    edits = t.lines.select("segment_id", F.when(p % 5 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"), (p % 3).alias("expected"), F.when(p % 7 == 0, "old").otherwise("h").alias("source_hash"))
    gone = t.spark.range(1).select(F.lit("none").alias("segment_id"), F.lit("x").alias("text"), F.lit(0).cast("bigint").alias("expected"), F.lit("h").alias("source_hash"))
    return merge.row_edits(current, edits.unionByName(gone), "segment_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN 'inserted' WHEN p_partkey % 5 = 0 THEN 'conflict' ELSE 'same' END AS outcome FROM part")
def m20_insert_or_verify(t: Tables) -> DataFrame:
    incoming = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_name")).alias("p_name"))
    return merge.insert_or_verify(t.part.where("p_partkey % 3 <> 0"), incoming, "p_partkey", "p_name")


@query("""
d AS (SELECT o_orderkey, o_orderkey % 3 AS g, CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' ELSE 'approved' END AS v FROM orders WHERE o_orderkey % 4 <> 3),
j AS (SELECT o_orderkey, o_orderkey % 6 = 0 AS ended, CASE WHEN g IN (0, 2) THEN v END AS a, CASE WHEN g IN (1, 2) THEN v END AS b FROM orders LEFT JOIN d USING (o_orderkey)),
k AS (SELECT o_orderkey, ended, CASE WHEN ended THEN 'pending' ELSE coalesce(a, 'pending') END AS identity, CASE WHEN ended THEN 'pending' ELSE coalesce(b, 'pending') END AS rights FROM j)
SELECT o_orderkey, identity, rights, CASE WHEN ended THEN 'superseded' WHEN 'rejected' IN (identity, rights) THEN 'rejected' WHEN identity = 'approved' AND rights = 'approved' THEN 'approved' ELSE 'pending' END AS state FROM k""")
def m22_gates(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    reviews = t.orders.select(k, F.lit("pending").alias("identity"), F.lit("pending").alias("rights"), F.when(k % 6 == 0, "superseded").otherwise("pending").alias("state"))
    gate = F.when(k % 3 == 0, "identity").when(k % 3 == 1, "rights").otherwise("overall")
    decisions = t.orders.where(k % 4 != 3).select(k, gate.alias("gate"), F.when(k % 5 == 0, "rejected").otherwise("approved").alias("decision"), F.lit(1).alias("ord"))
    return merge.decided(reviews, decisions, "o_orderkey", ["identity", "rights"])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'preserved' ELSE 'inserted' END AS outcome FROM customer")
def m27_seed_apply(t: Tables) -> DataFrame:
    owners = [t.customer.where("c_custkey % 4 = 0"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))]
    return merge.seeded(t.customer.select("c_custkey", "c_name"), owners, "c_custkey")


@query("""
d AS (SELECT o_orderkey, o_orderkey % 4 AS d FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 3 END AS r FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_orderkey, 9::BIGINT AS p FROM orders WHERE o_orderkey % 3 = 0),
j AS (SELECT o_orderkey, p, r, CASE WHEN r IS NULL THEN 'kept' WHEN r = -1 THEN CASE WHEN p IS NULL THEN 'not_found' ELSE 'unpublished' END WHEN d IS NULL THEN 'not_found' WHEN d <> r THEN 'conflict' ELSE 'published' END AS outcome FROM p FULL JOIN r USING (o_orderkey) LEFT JOIN d USING (o_orderkey))
SELECT o_orderkey, CASE outcome WHEN 'published' THEN r WHEN 'unpublished' THEN NULL ELSE p END AS revision, outcome FROM j""")
def m31_publish(t: Tables) -> DataFrame:
    """M17."""
    k = F.col("o_orderkey")
    documents = t.orders.where(k % 5 != 0).select(k, (k % 4).alias("revision"))
    requests = t.orders.where(k % 2 == 0).select(k, F.when(k % 7 == 0, -1).otherwise(k % 3).alias("revision"))
    return merge.publish(t.orders.where(k % 3 == 0).select(k, F.lit(9).cast("bigint").alias("revision")), documents, requests, "o_orderkey")


@query("SELECT s_suppkey, array_to_string(list_filter([s_name, CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE 'x' END, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' y ' END], lambda v: trim(v) NOT IN ('', '-')), ' | ').replace('  y ', ' y') AS credits FROM supplier")
def f12_concat_credits(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k, scalars.credits(F.col("s_name"), F.when(k % 3 == 0, "-").otherwise("x"), F.when(k % 2 == 0, "").otherwise(" y ")).alias("credits"))


@query(r"SELECT p_partkey, CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN v::BIGINT ELSE 0 END AS whole, coalesce(TRY_CAST(regexp_extract(v, '^\s*([+-]?\d+)', 1) AS BIGINT), 0) AS leading FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_size || 'cm' ELSE p_name END AS v FROM part)")
def f20_integers(t: Tables) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat("p_size", F.lit("cm"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", scalars.strict_int(v).alias("whole"), scalars.prefix_int(v).alias("leading"))


@query("SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86400 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def f25_rfc3339(t: Tables) -> DataFrame:
    """F29."""
    return t.orders.select("o_orderkey", scalars.rfc3339(F.col("o_orderkey") * 86400).alias("stamp"))


@query("SELECT o_orderkey, least(30 * pow(2, greatest(o_orderkey % 12 - 1, 0)), 3600)::BIGINT AS delay FROM orders")
def f32_backoff(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", scalars.backoff(F.col("o_orderkey") % 12, 30, 3600).alias("delay"))


@query("SELECT p_partkey, sha256(p_name) AS hash, sha256(p_brand || chr(0) || p_type) AS job, CASE WHEN length(p_name) > 6 THEN substr(p_name, 1, 6) || '…' ELSE p_name END AS short FROM part")
def f33_texts(t: Tables) -> DataFrame:
    """F21, F27, F47."""
    return t.part.select("p_partkey", scalars.text_hash(F.col("p_name")).alias("hash"), scalars.job_key(F.col("p_brand"), F.col("p_type")).alias("job"), scalars.shortened(F.col("p_name"), 6).alias("short"))


@query("SELECT c_custkey, rtrim(to_base64(encode(c_name)), '=').replace('+', '-').replace('/', '_') AS cursor, c_name AS payload FROM customer")
def o10_cursor(t: Tables) -> DataFrame:
    """O4, F46."""
    cursor = scalars.cursor_encoded(F.col("c_name"))
    return t.customer.select("c_custkey", cursor.alias("cursor"), scalars.cursor_decoded(cursor).alias("payload"))


@query("""
s AS (SELECT event_id, episode, 'body' AS kind, position * 2 AS position, text FROM lines WHERE text <> '' UNION ALL SELECT event_id, episode, 'speaker', position * 2 + 1, trim(episode) FROM lines UNION ALL SELECT event_id, episode, 'title', -1, min(text) FROM lines GROUP BY event_id, episode)
SELECT event_id, episode, kind, position, text, 'event:' || event_id || ':' || episode || ':sc:' || kind || ':' || position AS segment_id, sha256(text) AS source_hash FROM s WHERE text <> ''""")
def n03_segments(t: Tables) -> DataFrame:
    rows = t.lines.withColumn("scenario", F.lit("sc")).withColumn("speaker", F.col("episode"))
    return story.segments(rows, "event_id", "episode", "scenario", "position", "text", "speaker", "text").drop("scenario")


@query("SELECT event_id, count(*) AS expected, count(*) FILTER (WHERE position % 4 <> 3 AND position % 9 <> 0) AS covered, count(*) = count(*) FILTER (WHERE position % 4 <> 3 AND position % 9 <> 0) AS complete FROM lines GROUP BY event_id")
def n04_coverage(t: Tables) -> DataFrame:
    stored = t.lines.where("position % 4 <> 3").withColumn("text", F.when(F.col("position") % 9 == 0, "stale").otherwise(F.col("text")))
    return story.coverage(t.lines, stored, ["segment_id"], ["text"], ["event_id"])


@query("e AS (SELECT event_id, episode, string_agg(position || ':' || text, chr(10) ORDER BY position, text) AS lines FROM lines GROUP BY ALL) SELECT event_id, string_agg(episode || chr(10) || lines, chr(10) ORDER BY episode) AS body FROM e GROUP BY event_id")
def n07_ordered_detail(t: Tables) -> DataFrame:
    found = story.ordered_detail(t.lines, "event_id", "episode", "position", ["text"])
    line = lambda x: F.concat_ws(":", x["position"], x["text"])
    return found.select("event_id", F.array_join(F.transform("episodes", lambda e: F.concat_ws("\n", e["episode"], F.array_join(F.transform(e["lines"], line), "\n"))), "\n").alias("body"))


@query("SELECT l.event_id, l.episode, l.position, l.text AS source_text, CASE WHEN l.position % 8 = 5 THEN '' ELSE coalesce(nullif(z.text, ''), '') END AS text FROM lines l LEFT JOIN localized z USING (segment_id)")
def n08_locale_detail(t: Tables) -> DataFrame:
    legacy = t.lines.select("event_id", "episode", "position", F.col("text").alias("source_text"), F.lit("old").alias("legacy_text"))
    return story.locale_detail(t.lines, t.localized.join(t.lines.where("position % 8 <> 5").select("segment_id"), "segment_id"), legacy, LOCALE)


@query("""
p AS (SELECT p_type, p_brand AS component, p_name AS value, p_partkey AS source FROM part)
SELECT p_type, component, CASE WHEN count(DISTINCT value) = 1 THEN min_by(value, source) END AS value, CASE WHEN count(DISTINCT value) = 1 THEN min(source) END AS owner, count(*) AS n_sources, count(DISTINCT value) > 1 AS conflict FROM p GROUP BY p_type, component""")
def g03_compose(t: Tables) -> DataFrame:
    parts = t.part.select("p_type", F.col("p_brand").alias("component"), F.col("p_name").alias("value"), F.col("p_partkey").alias("source"))
    return compose.composed(parts, ["p_type"], "component", "value", "source", "value")


@query("""
o AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'error' ELSE 'not_found' END AS outcome, o_orderkey % 8 = 0 AS whole FROM orders),
b AS (SELECT *, coalesce(min((outcome = 'not_found' OR (outcome = 'candidate' AND NOT whole))::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS reached FROM o),
l AS (SELECT o_custkey, count(*) AS asked, max_by(outcome, o_orderkey) AS last, max_by(whole, o_orderkey) AS whole, bool_or(outcome = 'candidate') AS tried FROM b WHERE reached = 1 GROUP BY o_custkey)
SELECT o_custkey, asked, CASE WHEN last = 'candidate' AND whole THEN 'complete' WHEN last = 'error' THEN 'failed' WHEN tried THEN 'incomplete' ELSE 'none' END AS decision FROM l""")
def g15_replayed(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    outcomes = t.orders.select("o_custkey", k, F.when(k % 4 == 0, "candidate").when(k % 4 == 1, "error").otherwise("not_found").alias("outcome"), (k % 8 == 0).alias("whole"))
    return compose.replayed(outcomes, ["o_custkey"], "o_orderkey", "outcome", "whole")


@query()
def g01_unique_subsequence(t: Tables) -> DataFrame:
    """Lines of even turns within all lines of a conversation, by speaker."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("position", "episode"))), lambda x: x["episode"])
    part = F.transform(F.array_sort(F.collect_list(F.when(F.col("position") % 2 == 0, F.struct("position", "episode")))), lambda x: x["episode"])
    found = t.lines.groupBy("event_id").agg(part.alias("part"), whole.alias("whole")).withColumn("r", align.subsequence_udf("part", "whole"))
    return found.select("event_id", "r.status", F.array_join(F.col("r.positions").cast("array<string>"), ",").alias("positions"))


def _sides(t: Tables) -> DataFrame:
    left = t.lines.select("event_id", F.lit("left").alias("side"), "position", F.lit("talk").alias("kind"), F.col("episode").alias("speaker"), "text")
    return left.unionByName(left.where("position % 3 <> 1").withColumn("side", F.lit("right")))


@query()
def g09_alignment(t: Tables) -> DataFrame:
    return align.aligned(_sides(t), "event_id")


@query()
def g10_preview(t: Tables) -> DataFrame:
    rows = _sides(t)
    return align.preview(rows, align.aligned(rows, "event_id"), "event_id")


@query("r AS (SELECT l_orderkey AS job_id, min(l_partkey) AS part FROM lineitem GROUP BY 1) SELECT job_id, part FROM r WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE job_id % 3 <> 0)")
def q01_dedupe(t: Tables) -> DataFrame:
    return jobs.enqueued(t.jobs.where("job_id % 3 <> 0"), t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("part")), "job_id")


@query("""
e AS (SELECT job_id, CASE WHEN state = 'leased' AND lease_expires_at <= 500 THEN CASE WHEN attempts >= max_attempts THEN 'dead_letter' ELSE 'retry_wait' END ELSE state END AS state, attempts, max_attempts, next_attempt_at, version,
  CASE WHEN state = 'leased' AND lease_expires_at <= 500 THEN NULL ELSE lease_owner END AS lease_owner, CASE WHEN state = 'leased' AND lease_expires_at <= 500 THEN NULL ELSE lease_expires_at END AS lease_expires_at FROM jobs),
h AS (SELECT job_id AS j FROM e WHERE state IN ('pending', 'retry_wait') AND next_attempt_at <= 500 ORDER BY next_attempt_at, job_id LIMIT 1)
SELECT job_id, CASE WHEN j IS NULL THEN state ELSE 'leased' END AS state, (attempts + (j IS NOT NULL)::INTEGER)::INTEGER AS attempts, max_attempts, next_attempt_at, (version + (j IS NOT NULL)::INTEGER)::INTEGER AS version,
  CASE WHEN j IS NULL THEN lease_owner ELSE 'me' END AS lease_owner, CASE WHEN j IS NULL THEN lease_expires_at ELSE 560 END AS lease_expires_at FROM e LEFT JOIN h ON job_id = j""")
def q02_claim(t: Tables) -> DataFrame:
    return jobs.claimed(t.jobs, 500, "me", 60)


@query("""
r AS (SELECT o_orderkey AS job_id, ['complete', 'retry', 'fail', 'cancel'][o_orderkey // 2 % 4 + 1] AS action, 'w' || o_orderkey % 3 AS owner, CASE WHEN o_orderkey % 14 = 0 THEN 9 ELSE (o_orderkey % 3 + 1) END AS expected, 300 AS due FROM orders WHERE o_orderkey % 2 = 0),
o AS (SELECT r.job_id, action, due, state, attempts, max_attempts, CASE WHEN action = 'cancel' THEN CASE WHEN state IN ('completed', 'cancelled', 'dead_letter') THEN 'already_ended' WHEN version <> expected THEN 'version_conflict' ELSE 'ok' END
  WHEN version <> expected THEN 'version_conflict' WHEN state <> 'leased' OR lease_owner IS DISTINCT FROM owner THEN 'not_owner' WHEN lease_expires_at <= due THEN 'lease_expired' ELSE 'ok' END AS outcome FROM r JOIN jobs USING (job_id)),
n AS (SELECT *, CASE action WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'cancelled' WHEN 'fail' THEN 'dead_letter' ELSE CASE WHEN attempts >= max_attempts THEN 'dead_letter' ELSE 'retry_wait' END END AS next FROM o)
SELECT job_id, outcome, CASE WHEN outcome = 'ok' THEN next ELSE state END AS state, CASE WHEN outcome = 'ok' AND next = 'retry_wait' THEN (due + least(30 * pow(2, greatest(attempts - 1, 0)), 3600))::BIGINT END AS next_attempt_at FROM n""")
def q03_transition(t: Tables) -> DataFrame:
    k = F.col("job_id")
    action = F.element_at(F.array(*map(F.lit, ("complete", "retry", "fail", "cancel"))), (F.floor(k / 2) % 4 + 1).cast("int"))
    reports = t.jobs.where(k % 2 == 0).select(k, action.alias("action"), F.concat(F.lit("w"), k % 3).alias("owner"), F.when(k % 14 == 0, 9).otherwise(k % 3 + 1).alias("expected_version"), F.lit(300).alias("at"))
    return jobs.transitioned(t.jobs, reports)


@query("n AS (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS only_one FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) SELECT o_orderkey AS l_orderkey, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'fetch' ELSE 'review' END AS route, CASE WHEN n = 1 THEN only_one END AS fetch_id FROM orders LEFT JOIN n ON o_orderkey = l_orderkey")
def q05_route(t: Tables) -> DataFrame:
    return catalog.routed(t.lineitem.where("l_partkey % 3 = 0").select("l_orderkey", F.col("l_partkey").alias("identity")), t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("""
g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INTEGER AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM s GROUP BY user_id, s""")
def q07_debounce_sessions(t: Tables) -> DataFrame:
    found = feeds.bursts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "30 minutes")
    return found.select("user_id", "n", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"))


@query("SELECT user_id, event_id, user_id % 5 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")
def q09_append(t: Tables) -> DataFrame:
    heads = t.events.select("user_id").distinct().select("user_id", (F.col("user_id") % 5).alias("seq"))
    return logs.appended(t.events.select("user_id", "event_id"), heads, "user_id", "event_id")


@query("""
s AS (SELECT user_id, 'base' AS body, median(event_id)::BIGINT AS seq FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
u AS (SELECT user_id, string_agg(event_type, chr(10) ORDER BY event_id) AS tail, max(event_id) AS last FROM events LEFT JOIN s USING (user_id) WHERE event_id > coalesce(seq, 0) GROUP BY user_id)
SELECT user_id, concat_ws(chr(10), body, tail) AS body, coalesce(last, seq) AS seq FROM s FULL JOIN u USING (user_id)""")
def q10_replay(t: Tables) -> DataFrame:
    snapshots = t.events.where("user_id % 2 = 0").groupBy("user_id").agg(F.lit("base").alias("body"), F.round(F.median("event_id")).cast("bigint").alias("seq"))
    return logs.replayed(snapshots, t.events, "user_id", "event_id", "event_type")


@query("""
d AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 10)
SELECT user_id, string_agg(event_type, chr(10) ORDER BY event_id) AS body, max(event_id) AS seq FROM events WHERE event_id > 0 AND user_id IN (SELECT user_id FROM d) GROUP BY user_id""")
def q11_compact(t: Tables) -> DataFrame:
    none = t.events.where("false").groupBy("user_id").agg(F.lit("").alias("body"), F.max("event_id").alias("seq"))
    return logs.compacted(none, t.events, "user_id", "event_id", "event_type", 10)[0]


@query("SELECT event_id, user_id, user_id % 3 = 1 AS accepted FROM (SELECT event_id, user_id FROM events)")
def q12_fence(t: Tables) -> DataFrame:
    updates = t.events.select("event_id", "user_id", F.lit(1).cast("bigint").alias("epoch"))
    rooms = updates.select("user_id").distinct().where("user_id % 3 <> 2").select("user_id", (F.col("user_id") % 3).alias("epoch"))
    return logs.fenced(updates, rooms, "user_id").drop("epoch")


@query("SELECT p_brand, '{' || string_agg('\"' || k || '\":\"' || v || '\"', ',' ORDER BY k) || '}' AS body FROM (SELECT p_brand, p_name AS k, max(upper(p_name)) AS v FROM part GROUP BY ALL) GROUP BY p_brand")
def s14_flat_json(t: Tables) -> DataFrame:
    return projections.flat_json(t.part.withColumn("v", F.upper("p_name")), ["p_brand"], "p_name", "v")


@query("SELECT category, field, '{' || string_agg('\"' || jp_key || '\":{\"text\":\"' || cn_text || '\",\"source\":\"' || source || '\",\"ids\":[\"' || p || '\"]}', ',' ORDER BY jp_key) || '}' AS body FROM entries GROUP BY category, field")
def s15_full_json(t: Tables) -> DataFrame:
    return projections.full_json(t.entries, ["category", "field"], "jp_key", "cn_text", "source", "ids")


@query("SELECT p_brand, substr(sha256(string_agg(p_name, ',' ORDER BY p_partkey)), 1, 32) AS etag FROM part GROUP BY p_brand")
def s21_etag(t: Tables) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), ",")
    return t.part.groupBy("p_brand").agg(scalars.etag(body).alias("etag"))


@query("""
x AS (SELECT p_partkey AS id, p_name AS n, 'parts' AS g, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE '' END AS cn FROM part UNION ALL SELECT s_suppkey, s_name, 'suppliers', s_name FROM supplier UNION ALL SELECT n_nationkey, n_name, 'nations', lower(n_name) FROM nation)
SELECT id, n, g, CASE WHEN cn <> '' AND cn <> n THEN cn END AS cn FROM x""")
def v08_search_index(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("n"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise("").alias("cn"))
    supplier = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("n"), F.col("s_name").alias("cn"))
    nation = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("n"), F.lower("n_name").alias("cn"))
    return projections.search_index({"parts": part, "suppliers": supplier, "nations": nation})


@query("""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), m AS (SELECT doc_id, n, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l)
SELECT doc_id, n, line FROM m WHERE line <> ''""")
def x01_plain_lines(t: Tables) -> DataFrame:
    return _long(projections.plain_lines(t.documents, "doc_id", "text"), "n")


@query(r"""
f AS (SELECT page_id, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS f FROM pages), e AS (SELECT page_id, unnest(f) AS p, unnest(range(len(f))) AS n FROM f)
SELECT page_id, n, trim(regexp_replace(p, '<[^>]*>', '', 'g')) AS line FROM e""")
def x09_html_lines(t: Tables) -> DataFrame:
    return _long(projections.html_paragraphs(t.pages, "page_id", "html"), "n")


@query("""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
SELECT doc_id, n, CASE WHEN contains(line, ':') THEN substr(line, 1, instr(line, ':') - 1) ELSE '' END AS speaker, CASE WHEN contains(line, ':') THEN substr(line, instr(line, ':') + 1) ELSE line END AS body FROM l""")
def s25_script_rows(t: Tables) -> DataFrame:
    return _long(projections.script_rows(t.documents, "doc_id", "text"), "n")


@query("SELECT 'line_part' AS fk, count(*) AS violations FROM lineitem WHERE l_partkey % 5 = 0 UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey % 7 = 0")
def i01_foreign_keys(t: Tables) -> DataFrame:
    """I14."""
    return integrity.foreign_key_counts({"line_part": (t.lineitem, t.part.where("p_partkey % 5 <> 0"), ["l_partkey"], ["p_partkey"]), "order_customer": (t.orders, t.customer.where("c_custkey % 7 <> 0"), ["o_custkey"], ["c_custkey"])})


@query("SELECT o_orderkey, \"check\" FROM (SELECT o_orderkey, unnest(['status', 'price']) AS \"check\", unnest([o_orderstatus IN ('F', 'O'), o_totalprice < 100000]) AS ok FROM orders) WHERE NOT ok")
def i02_checks(t: Tables) -> DataFrame:
    """I15."""
    return integrity.check_violations(t.orders, "o_orderkey", {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") < 100000})


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def i05_digest_rows(t: Tables) -> DataFrame:
    digest = F.when(F.col("doc_id") % 10 == 0, F.lit("0")).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    return integrity.digest_mismatches(t.documents.withColumn("digest", digest), "doc_id", "text", "digest")


@query("SELECT p_size::VARCHAR AS id, 'repeated_id' AS problem FROM part GROUP BY p_size HAVING count(*) > 1 UNION ALL SELECT '', 'too_few' FROM part HAVING count(*) < 1000000")
def i09_records(t: Tables) -> DataFrame:
    return integrity.record_problems(t.part, "p_size", "p_name", 1_000_000)


@query("SELECT event_id, '$.j' AS problem FROM events WHERE json_extract_string(props, '$.j') IS NULL UNION ALL SELECT event_id, '$.k' FROM events WHERE NOT coalesce(regexp_full_match(json_extract_string(props, '$.k'), '-?[0-9]+'), false)")
def i12_json_shape(t: Tables) -> DataFrame:
    """I6."""
    return integrity.json_violations(t.events, "event_id", "props", {"$.j": "text", "$.k": "integer"})


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'deleted' ELSE 'updated' END AS problem FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0")
def i14_immutable(t: Tables) -> DataFrame:
    """I16."""
    new = t.part.where("p_partkey % 11 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 13 == 0, "x").otherwise(F.col("p_name")))
    return integrity.immutability_violations(t.part, new, "p_partkey", ["p_name", "p_brand"])
