"""Queries of recovered batches: public candidates, shards, ruby, speakers, attempt windows and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import candidate, overlay, projections, ruby, shards, speakers, staging
from ..session import shared_folder
from ..streaming import stateful
from .publishing import ADMITTED
from .relations import Tables, query


#: How many segments a task of a batch's exchanges holds (about 300 bytes each when sorted).
ROWS_A_TASK = 500_000


def recovered_parts(t: Tables) -> int:
    """How many tasks a batch's records are dealt to: in proportion to the segments, of which there are most."""
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // ROWS_A_TASK))


def recovered(t: Tables) -> dict[str, DataFrame]:
    """The record sets of a batch, from customers (songs), their orders (lines) and lineitems (segments).

    A nation decides a customer's state. Faults come from the data: customers without orders, orders
    without lineitems, urgent orders (whose text is another), negative balances, high ones of a segment."""
    k = F.col("c_custkey").alias("music_id")
    state = F.element_at(F.array(*map(F.lit, candidate.STATES)), (F.col("c_nationkey") % 7 + 1).cast("int"))
    key = F.col("c_custkey").cast("string")
    digest = F.md5(key.cast("binary"))
    songs = t.customer.select("*", state.alias("state"), digest.alias("sha"), F.lit("b").alias("batch"))
    parts = recovered_parts(t)
    at = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    # An order's lineitems are put in order once, for its text and its segments; rows are dealt before they
    # are collected, so that a task holds ROWS_A_TASK of them however large a split of the table is.
    own = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").repartition(parts, "l_orderkey").groupBy("l_orderkey")
    flags = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("flags"))
    found = t.orders.repartition(parts, "o_orderkey").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = found.select("o_orderkey", "o_custkey", "o_orderpriority", F.array_join("flags", "").alias("text")).repartition(parts, "o_custkey").withColumn("at", F.row_number().over(at) - 1)
    urgent = F.col("o_orderpriority").startswith("1")
    flagged = found.select("o_orderkey", "o_custkey", F.posexplode("flags").alias("at", "l_returnflag"))
    ruby = lambda c: F.array(F.struct(c.alias("text"), F.lit("").alias("reading")))
    building = F.col("c_mktsegment") == "BUILDING"
    refs = F.when(building, F.create_map(F.lit("full_text"), key, F.lit("game_projection"), key)).otherwise(F.create_map(F.lit("full_text"), key))
    line = F.struct(F.lit("l1").alias("id"), F.col("c_name").alias("text"), F.array("c_mktsegment").alias("trailing"), F.array(F.struct(F.col("c_name").alias("text"), F.array().cast("array<string>").alias("performers"), ruby(F.col("c_name")).alias("ruby"))).alias("segments"))
    game = F.struct("state", F.create_map(F.lit("game_text"), key).alias("provenance"), F.array(line).alias("lines"))
    open_ = F.struct("state", F.when(F.col("state") == candidate.SATISFIED, candidate.INSTRUMENTAL).alias("noLyricsReason"))
    component = F.when(F.col("state") == "game_only", F.array(F.lit("game_text"))).otherwise(F.map_keys(refs))
    rich = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 9000)
    segments = t.customer.select("c_mktsegment").distinct().where("c_mktsegment <> 'FURNITURE'")
    return {
        "batches": t.customer.agg(F.count("*").alias("catalog_count")).select(F.lit("b").alias("batch"), F.lit("root").alias("root"), "catalog_count"),
        "music": t.customer.select(k, F.col("c_name").alias("title_ja"), F.col("c_mktsegment").alias("title_zh"), F.lit("").alias("title_en")),
        "items": songs.select("batch", k, "state", F.when(F.col("c_acctbal") < 0, "stale").otherwise(F.col("sha")).alias("document_sha"), F.col("sha").alias("availability_sha")),
        "documents": t.orders.groupBy(F.col("o_custkey").alias("music_id")).agg(F.count("*").alias("revision"), F.max(F.unix_date(F.col("o_orderdate").cast("date"))).cast("bigint").alias("updated_at")),
        "lines": orders.select(F.col("o_custkey").alias("music_id"), F.col("o_orderkey").cast("string").alias("line_id"), F.col("at").alias("position"), F.when(urgent, F.col("o_orderpriority")).otherwise(F.coalesce("text", F.lit(""))).alias("ja"), F.lit("").alias("zh"), F.lit("").alias("en"), F.lit(False).alias("stanza")),
        "segments": flagged.select(F.col("o_custkey").alias("music_id"), F.col("o_orderkey").cast("string").alias("line_id"), F.col("at").alias("position"), F.col("l_returnflag").alias("text"), F.array().cast("array<bigint>").alias("performers"), ruby(F.col("l_returnflag")).alias("ruby")),
        "sources": songs.where("state = 'complete'").select("batch", k, F.col("sha").alias("document_sha"), F.to_json(F.struct(refs.alias("provenance"))).alias("document_json")),
        "availability": songs.where("state <> 'complete'").select("batch", k, "state", F.col("sha").alias("document_sha"), F.when(F.col("state") == "game_only", F.to_json(game)).otherwise(F.to_json(open_)).alias("document_json"), (F.col("c_nationkey") + 1).cast("bigint").alias("created_at")),
        "contributions": songs.where(F.col("state").isin(*candidate.TEXT_STATES) & ~rich).select("batch", k, F.explode(component).alias("component"), key.alias("rendition")),
        "performers": segments.select(F.row_number().over(Window.orderBy("c_mktsegment")).cast("bigint").alias("performer_id"), F.col("c_mktsegment").alias("name_ja"), F.lower("c_mktsegment").alias("name_zh"), F.lit("").alias("name_en")),
    }


RECOVERED = """
c AS (SELECT *, list_extract(['complete', 'game_only', 'satisfied_no_lyrics', 'ambiguous', 'missing', 'incomplete', 'failed'], (c_nationkey % 7 + 1)::INT) AS state, c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 AS rich FROM customer),
x AS (SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY ALL),
o AS (SELECT o_custkey, count(*) AS n, max(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) AS last, count(*) FILTER (WHERE text IS NULL OR o_orderpriority LIKE '1%' AND o_orderpriority <> text) AS bad,
  string_agg(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority ELSE coalesce(text, '') END, chr(10) ORDER BY o_orderkey) AS body FROM orders LEFT JOIN x ON o_orderkey = l_orderkey GROUP BY ALL),
m AS (SELECT c_mktsegment AS seg, row_number() OVER (ORDER BY c_mktsegment) AS id FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE')),
s AS (SELECT c_custkey AS music_id, state, CASE WHEN state = 'complete' THEN n ELSE 1 END AS revision, CASE WHEN state = 'complete' THEN last ELSE c_nationkey + 1 END::BIGINT AS updated_at,
  CASE state WHEN 'complete' THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'full,game' ELSE 'full' END WHEN 'game_only' THEN 'game' ELSE '' END AS versions,
  CASE WHEN state = 'satisfied_no_lyrics' THEN 'catalog_instrumental' ELSE '' END AS no_lyrics_reason,
  CASE state WHEN 'complete' THEN coalesce(n, 0) WHEN 'game_only' THEN 1 END::INT AS n_lines, md5(CASE state WHEN 'complete' THEN coalesce(body, '') WHEN 'game_only' THEN c_name END) AS text_md5,
  CASE state WHEN 'game_only' THEN coalesce(id::VARCHAR, '') END AS singers,
  array_to_string(list_filter([CASE WHEN state = 'complete' AND (n IS NULL OR c_acctbal < 0) THEN 'ownership' END, CASE WHEN state IN ('complete', 'game_only') AND rich THEN 'contributions' END,
    CASE WHEN state = 'complete' AND (n IS NULL OR bad > 0) THEN 'lines' END, CASE WHEN state = 'game_only' AND id IS NULL THEN 'performers' END], lambda p: p IS NOT NULL), ',') AS problems
  FROM c LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN m ON c_mktsegment = seg)
"""


@query(RECOVERED + "SELECT * FROM s")
def v04_public_candidate(t: Tables) -> DataFrame:
    """Nine record sets to one row per song with its state, text and problems."""
    found = candidate.states(recovered(t), "b", recovered_parts(t))
    bodies = F.array_join(F.transform("lines", lambda x: x["ja"]), "\n")
    singers = F.when(F.col("state") == "game_only", F.array_join(F.flatten(F.transform("lines", lambda x: x["trailing"])).cast("array<string>"), ","))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("music_id", "state", "revision", "updated_at", joined("versions"), "no_lyrics_reason", F.size("lines").alias("n_lines"), F.md5(bodies.cast("binary")).alias("text_md5"), singers.alias("singers"), joined("problems"))


@query(RECOVERED + ", p AS (SELECT music_id, unnest(string_split(problems, ',')) AS problem FROM s WHERE problems <> '') SELECT 'refused' AS kind, music_id, problem FROM p UNION ALL SELECT 'index', music_id, state FROM s WHERE NOT EXISTS (FROM p)")
def j37_refused_batch(t: Tables) -> DataFrame:
    """One faulty song refuses the whole batch; the index is empty then."""
    index, _, why = candidate.public(recovered(t), "b", recovered_parts(t))
    return why.select(F.lit("refused").alias("kind"), "music_id", "problem").unionByName(index.select(F.lit("index").alias("kind"), "music_id", F.col("state").alias("problem")))


@query("""
a AS (SELECT l_partkey AS k, min(l_linenumber) AS body FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
r AS (SELECT l_partkey AS k, min(l_linenumber) AS body FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT 'stored' AS kind, k, body::VARCHAR AS value FROM a JOIN part ON k = p_partkey
UNION ALL SELECT 'outcome', r.k, CASE WHEN p_size > 45 THEN 'drift' WHEN a.k IS NULL THEN 'inserted' WHEN a.body = r.body THEN 'replayed' ELSE 'conflict' END FROM r JOIN part ON r.k = p_partkey LEFT JOIN a ON a.k = r.k""")
def m26_staged_import(t: Tables) -> DataFrame:
    """A batch is staged, verified and published; the next one, of which items conflict or drift, is
    refused and leaves the table as it was."""
    store = staging.Store(t.spark, shared_folder(t.spark, "imports"))
    catalog = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"))
    sold = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.min("l_linenumber").alias("body"))
    items = lambda flag, title: sold(flag).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("k"), title.alias("title"), "body")
    take = lambda batch, rows: staging.import_batch(store, batch, "items", rows, catalog, "k", ["body"], ["title"], catalog.count())
    take("first", items("A", F.col("p_name")))
    _, found = take("second", items("R", F.when(F.col("p_size") > 45, F.upper("p_name")).otherwise(F.col("p_name"))))
    stored = store.read("items", "k long, body int").select(F.lit("stored").alias("kind"), "k", F.col("body").cast("string").alias("value"))
    return stored.unionByName(found.select(F.lit("outcome").alias("kind"), "k", F.col("outcome").alias("value")))


@query("""SELECT 'translation/' || category || '.' || field || '.json' AS path, '{' || string_agg('"' || jp_key || '":"' || text || '"', ',' ORDER BY jp_key) || '}' AS body, 2::BIGINT AS generation FROM overlay GROUP BY category, field""")
def s20_write_all(t: Tables) -> DataFrame:
    """All documents of a locale published as one generation; the second replaces the first as a whole."""
    store = staging.Store(t.spark, shared_folder(t.spark, "published"))
    view = overlay.with_orphans(t.entries, t.overlay, "en-US").where("text is not null and text <> ''")
    body = projections.flat_json(view, ["category", "field"], "jp_key", "text")
    documents = body.select(F.concat(F.lit("translation/"), "category", F.lit("."), "field", F.lit(".json")).alias("path"), "body")
    staging.write_all(store, "first", documents.where("path < 'translation/d'"))
    staging.write_all(store, "second", documents)
    return store.read("files").withColumn("generation", F.lit(store.manifest()["generation"]).cast("bigint"))


@query("""
i AS (SELECT row_number() OVER (ORDER BY c_custkey) AS p, c_custkey AS k, '{"k":' || c_custkey || ',"n":"' || c_name || '"}' AS body, c_nationkey AS raw FROM customer),
z AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT p, 0 AS ordinal, 41 + strlen(body) AS enc, raw FROM i WHERE p = 1
  UNION ALL SELECT p, ordinal + (CASE WHEN fits THEN 0 ELSE 1 END), CASE WHEN fits THEN enc + 1 + size ELSE 40 + length((ordinal + 1)::VARCHAR) + size END, CASE WHEN fits THEN sum_raw + raw ELSE raw END
    FROM (SELECT i.p, w.ordinal, w.enc, strlen(i.body) AS size, w.raw AS sum_raw, i.raw, w.enc + 1 + strlen(i.body) <= 1500 AND w.raw + i.raw <= 300 AS fits FROM w JOIN i ON i.p = w.p + 1)) SELECT p, ordinal FROM w)),
b AS (SELECT ordinal, count(*) AS n_items, sum(raw)::BIGINT AS raw_bytes, min(k) AS first_id, max(k) AS last_id, '{"schemaVersion":1,"ordinal":' || ordinal || ',"items":[' || string_agg(body, ',' ORDER BY p) || ']}' AS whole FROM z JOIN i USING (p) GROUP BY ordinal)
SELECT ordinal, n_items, raw_bytes, first_id, last_id, strlen(whole) AS encoded_bytes, sha256(whole) AS sha256 FROM b""")
def s28_shards(t: Tables) -> DataFrame:
    """Content-addressed shards of items in order, under an encoded and a raw ceiling."""
    body = F.concat(F.lit('{"k":'), F.col("c_custkey").cast("string"), F.lit(',"n":"'), "c_name", F.lit('"}'))
    found, _ = shards.sealed(t.customer.select(F.col("c_custkey").alias("k"), body.alias("body"), F.col("c_nationkey").alias("raw")), "k", "body", "raw", 1500, 300)
    return found.select("ordinal", "n_items", "raw_bytes", "first_id", "last_id", "encoded_bytes", "sha256")


@query("""
n AS (SELECT p_partkey, p_name, least(p_size // 2, length(p_name)) AS a, string_split(p_name, ' ')[1] AS w1, CASE WHEN p_brand LIKE '%1' THEN 'yomi' ELSE '' END AS r, p_container AS c, p_size FROM (SELECT *, p_type AS p_container FROM part)),
q AS (SELECT *, length(w1) AS l, substr(p_name, length(w1) + 1) || CASE WHEN p_size % 10 = 0 THEN '!' ELSE '' END AS w2 FROM n)
SELECT p_partkey, CASE WHEN r <> '' AND a > 0 AND a < l THEN 'crosses_segment' WHEN p_size % 10 = 0 THEN 'continues_after' END AS refusal,
  CASE WHEN NOT (r <> '' AND a > 0 AND a < l) AND p_size % 10 <> 0 THEN
    array_to_string(list_filter([CASE WHEN a > 0 THEN substr(w1, 1, a) || ':' || r END, CASE WHEN a > l THEN substr(w2, 1, a - l) || ':' END], lambda x: x IS NOT NULL), '|') || '/' ||
    array_to_string(list_filter([CASE WHEN a < l THEN substr(w1, a + 1) || ':' || r END, CASE WHEN a < length(p_name) AND w2 <> '' THEN substr(w2, greatest(a - l, 0) + 1) || ':' END], lambda x: x IS NOT NULL), '|') END AS parts
FROM q""")
def f35_ruby_parts(t: Tables) -> DataFrame:
    """a name's first word, annotated for some brands, and the rest, dealt to two segments."""
    at = F.least(F.floor(F.col("p_size") / 2).cast("int"), F.length("p_name"))
    word = F.split("p_name", " ")[0]
    rest = F.concat(F.expr("substr(p_name, length(split(p_name, ' ')[0]) + 1)"), F.when(F.col("p_size") % 10 == 0, "!").otherwise(""))
    span = lambda text, reading: F.struct(text.alias("text"), reading.alias("reading"))
    lines = t.part.select("p_partkey", F.array(F.substring("p_name", F.lit(1), at), F.substring("p_name", at + 1, F.length("p_name"))).alias("segments"), F.array(span(word, F.when(F.col("p_brand").endswith("1"), "yomi").otherwise("")), span(rest, F.lit(""))).alias("spans"))
    found = ruby.partitioned(lines, "segments", "spans")
    shown = F.array_join(F.transform("parts", lambda part: F.array_join(F.transform(part, lambda x: F.concat(x["text"], F.lit(":"), x["reading"])), "|")), "/")
    return found.select("p_partkey", "refusal", shown.alias("parts"))


def _event_stream(t: Tables) -> DataFrame:
    """The events as a file stream; the pattern lets the table be one file or a folder."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]")


@query(ADMITTED)
def q15_stream_windows(t: Tables) -> DataFrame:
    """Q15 as a stream: a key's window is state that a timer clears."""
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    found = stateful.admitted(_event_stream(t).select("user_id", "event_id", seconds.alias("s")), "user_id", "event_id", "s", 86400, 2)
    return stateful.collected(found, shared_folder(t.spark, "windows")).withColumn("user_id", F.col("user_id").cast("bigint"))


@query("""
e AS (SELECT user_id, event_id, epoch_us(ts) // 604800000000 AS week, event_type, event_type || event_id AS payload, value > 300 AS bad FROM events),
h AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN week END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM e),
o AS (SELECT *, CASE WHEN event_type = 'signup' THEN CASE WHEN now IS NULL OR week > now THEN 'opened' ELSE 'stale_epoch' END WHEN now IS NULL THEN 'unavailable' WHEN week <> now THEN 'retired'
  WHEN event_type = 'error' THEN 'loaded' WHEN bad THEN 'bad_checksum' ELSE 'appended' END AS outcome FROM h),
n AS (SELECT *, count(*) FILTER (WHERE outcome = 'appended') OVER w AS k, string_agg(payload, chr(10) ORDER BY event_id) FILTER (WHERE outcome IN ('opened', 'appended')) OVER w AS body
  FROM o WINDOW w AS (PARTITION BY user_id, week ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, outcome, CASE WHEN outcome IN ('opened', 'loaded', 'appended') THEN k END AS seq, CASE WHEN outcome = 'loaded' THEN body END AS body FROM n""")
def q10_stream_log(t: Tables) -> DataFrame:
    """Q9, Q10 and Q14 as a stream: signups open a week's epoch, errors load the log, other events append."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "load").otherwise("update")
    payload = F.concat("event_type", F.col("event_id").cast("string"))
    week = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 604800000000)
    digest = F.when(F.col("value") > 300, "bad").otherwise(F.sha2(payload.cast("binary"), 256))
    events = _event_stream(t).select(F.col("user_id").alias("room"), week.alias("epoch"), kind.alias("kind"), F.col("event_id").alias("ord"), payload.alias("payload"), digest.alias("digest"))
    found = stateful.collected(stateful.room_log(events, every=5), shared_folder(t.spark, "log"))
    return found.select(F.col("room").cast("bigint").alias("user_id"), F.col("ord").alias("event_id"), "outcome", "seq", "body")


@query("""
s AS (SELECT c_custkey, c_custkey % 40 AS model, CASE c_custkey % 9 WHEN 0 THEN a.n_name WHEN 1 THEN a.n_name || 'の' || c_mktsegment WHEN 2 THEN c_mktsegment || '・' || a.n_name || 'の友' WHEN 3 THEN c_mktsegment || '＆' || a.n_name || '・x'
  WHEN 4 THEN '？' || repeat('?', c_custkey % 3) WHEN 5 THEN a.n_name || '＆' || b.n_name WHEN 6 THEN c_name WHEN 7 THEN c_mktsegment || '・x＆' || b.n_name || 'の' || a.n_name END AS speaker
  FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = (c_nationkey + 7) % 25),
m AS (SELECT s_suppkey AS model, min(s_nationkey) AS i FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1),
p AS (SELECT c_custkey, sep, unnest(range(1, len(l) + 1)) AS k, l FROM (SELECT c_custkey, sep, string_split(speaker, mark) AS l FROM s, (VALUES (1, '・'), (2, '＆')) v(sep, mark) WHERE contains(speaker, mark))),
h AS (SELECT c_custkey, sep, k, min(n_nationkey) AS i FROM p JOIN nation ON l[k] = n_name OR starts_with(l[k], n_name || 'の') GROUP BY ALL),
f AS (SELECT c_custkey, arg_min(i, sep * 1000 + k) AS i FROM h GROUP BY 1),
w AS (SELECT c_custkey, min(n_nationkey) AS i FROM s JOIN nation ON speaker = n_name OR starts_with(speaker, n_name || 'の') GROUP BY 1),
g AS (SELECT c_custkey, speaker, trim(coalesce(speaker, ''), '？?') = '' AS unknown, e.n_nationkey AS exact, m.i AS by_model, f.i AS by_part, w.i AS by_prefix FROM s LEFT JOIN nation e ON e.n_name = speaker LEFT JOIN m USING (model) LEFT JOIN f USING (c_custkey) LEFT JOIN w USING (c_custkey))
SELECT c_custkey, speaker, CASE WHEN NOT unknown THEN coalesce(exact, by_model, by_part, by_prefix) END AS n_nationkey,
  CASE WHEN unknown THEN NULL WHEN exact IS NOT NULL THEN 'exact' WHEN by_model IS NOT NULL THEN 'model' WHEN by_part IS NOT NULL THEN 'part' WHEN by_prefix IS NOT NULL THEN 'prefix' END AS rule FROM g""")
def f39_speakers(t: Tables) -> DataFrame:
    """speakers made of the customers' nations and segments, resolved to nations; suppliers are the models."""
    k, text = F.col("c_custkey"), F.col
    after = t.nation.select(((F.col("n_nationkey") + 18) % 25).alias("c_nationkey"), F.col("n_name").alias("other"))
    own = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("own"))
    forms = [
        text("own"), F.concat("own", F.lit("の"), "c_mktsegment"), F.concat("c_mktsegment", F.lit("・"), "own", F.lit("の友")), F.concat("c_mktsegment", F.lit("＆"), "own", F.lit("・x")),
        F.concat(F.lit("？"), F.repeat(F.lit("?"), (k % 3).cast("int"))), F.concat("own", F.lit("＆"), "other"), text("c_name"), F.concat("c_mktsegment", F.lit("・x＆"), "other", F.lit("の"), "own"), F.lit(None).cast("string"),
    ]
    lines = t.customer.join(own, "c_nationkey").join(after, "c_nationkey").select("c_custkey", F.element_at(F.array(*forms), (k % 9 + 1).cast("int")).alias("speaker"), (k % 40).alias("model"))
    models = t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("model"), F.col("s_nationkey").alias("index"))
    found = speakers.resolved(lines, t.nation.select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name")), models)
    return found.select("c_custkey", "speaker", F.col("index").alias("n_nationkey"), "rule")
