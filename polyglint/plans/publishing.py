"""Queries of documents and their stores, of extraction joins and of published projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import catalog, compose, documents, extract, jobs, merge, overlay, paging, projections, stats, story, windows
from .relations import Tables, query

KEYS = ["category", "field"]


# --- projections


@query("""SELECT category, field, '{' || string_agg('"' || jp_key || '":"' || text || '"', ',' ORDER BY jp_key) || '}' AS body FROM overlay GROUP BY category, field""")
def s16_locale_json(t: Tables) -> DataFrame:
    """The flat document of a locale's view, orphans included."""
    view = overlay.with_orphans(t.entries, t.overlay, "en-US").where("text is not null and text <> ''")
    return projections.flat_json(view, KEYS, "jp_key", "text")


_EVENT = """
l AS (SELECT conv_id, role, turn, role || turn AS k, '"\\<&' || chr(10) || coalesce(text, '') AS v FROM conversations),
e AS (SELECT conv_id, role, min(turn) AS f, '"' || role || '":{' || string_agg('"' || k || '":' || to_json(v), ',' ORDER BY turn) || '}' AS b FROM l GROUP BY conv_id, role)
SELECT conv_id, '{' || string_agg(b, ',' ORDER BY f) || '}' AS body FROM e GROUP BY conv_id"""


@query(_EVENT)
def s17_event_json(t: Tables) -> DataFrame:
    """Members in the order of the story, nothing but JSON's own escapes."""
    lines = t.conversations.withColumn("k", F.concat("role", "turn")).withColumn("v", F.concat(F.lit('"\\<&\n'), F.coalesce("text", F.lit(""))))
    return projections.event_json(lines, "conv_id", "role", "turn", "k", "v")


@query("""
l AS (SELECT event_id, episode, position, segment_id, coalesce(o.text[2:3] || '"', '') AS v FROM lines LEFT JOIN localized o USING (segment_id)),
e AS (SELECT event_id, episode, min(position) AS f, '"' || episode || '":{' || string_agg('"' || segment_id || '":' || to_json(v), ',' ORDER BY position) || '}' AS b FROM l GROUP BY event_id, episode)
SELECT event_id, '{' || string_agg(b, ',' ORDER BY f) || '}' AS body FROM e GROUP BY event_id""")
def s18_event_locale_json(t: Tables) -> DataFrame:
    """The same of a locale, without revisions."""
    lines = t.lines.select("event_id", "episode", "position", "segment_id")
    own = t.localized.select("segment_id", F.concat(F.substring("text", 2, 2), F.lit('"')).alias("v"))
    return projections.event_json(lines.join(own, "segment_id", "left"), "event_id", "episode", "position", "segment_id", "v")


_MATRIX = """
d AS (SELECT 'flat/' || category || '/' || field AS path, '{' || string_agg('"' || jp_key || '":"' || cn_text || '"', ',' ORDER BY jp_key) || '}' AS body FROM entries GROUP BY category, field
  UNION ALL SELECT 'full/' || category || '/' || field, '{' || string_agg('"' || jp_key || '":{"text":"' || cn_text || '","source":"' || source || '","ids":["' || p || '"]}', ',' ORDER BY jp_key) || '}' FROM entries GROUP BY category, field
  UNION ALL SELECT 'en-US/' || category || '/' || field, '{' || string_agg('"' || jp_key || '":"' || text || '"', ',' ORDER BY jp_key) || '}' FROM overlay GROUP BY category, field)"""


def _matrix(t: Tables) -> DataFrame:
    return projections.projection_matrix(t.entries, {"en-US": t.overlay}, KEYS, "jp_key")


@query(_MATRIX + " SELECT * FROM d")
def v01_projection_matrix(t: Tables) -> DataFrame:
    """V1: all documents of all groups, by path."""
    return _matrix(t)


@query(_MATRIX + " SELECT path, CASE WHEN path LIKE '%Brand#1%' AND path NOT LIKE '%/PROMO' THEN body ELSE 'old' END AS body FROM d WHERE NOT (path LIKE '%Brand#1%' AND path LIKE '%/PROMO')")
def q21_rebuilt(t: Tables) -> DataFrame:
    """Q21: of the changed groups new bodies (or none), of all others those there."""
    made = _matrix(t)
    changed = made.where("path like '%Brand#1%'").select("path")
    return projections.rebuilt(made.select("path", F.lit("old").alias("body")), made.where("path not like '%/PROMO'"), changed)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS zh, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS en, coalesce(nullif(p_partkey % 4, 0), 1) AS revision FROM part")
def v03_normalised_index(t: Tables) -> DataFrame:
    """V3: an index entry in the newer shape, with defaults for what it lacks."""
    k = F.col("p_partkey")
    old = t.part.select(k, F.when(k % 2 == 0, F.col("p_name")).alias("zh"), F.when(k % 3 == 0, F.col("p_brand")).alias("en"), F.nullif(k % 4, F.lit(0)).alias("revision"))
    return old.select(k, *(F.coalesce(c, F.lit("")).alias(c) for c in ("zh", "en")), F.coalesce("revision", F.lit(1)).alias("revision"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'main' END AS edition FROM customer")
def v07_edition_choice(t: Tables) -> DataFrame:
    """V7: requested, else default, else implicit."""
    c = t.customer.select("c_custkey")
    k = F.col("c_custkey")
    there = c.where(k % 2 == 0).select(k, F.lit("a").alias("edition"), F.lit(True).alias("is_default")).unionByName(c.where(k % 3 == 0).select(k, F.lit("b").alias("edition"), F.lit(False).alias("is_default")))
    asked = c.where(k % 3 == 0).select(k, F.lit("b").alias("edition")).unionByName(c.where(k % 3 == 1).select(k, F.lit("z").alias("edition")))
    return documents.edition_choice(c, there, asked, "c_custkey")


# --- documents and their stores


@query("""
SELECT coalesce(c.p_partkey, e.p_partkey) AS p_partkey, CASE WHEN o IN ('created', 'saved') THEN e.a ELSE c.a END AS a, coalesce(c.revision, 0) + (o IN ('created', 'saved'))::INTEGER AS revision, o AS outcome
FROM (SELECT *, CASE WHEN e.p_partkey IS NULL THEN 'kept' WHEN e.base IS DISTINCT FROM c.revision THEN 'conflict' WHEN c.p_partkey IS NULL THEN 'created' WHEN e.a IS NOT DISTINCT FROM c.a THEN 'unchanged' ELSE 'saved' END AS o
  FROM (SELECT p_partkey, p_name AS a, p_partkey % 3 + 1 AS revision FROM part WHERE p_partkey % 5 <> 0) c
  FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 7 <> 0 THEN p_brand END AS a, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 4 + 1 END AS base FROM part WHERE p_partkey % 3 <> 2) e ON c.p_partkey = e.p_partkey) x (c_key, a, revision, p_partkey, ea, base, o)
""".replace("coalesce(c.p_partkey, e.p_partkey)", "coalesce(c_key, p_partkey)").replace("THEN e.a ELSE c.a END AS a, coalesce(c.revision, 0)", "THEN ea ELSE a END AS a, coalesce(revision, 0)") + " WHERE NOT (o = 'conflict' AND c_key IS NULL)")
def m16_saved_documents(t: Tables) -> DataFrame:
    """A document is saved by its revision, and not at all where its content is the same."""
    k = F.col("p_partkey")
    current = t.part.where(k % 5 != 0).select(k, F.col("p_name").alias("a"), (k % 3 + 1).alias("revision"))
    edits = t.part.where(k % 3 != 2).select(k, F.when(k % 2 == 0, F.col("p_name")).when(k % 7 != 0, F.col("p_brand")).alias("a"), F.when(k % 10 != 0, k % 4 + 1).alias("revision"))
    return documents.saved(current, edits, "p_partkey", ["a"])


@query("SELECT a.p_partkey, a.x IS NOT DISTINCT FROM b.x AS same FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS x FROM part) a JOIN (SELECT p_partkey, CASE WHEN p_partkey % 2 > 0 THEN p_name END AS x FROM part WHERE p_partkey % 7 > 0) b USING (p_partkey)")
def n15_same_content(t: Tables) -> DataFrame:
    """N15."""
    k = F.col("p_partkey")
    a = t.part.select(k, F.when(k % 3 > 0, F.col("p_name")).alias("x"), F.col("p_brand").alias("y"))
    b = t.part.where(k % 7 > 0).select(k, F.when(k % 2 > 0, F.col("p_name")).alias("x"), F.col("p_brand").alias("y"))
    return documents.same_content(a, b, "p_partkey", ["x", "y"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 1 THEN string_agg(x || ':' || p, '|' ORDER BY x) ELSE NULL END AS lines FROM (SELECT c_custkey, unnest([0, 1]) AS x, unnest([c_name, c_mktsegment]) AS p FROM customer) GROUP BY c_custkey HAVING c_custkey % 4 <> 1")
def n16_up_and_down(t: Tables) -> DataFrame:
    """To renditions and back; what has a second side has no older form."""
    k = F.col("c_custkey")
    line = lambda i, c: F.struct(F.lit(i).alias("order"), F.col(c).alias("text"))
    up = documents.upconverted(t.customer.select(k, F.array(line(0, "c_name"), line(1, "c_mktsegment")).alias("lines")), "c_custkey", "lines")
    second = F.transform("renditions", lambda r: r.withField("lines", F.transform(r["lines"], lambda x: x.withField("sides", F.concat(x["sides"], x["sides"])))))
    mixed = up.withColumn("renditions", F.when(k % 4 == 1, second).otherwise(F.col("renditions")))
    down = documents.downgraded(mixed, "c_custkey")
    return down.select(k, F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["order"], x["text"])), "|").alias("lines"))


def _restore(t: Tables, wrong: str) -> DataFrame:
    current = {"region": t.region.select("r_regionkey", "r_name"), "nation": t.nation.select("n_nationkey", "n_regionkey")}
    backup = {"region": current["region"].withColumn("r_name", F.lower("r_name")), "nation": current["nation"].where("n_nationkey > 3")}
    problems = backup["nation"].join(backup["region"].where(wrong), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti")
    out = documents.restored(current, backup, problems)
    return out["region"].select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("v")).unionByName(out["nation"].select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("string")).toDF("k", "v"))


@query("SELECT r_regionkey::BIGINT AS k, lower(r_name) AS v FROM region UNION ALL SELECT n_nationkey, n_regionkey::VARCHAR FROM nation WHERE n_nationkey > 3")
def s23_restored(t: Tables) -> DataFrame:
    """A backup without a problem replaces all tables."""
    return _restore(t, "true")


@query("SELECT r_regionkey::BIGINT AS k, r_name AS v FROM region UNION ALL SELECT n_nationkey, n_regionkey::VARCHAR FROM nation")
def i12_restore_refused(t: Tables) -> DataFrame:
    """One missing parent, and nothing is replaced."""
    return _restore(t, "r_regionkey <> 2")


def _batch(t: Tables, where: str) -> DataFrame:
    reviews = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "pending").otherwise("approved").alias("state"))
    d = t.orders.where(where).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "approved").otherwise("rejected").alias("decision"))
    return documents.decided_batch(reviews, d, "o_orderkey", ["approved", "rejected"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'approved' WHEN o_orderkey % 9 = 0 THEN 'rejected' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'approved' END AS state FROM orders")
def m23_batch_taken(t: Tables) -> DataFrame:
    """A batch without a problem is taken as a whole."""
    return _batch(t, "o_orderkey % 6 = 0 or o_orderkey % 9 = 0")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'approved' END AS state FROM orders")
def m23_batch_refused(t: Tables) -> DataFrame:
    """One decision on a review that is not pending, and none counts."""
    return _batch(t, "o_orderkey % 6 = 0 or o_orderkey = 1")


@query("""
c AS (SELECT c_custkey, 'a' AS edition, 'A' AS title, true AS d FROM customer UNION ALL SELECT c_custkey, 'b', 'B', false FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'a' ELSE 'b' END AS edition, ['create', 'rename', 'default', 'delete', 'delete'][c_custkey % 5 + 1] AS a, 'new' AS t FROM customer WHERE c_custkey % 7 > 0),
m AS (SELECT coalesce(c.c_custkey, r.c_custkey) AS k, coalesce(c.edition, r.edition) AS e, c.title, c.d, r.a, r.t, CASE WHEN r.a IS NULL THEN 'kept' WHEN r.a = 'create' AND c.edition IS NOT NULL THEN 'exists' WHEN r.a <> 'create' AND c.edition IS NULL THEN 'not_found' WHEN r.a = 'delete' AND c.d THEN 'is_default' ELSE 'ok' END AS o
  FROM c FULL JOIN r ON c.c_custkey = r.c_custkey AND c.edition = r.edition),
n AS (SELECT k, min(e) AS e FROM m WHERE o = 'ok' AND a = 'default' GROUP BY k)
SELECT m.k AS c_custkey, m.e AS edition, CASE WHEN o = 'ok' AND a IN ('create', 'rename') THEN t ELSE title END AS title, CASE WHEN n.e IS NOT NULL THEN m.e = n.e ELSE coalesce(d, false) END AS is_default, o AS outcome
FROM m LEFT JOIN n ON m.k = n.k WHERE NOT (o = 'ok' AND a = 'delete') AND o <> 'not_found'""")
def m19_editions(t: Tables) -> DataFrame:
    """M19."""
    k = F.col("c_custkey")
    one = lambda df, e, title, d: df.select(k, F.lit(e).alias("edition"), F.lit(title).alias("title"), F.lit(d).alias("is_default"))
    current = one(t.customer, "a", "A", True).unionByName(one(t.customer.where(k % 2 == 0), "b", "B", False))
    action = F.element_at(F.array(*map(F.lit, ("create", "rename", "default", "delete", "delete"))), (k % 5 + 1).cast("int"))
    asked = t.customer.where(k % 7 > 0).select(k, F.when(k % 5 == 4, "a").otherwise("b").alias("edition"), action.alias("action"), F.lit("new").alias("title"))
    return documents.editions(current, asked, "c_custkey")


@query("SELECT c_custkey, min(o_orderdate) AS o_orderdate, 1::BIGINT AS revision, 'draft' AS state FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_custkey % 4 <> 0 GROUP BY c_custkey")
def m25_drafts(t: Tables) -> DataFrame:
    """Approved sources with their catalogue row become drafts once."""
    approved = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderdate")
    made = documents.drafts(approved, t.customer.where("c_custkey % 4 = 0"), "c_custkey", ["o_orderdate"])
    again = documents.drafts(approved, t.customer.where("c_custkey % 4 = 0").select("c_custkey").unionByName(made.select("c_custkey")), "c_custkey", ["o_orderdate"])
    return made.unionByName(again)


@query("""
SELECT 'parts' AS kind, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'inserted' WHEN p_partkey % 3 = 1 THEN 'mismatch' ELSE 'replayed' END AS outcome FROM part
UNION ALL SELECT 'suppliers', s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'inserted' ELSE 'replayed' END FROM supplier""")
def m26_manifest(t: Tables) -> DataFrame:
    """M26, M21."""
    p = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).alias("v"))
    current = {"parts": p.where("k % 3 > 0").withColumn("v", F.when(F.col("k") % 3 == 1, F.upper("v")).otherwise(F.col("v"))), "suppliers": s.where("k % 4 > 0")}
    return documents.verified_import(current, {"parts": p, "suppliers": s}, "k", "v")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 AND o_orderpriority LIKE '1%'")
def i07_exclusive_ownership(t: Tables) -> DataFrame:
    """Keys that two stores own at once."""
    owned = t.orders.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return documents.conflicts(t.customer.where("c_custkey % 3 = 0"), owned, "c_custkey")


@query("""
o AS (SELECT conv_id AS e, role AS kind, md5(left(text, 1)) AS h, count(*) AS n, max(turn) AS turn FROM conversations GROUP BY ALL HAVING count(*) = 1)
SELECT e || ':' || turn || ':new' AS segment_id, 'x' || turn AS text FROM o""")
def m10_carried_over(t: Tables) -> DataFrame:
    """Localisations move with their source where that is unambiguous on both sides."""
    base = t.conversations.select("conv_id", "role", F.md5(F.substring("text", 1, 1).cast("binary")).alias("h"), F.concat_ws(":", "conv_id", "turn").alias("segment_id"), F.concat(F.lit("x"), "turn").alias("text"))
    new = base.select("conv_id", "role", "h", F.concat("segment_id", F.lit(":new")).alias("segment_id"))
    return merge.carried_over(base, new, ["conv_id", "role", "h"], "text")


# --- stories


@query("SELECT event_id, segment_id FROM lines WHERE position % 3 <> 1")
def j09_active_segments(t: Tables) -> DataFrame:
    """Segments whose episode still has the scenario that they came from."""
    segments = t.lines.select("event_id", "episode", (F.col("position") % 3).alias("scenario"), "segment_id")
    episodes = t.lines.where("position % 3 <> 1").select("event_id", "episode", (F.col("position") % 3).alias("scenario")).distinct()
    return segments.join(episodes, ["event_id", "episode", "scenario"]).select("event_id", "segment_id")


_SCENARIO = """concat('{"Snippets":[{"Action":1,"ReferenceIndex":0},{"Action":6,"ReferenceIndex":0},{"Action":6,"ReferenceIndex":1},{"Action":1,"ReferenceIndex":9},{"Action":1,"ReferenceIndex":1}],"TalkData":[{"WindowDisplayName":"Miku_', p_partkey, '","Body":"', p_name, '","WhenFinishCloseWindow":1},{"WindowDisplayName":"Rin","Body":"end","WhenFinishCloseWindow":1}],"SpecialEffectData":[{"EffectType":8,"StringVal":"place"},{"EffectType":1,"StringVal":"no"}],"AppearCharacters":[{"Character2dId":1,"CostumeType":"cos_21miku_x"},{"Character2dId":1,"CostumeType":"01ichika"},{"Character2dId":2,"CostumeType":"v2_03rin"}]}')"""


@query("""
r AS (SELECT unnest([0, 1, 2, 3]) AS ord, unnest(['talk', 'separator', 'effect', 'talk']) AS kind, unnest(['Miku', '', '', 'Rin']) AS speaker, unnest(['*', '', 'place', 'end']) AS body)
SELECT p_partkey, ord::BIGINT AS ord, kind, speaker, CASE WHEN body = '*' THEN p_name ELSE body END AS body FROM part, r""")
def n05_talks(t: Tables) -> DataFrame:
    """References out of range and effects of other types are left out, a last separator too."""
    return story.talks(story.decoded(t.part.select("p_partkey", F.expr(_SCENARIO).alias("json"))), ["p_partkey"])


@query("SELECT p_partkey, m.model::INTEGER AS model, m.costume, m.code, m.character FROM part, (SELECT unnest([1, 2]) AS model, unnest(['cos_21miku_x', 'v2_03rin']) AS costume, unnest(['miku', 'rin']) AS code, unnest([21, NULL]) AS character) m")
def n06_model_characters(t: Tables) -> DataFrame:
    """The first costume of each model counts."""
    known = t.spark.range(1).select(F.lit("miku").alias("code"), F.lit(21).alias("character"))
    return story.model_characters(story.decoded(t.part.select("p_partkey", F.expr(_SCENARIO).alias("json"))), ["p_partkey"], known)


@query("""
SELECT p_partkey, 0::BIGINT AS position, 'order' AS problem FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 0, 'segments' FROM part WHERE p_partkey % 4 = 2
UNION ALL SELECT p_partkey, 0, 'performer' FROM part WHERE p_partkey % 4 = 3 UNION ALL SELECT p_partkey, 1, unnest(['segments', 'empty']) FROM part""")
def n13_violations(t: Tables) -> DataFrame:
    """N13, N17."""
    k = F.col("p_partkey")
    segment = F.struct(F.when(k % 4 == 2, F.upper("p_name")).otherwise(F.col("p_name")).alias("text"), F.array(F.when(k % 4 == 3, 9).otherwise(1)).alias("performers"))
    none = F.array().cast("array<struct<text:string,performers:array<int>>>")
    line = lambda order, text, segments: F.struct(order.alias("order"), text.alias("text"), segments.alias("segments"))
    lines = F.array(line(F.when(k % 4 == 1, 5).otherwise(0), F.col("p_name"), F.array(segment)), line(F.lit(1), F.lit("x"), none))
    return story.violations(t.part.select(k, lines.alias("lines")), "p_partkey", [1, 2])


@query("SELECT DISTINCT event_id FROM lines WHERE position % 5 = 4 UNION SELECT event_id FROM lines WHERE episode = 'system'")
def u03_protected_events(t: Tables) -> DataFrame:
    """Events with protected lines or titles, each once."""
    return t.lines.where("position % 5 = 4").select("event_id").union(t.lines.where("episode = 'system'").select("event_id")).distinct()


@query("SELECT conv_id, turn, i - 1 AS sub, i = 1 AS starts, i = len(s) AS ends FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, '.') AS s FROM conversations))")
def w07_sub_lines(t: Tables) -> DataFrame:
    """W7."""
    each = t.conversations.select("conv_id", "turn", F.split("text", r"\.").alias("s")).select("conv_id", "turn", F.posexplode("s").alias("i", "x"), F.size("s").alias("n"))
    return each.select("conv_id", "turn", F.col("i").cast("bigint").alias("sub"), (F.col("i") == 0).alias("starts"), (F.col("i") == F.col("n") - 1).alias("ends"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position FROM conversations")
def w08_numbered(t: Tables) -> DataFrame:
    """W8."""
    return windows.numbered(t.conversations.select("conv_id", "turn"), ["conv_id"], [F.desc("turn")], "position", 1)


@query("SELECT p_brand, sha256(coalesce(string_agg(p_partkey || '|' || p_name, chr(10) ORDER BY p_partkey) FILTER (WHERE p_partkey % 3 > 0), '')) AS revision FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE p_partkey % 3 > 0) > 0")
def a28_digest_without(t: Tables) -> DataFrame:
    """The digest of a table without the rows of one scope."""
    return stats.digest(t.part.where("p_partkey % 3 > 0"), ["p_brand"], ["p_partkey"], ["p_name"])


# --- extraction


@query("""
j AS (SELECT s_suppkey, unnest(['x', 'y']) AS kind, unnest([s_name, s_name || 'y']) AS n FROM supplier)
SELECT s_suppkey, kind, 'b' || kind AS bundle, n AS jp, CASE WHEN kind = 'x' AND s_suppkey % 2 = 0 THEN 'cn' || s_suppkey ELSE '' END AS cn FROM j""")
def j14_costume_parts(t: Tables) -> DataFrame:
    """J14."""
    k = F.col("s_suppkey")
    part = lambda kind, bundle, name: F.struct(F.lit(kind).alias("kind"), bundle.alias("bundle"), name.alias("name"))
    jp = t.supplier.select(k, F.array(part("x", F.lit("bx"), F.col("s_name")), part("y", F.lit("by"), F.concat("s_name", F.lit("y")))).alias("parts"))
    cn = t.supplier.where(k % 2 == 0).select(k, F.array(part("x", F.lit("bx"), F.concat(F.lit("cn"), k)), part("y", F.lit("other"), F.lit("lost"))).alias("parts"))
    return overlay.nested_parts(jp, cn, "s_suppkey", "parts", "kind", "bundle", "name")


_FIELDS = """
f AS (SELECT p_partkey AS id, unnest(['p_name', 'p_type']) AS field, unnest([p_name, p_type]) AS jp FROM part),
g AS (SELECT id, field, jp, CASE WHEN id % 3 <> 0 OR (field = 'p_type' AND id % 2 = 0) THEN '' ELSE lower(jp) END AS cn FROM f)"""


def _editions(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    jp = t.part.select(k, "p_name", "p_type")
    return jp, jp.where(k % 3 == 0).select(k, F.concat(F.lit(" "), F.lower("p_name")).alias("p_name"), F.when(k % 2 == 0, " ").otherwise(F.lower("p_type")).alias("p_type"))


@query(_FIELDS + " SELECT field, id AS p_partkey, jp, CASE WHEN cn = jp THEN '' ELSE cn END AS cn FROM g")
def j16_paired_fields(t: Tables) -> DataFrame:
    """Fields of two editions' records, a row for each."""
    return extract.paired_fields(*_editions(t), "p_partkey", ["p_name", "p_type"])


@query(_FIELDS + " SELECT 'parts' AS file, field, id::VARCHAR AS id, jp, CASE WHEN cn = jp THEN '' ELSE cn END AS cn FROM g UNION ALL SELECT 'regions', 'r_name', r_regionkey::VARCHAR, r_name, CASE WHEN r_regionkey = 1 THEN '' ELSE r_name || '!' END FROM region")
def j17_united(t: Tables) -> DataFrame:
    """Several files' joins in one table."""
    jp = t.region.select("r_regionkey", "r_name")
    cn = jp.select("r_regionkey", F.when(F.col("r_regionkey") == 1, F.col("r_name")).otherwise(F.concat("r_name", F.lit("!"))).alias("r_name"))
    return extract.united({"parts": (*_editions(t), "p_partkey", ["p_name", "p_type"]), "regions": (jp, cn, "r_regionkey", ["r_name"])})


def _alias_documents(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    names = F.concat(F.lit('["'), "p_name", F.when(k % 4 == 0, F.concat(F.lit('","'), F.col("p_name"))).when(k % 4 == 1, '"," x').when(k % 4 == 2, '","a\\tb').otherwise(""), F.lit('"]'))
    item = F.concat(F.lit('{"music_id":'), k, F.lit(',"aliases":'), names, F.lit("}"))
    return t.part.groupBy("p_brand").agg(F.concat(F.lit('{"musics":['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("body"))


@query("SELECT p_brand, p_partkey AS music_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN ' x' ELSE 'a' || chr(9) || 'b' END AS alias, ['repeated', 'padded', 'control'][p_partkey % 4 + 1] AS problem FROM part WHERE p_partkey % 4 < 3")
def s06_alias_problems(t: Tables) -> DataFrame:
    """Aliases of a document that must not be there."""
    return extract.alias_problems(extract.alias_rows(_alias_documents(t), "p_brand", "body"), "p_brand")


@query("SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 2 END::BIGINT AS aliases FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_brand, 0 FROM part WHERE p_partkey % 3 <> 0")
def j19_song_aliases(t: Tables) -> DataFrame:
    """Songs with the number of their aliases, by stable id."""
    n = extract.alias_rows(_alias_documents(t), "p_brand", "body").where("music_id % 3 = 0").groupBy(F.col("music_id").alias("p_partkey")).agg(F.count("*").alias("aliases"))
    return t.part.select("p_partkey", "p_brand").join(n, "p_partkey", "left").select("p_partkey", "p_brand", F.coalesce("aliases", F.lit(0)).alias("aliases"))


@query("SELECT o_orderkey, c_name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS zh FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0")
def j21_unpublished(t: Tables) -> DataFrame:
    """Documents with their localisation and catalogue row that are not published."""
    d = t.orders.select("o_orderkey", "o_custkey")
    local = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("zh"))
    published = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey")
    return d.join(local, "o_orderkey", "left").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(published, "o_orderkey", "left_anti").select("o_orderkey", "c_name", "zh")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN c_name ELSE '' END AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def j22_review_titles(t: Tables) -> DataFrame:
    """Reviews (or rooms) with their title, where the catalogue has one."""
    titles = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(titles, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("title"))


# --- choice among sources


@query("""
p AS (SELECT l_orderkey, l_linenumber % 2 AS c, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS v, min(l_suppkey) AS o FROM lineitem GROUP BY ALL),
b AS (SELECT o_orderkey AS l_orderkey, 0 AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'own' END AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(b.l_orderkey, p.l_orderkey) AS l_orderkey, coalesce(b.c, p.c)::INTEGER AS component, coalesce(b.v, p.v) AS value, CASE WHEN b.v IS NOT NULL THEN 'base' ELSE p.o::VARCHAR END AS owner
FROM b FULL JOIN (SELECT * FROM p WHERE n = 1) p ON b.l_orderkey = p.l_orderkey AND b.c = p.c""")
def g04_with_base(t: Tables) -> DataFrame:
    """What the base has stays its own; the rest comes from the smallest source that agrees."""
    rows = t.lineitem.select("l_orderkey", (F.col("l_linenumber") % 2).cast("int").alias("component"), F.col("l_returnflag").alias("value"), "l_suppkey")
    parts = compose.composed(rows, ["l_orderkey"], "component", "value", "l_suppkey", "value")
    base = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("component"), F.when(F.col("o_orderkey") % 3 == 0, "own").alias("value"))
    return compose.with_base(base, parts.withColumn("owner", F.col("owner").cast("string")), ["l_orderkey"], "component", "value")


@query("""
f AS (SELECT *, CASE WHEN l_shipmode = 'R' THEN 2 ELSE 1 END AS tier FROM (SELECT l_orderkey, l_returnflag AS l_shipmode, l_linestatus AS v, l_linenumber AS newest, l_partkey AS name FROM lineitem WHERE l_partkey % 5 <= l_linenumber)),
m AS (SELECT * FROM f QUALIFY tier = max(tier) OVER (PARTITION BY l_orderkey))
SELECT l_orderkey, tier, v AS value, newest, name, n > 1 AS conflict FROM (SELECT *, (SELECT count(DISTINCT v) FROM m i WHERE i.l_orderkey = m.l_orderkey) AS n FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY newest DESC, name) = 1)""")
def g05_picked_component(t: Tables) -> DataFrame:
    """Parts that are not stale, the preferred provider first, then the newest, then the smallest name."""
    rows = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("value"), F.col("l_linenumber").alias("newest"), F.col("l_partkey").alias("name"), (F.col("l_partkey") % 5).alias("updated"))
    return compose.picked(compose.fresh(rows, "newest", "updated"), ["l_orderkey"], "provider", "R", "value", "newest", "name")


@query("SELECT l_orderkey, l_shipdate AS at, l_partkey AS name, l_returnflag AS flag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY epoch_us(l_shipdate) DESC, l_partkey, l_returnflag) = 1")
def g06_preferred_view(t: Tables) -> DataFrame:
    """G6."""
    rows = t.lineitem.select("l_orderkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"), F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("flag"))
    got = rows.groupBy("l_orderkey", "at", "name").agg(F.min("flag").alias("flag"))
    return compose.preferred_view(got, ["l_orderkey"], "at", "name", ["flag"]).withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS agree FROM part")
def g14_credits_agree(t: Tables) -> DataFrame:
    """Every scope that states a role agrees, and one does."""
    k = F.col("p_partkey")
    scope = lambda role, found, wanted: F.struct(F.lit(role).alias("role"), found.alias("found"), wanted.alias("wanted"))
    none = F.lit(None).cast("string")
    scopes = F.array(scope("composer", F.col("p_name"), F.when(k % 4 == 2, F.upper("p_name")).when(k % 4 < 3, F.col("p_name"))), scope("arranger", F.col("p_brand"), F.when(k % 4 == 1, F.col("p_brand")).when(k % 4 == 0, "").otherwise(none)))
    return t.part.select(k, catalog.credits_agree(scopes).alias("agree"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2,7' WHEN 1 THEN '5' ELSE '' END AS ids FROM part")
def g17_performers(t: Tables) -> DataFrame:
    """Of the preferred kind, else of any."""
    k = F.col("p_partkey")
    v = lambda kind, i: F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("id"))
    vocals = F.when(k % 3 == 0, F.array(v("a", 5), v("b", 7), v("b", 2), v("b", 7), v("b", 0))).when(k % 3 == 1, F.array(v("a", 5), v("b", -1))).otherwise(F.array(v("a", 0)))
    return t.part.select(k, F.array_join(catalog.performer_ids(vocals, "b"), ",").alias("ids"))


@query("SELECT p_partkey, p_brand AS alias FROM part WHERE p_partkey % 3 <> 0 AND p_brand > 'Brand#2'")
def g18_unmapped_performers(t: Tables) -> DataFrame:
    """Names that stand for nobody; words for an ensemble don't need to."""
    names = t.part.select("p_partkey", F.explode(F.array(F.when(F.col("p_partkey") % 3 == 0, "all members").otherwise(F.col("p_brand")), F.lit("Brand#1"))).alias("alias"))
    known = t.part.where("p_brand <= 'Brand#2'").select(F.col("p_brand").alias("alias")).distinct()
    return names.where(~F.lower("alias").isin("all members", "everyone")).join(known, "alias", "left_anti").select("p_partkey", "alias")


@query("""
m AS (SELECT *, count(*) FILTER (WHERE f) OVER w AS n, coalesce(CASE WHEN count(*) FILTER (WHERE f) OVER w = 1 THEN min(CASE WHEN f THEN p_partkey END) OVER w END, min(p_partkey) OVER w) AS anchor
  FROM (SELECT p_partkey, p_brand || ' ' || p_name AS title, p_partkey % 11 = 0 AS f, p_partkey % 7 = 0 AS d, p_partkey % 13 = 0 AS i FROM part) WINDOW w AS (PARTITION BY title))
SELECT p_partkey, CASE WHEN n > 1 THEN 'multiple_explicit_full_targets' WHEN i THEN 'unsupported_instrumental' WHEN d THEN 'unsupported_medley' WHEN p_partkey = anchor THEN '' ELSE 'derived' END AS reason FROM m""")
def a20_classified(t: Tables) -> DataFrame:
    """Rows of one title with their anchor's disposition."""
    k = F.col("p_partkey")
    rows = t.part.select(k, F.concat_ws(" ", "p_brand", "p_name").alias("title"))
    return catalog.classified(rows, "p_partkey", "title", k % 11 == 0, k % 7 == 0, k % 13 == 0).select(k, "reason")


ADMITTED = """
SELECT * FROM (WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, s AS w, 1 AS n FROM a WHERE i = 1 UNION ALL SELECT a.user_id, a.event_id, a.i, CASE WHEN a.s >= r.w + 86400 THEN a.s ELSE r.w END, CASE WHEN a.s >= r.w + 86400 THEN 1 ELSE r.n + 1 END FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1)
SELECT user_id, event_id, n <= 2 AS admitted, w AS window_start FROM r)"""


@query(ADMITTED)
def q15_admitted(t: Tables) -> DataFrame:
    """Q15: windows open with the first attempt and don't slide."""
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return jobs.admitted(t.events.select("user_id", "event_id", seconds.alias("s")), "user_id", "event_id", "s", 86400, 2)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'first' ELSE 'second' END AS page FROM part WHERE p_partkey % 6 <> 1")
def o06_merged_pages(t: Tables) -> DataFrame:
    """The first page with an id counts."""
    k = F.col("p_partkey")
    a = t.part.where(k % 2 == 0).select(k, F.lit("first").alias("page"))
    b = t.part.where((k % 3 == 0) | (k % 6 == 5)).select(k, F.lit("second").alias("page"))
    return paging.merged_pages([a, b], "p_partkey").select(k, "page")


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey DESC)::INTEGER AS rank FROM part QUALIFY rank <= 25")
def o12_ranked(t: Tables) -> DataFrame:
    """A total order, so that a page is always the same."""
    return paging.ranked(t.part.select("p_partkey", "p_size"), [F.asc("p_size"), F.desc("p_partkey")], 25)


@query("SELECT p_partkey, p_partkey % 3 = 0 AS untranslated, p_partkey % 2 = 0 AS named FROM part")
def p06_known_values(t: Tables) -> DataFrame:
    """Filters over closed lists; values outside of them are refused."""
    k = F.col("p_partkey")
    source = F.when(k % 3 == 0, "llm").otherwise("human")
    return t.part.select(k, scalars.untranslated(F.lit("x"), source).alias("untranslated"), F.when(k % 2 == 0, "draft").otherwise("else").isin("none", "draft", "published").alias("named"))


@query(r"""
l AS (SELECT p_partkey, unnest(range(5)) AS n, unnest(['Miku：' || p_name || '：\Nx', ' ', '', p_name, 'Rin：']) AS line FROM part),
k AS (SELECT p_partkey, n, CASE WHEN contains(line, '：') THEN left(line, instr(line, '：') - 1) ELSE '' END AS speaker, string_split(CASE WHEN contains(line, '：') THEN substr(line, instr(line, '：') + 1) ELSE trim(line) END, '\N') AS s FROM l WHERE n <> 2)
SELECT p_partkey, n, speaker, i - 1 AS sub, s[i] AS body, i = 1 AS starts, i = len(s) AS ends FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM k)""")
def s25_script_dialogue(t: Tables) -> DataFrame:
    """Scripts with full-width colons, written line breaks and blank runs."""
    script = F.concat(F.lit("Miku："), "p_name", F.lit("：\\Nx\n \n\n"), "p_name", F.lit("\nRin："))
    found = projections.script_dialogue(t.part.select("p_partkey", script.alias("text")), "p_partkey", "text")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("n", "sub")})
