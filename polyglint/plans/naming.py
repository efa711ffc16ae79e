"""Queries of identities and texts: the scalar items of the survey that other queries don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, scalars, unicode
from ..operators import align, catalog, stats
from .relations import Tables, query


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'A1 ' || p_name || ' (x)' END AS identity FROM part")
def f01_identity_text(t: Tables) -> DataFrame:
    """F1."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 5 == 0, "　- ").when(k % 7 != 0, F.concat(F.lit("　Ａ１ \t "), name, F.lit(" \n（ｘ）　")))
    return t.part.select(k, unicode.identity_text_udf(raw).alias("identity"))


@query("SELECT p_partkey, 'hello=' || replace(p_name, ' ', '') || '?' AS work FROM part")
def f02_work_text(t: Tables) -> DataFrame:
    """F2."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return t.part.select(k, unicode.work_text_udf(F.concat(F.lit("Ｈｅｌｌｏ=-"), F.initcap(name), F.lit("!・？"))).alias("work"))


@query("SELECT s_suppkey, lower(replace(s_name, '#', '')) || 'ミク' AS alias FROM supplier")
def f03_alias_text(t: Tables) -> DataFrame:
    """F3."""
    return t.supplier.select("s_suppkey", unicode.alias_text_udf(F.concat("s_name", F.lit("・ﾐｸ="))).alias("alias"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || '&"x"...' END AS title FROM part""")
def f04_canonical_title(t: Tables) -> DataFrame:
    """control characters spoil a title."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.concat(name, F.when(k % 4 == 0, "\x01").otherwise(""), F.lit(" &amp; “x”…"))
    return t.part.select(k, unicode.canonical_title_udf(raw).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' x)' ELSE p_name END AS head, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || ' (x)' END AS inside FROM part")
def f05_trailing_parenthesis(t: Tables) -> DataFrame:
    """F5."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 3 == 0, F.concat(name, F.lit(" x)"))).otherwise(F.concat(name, F.lit(" ("), "p_brand", F.lit(" (x))")))
    return t.part.withColumn("x", unicode.trailing_parenthesis_udf(raw)).select(k, F.col("x")[0].alias("head"), F.col("x")[1].alias("inside"))


@query("SELECT p_partkey, p_name || '|(a/b)|' || p_brand AS parts FROM part")
def f06_slash_parts(t: Tables) -> DataFrame:
    """F6."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return t.part.select(k, F.array_join(unicode.top_level_parts_udf(F.concat(name, F.lit(" / (a/b) 、 / "), "p_brand")), "|").alias("parts"))


@query("SELECT p_partkey, p_partkey % 4 < 2 AS reserved FROM part")
def f07_reserved(t: Tables) -> DataFrame:
    """tokens count as a whole, other words anywhere."""
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 4 == 0, "(LIVE) ver").when(k % 4 == 1, "Semiacoustic").when(k % 4 == 2, "alive").otherwise(name)
    return t.part.select(k, catalog.reserved(text, ["remix", "live"], ["acoustic"]).alias("reserved"))


@query("SELECT p_partkey, lower(replace(p_brand, '#', '')) || '|miku' AS contributors FROM part")
def f11_contributors(t: Tables) -> DataFrame:
    """F11."""
    k = F.col("p_partkey")
    return t.part.select(k, F.array_join(unicode.split_contributors_udf(F.concat("p_brand", F.lit(" & Ｍｉｋｕ, "), F.lower("p_brand"))), "|").alias("contributors"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS name, CASE WHEN p_partkey % 4 = 0 THEN true WHEN p_partkey % 4 = 1 THEN false END AS flag FROM part")
def f17_json_values(t: Tables) -> DataFrame:
    """a text or truth value of another type is none."""
    k, name = F.col("p_partkey"), F.col("p_name")
    given = F.when(k % 3 == 0, F.concat(F.lit('"'), name, F.lit('"'))).when(k % 3 == 1, "7").otherwise("null")
    flag = F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").when(k % 4 == 2, '"true"').otherwise("1")
    body = F.concat(F.lit('{"name":'), given, F.lit(',"flag":'), flag, F.lit("}"))
    return t.part.select(k, scalars.json_text(body, "$.name").alias("name"), scalars.json_flag(body, "$.flag").alias("flag"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_type ELSE p_type END AS shown FROM part")
def f20_display_name(t: Tables) -> DataFrame:
    """F20."""
    k, name = F.col("p_partkey"), F.col("p_name")
    given = F.when(k % 3 == 0, F.concat(name, F.lit(" "))).when(k % 3 == 1, " ")
    return t.part.select(k, scalars.display_name(given, F.when(k % 3 != 2, F.col("p_brand")), F.col("p_type")).alias("shown"))


@query("""SELECT p_partkey, sha256('v1:{"f0":"' || p_name || '","f1":"' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END || '","f2":"' || p_partkey || '"}') AS fingerprint FROM part""")
def f23_fingerprint(t: Tables) -> DataFrame:
    """null and '' are one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return t.part.select(k, catalog.fingerprint(name, F.when(k % 3 != 0, F.col("p_brand")), k).alias("fingerprint"))


@query("SELECT conv_id, sha256(unhex(string_agg(printf('%016X', octet_length(encode(role))) || hex(encode(role)), '' ORDER BY turn, role))) AS hash FROM conversations GROUP BY conv_id")
def f25_lines_hash(t: Tables) -> DataFrame:
    """F25."""
    return stats.framed_digest(t.conversations, ["conv_id"], "turn", "role", "hash")


@query("SELECT conv_id, sha256('lines/v1' || chr(10) || string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def f26_extracted_digest(t: Tables) -> DataFrame:
    """F26."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.conversations.groupBy("conv_id").agg(scalars.envelope_digest(lines, "lines/v1").alias("digest"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 1000 END AS seconds FROM orders")
def f30_timestamps(t: Tables) -> DataFrame:
    """another form of the same time is refused."""
    k = F.col("o_orderkey")
    right = scalars.rfc3339(k * 1000)
    text = F.when(k % 3 == 0, right).when(k % 3 == 1, F.replace(right, F.lit("Z"), F.lit("+00:00"))).otherwise("2024-02-30T00:00:00Z")
    return t.orders.select(k, F.unix_seconds(scalars.canonical_timestamp(text)).alias("seconds"))


@query("SELECT p_partkey, (length(p_name) + 2)::INTEGER AS n FROM part")
def f33_graphemes(t: Tables) -> DataFrame:
    """F33."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return t.part.select(k, F.size(scalars.graphemes(F.concat(F.lit("é"), name, F.lit("が")))).alias("n"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS rebuilt FROM part")
def f34_rebuilt(t: Tables) -> DataFrame:
    """parts that cut a grapheme, or make up another text, don't count."""
    k, name = F.col("p_partkey"), F.col("p_name")
    cut = F.when(k % 3 == 0, F.array(name, F.lit("é"))).when(k % 3 == 1, F.array(F.concat(name, F.lit("e")), F.lit("́"))).otherwise(F.array(name, F.lit("e")))
    return t.part.select(k, scalars.rebuilt(cut, F.concat(name, F.lit("é"))).alias("rebuilt"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS reading, p_partkey % 4 = 2 AS han FROM part")
def f36_readings(t: Tables) -> DataFrame:
    """F36."""
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 4 == 0, "かなー").when(k % 4 == 1, "カナ・カナ").when(k % 4 == 2, "漢かな").otherwise(name)
    return t.part.select(k, scalars.valid_reading(text).alias("reading"), scalars.has_han(text).alias("han"))


@query("SELECT p_partkey, p_name || ' ' || p_brand || ' x' AS plain FROM part")
def f42_wiki_text(t: Tables) -> DataFrame:
    """F42."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.concat(F.lit(" '''"), name, F.lit("''' [[Page|"), "p_brand", F.lit(']]<ref name="a">note</ref><!-- no\nmore --> <b>[[x]]</b> '))
    return t.part.select(k, scalars.wiki_text(raw).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS shown FROM part")
def p07_display_text(t: Tables) -> DataFrame:
    """P7."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return t.part.select(k, scalars.display_text(F.when(k % 3 == 0, name).when(k % 3 == 1, ""), F.col("p_brand")).alias("shown"))


@query("SELECT category, field, jp_key, cn_text = '' OR source IN ('unknown', 'llm') AS untranslated FROM entries")
def p11_console_untranslated(t: Tables) -> DataFrame:
    """P11."""
    return t.entries.select("category", "field", "jp_key", scalars.untranslated(F.nullif(F.col("cn_text"), F.lit("")), F.col("source")).alias("untranslated"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS instrumental FROM part")
def p15_instrumental(t: Tables) -> DataFrame:
    """Vocals are given, all of them instrumental, and nobody wrote lyrics."""
    k, name = F.col("p_partkey"), F.col("p_name")
    one, none = F.array(F.lit("instrumental"), F.lit("instrumental")), F.array().cast("array<string>")
    vocals = F.when(k % 4 < 2, one).when(k % 4 == 2, none).otherwise(F.array(F.lit("instrumental"), F.lit("sekai")))
    return t.part.select(k, scalars.scenario_sound(vocals, F.when(k % 4 == 1, name).when(k % 8 == 0, " - ")).alias("instrumental"))


@query("SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AS restricted FROM part")
def p18_restricted(t: Tables) -> DataFrame:
    """By a mark in the text or by a category."""
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 3 == 0, "[[x]] Lyrics removed by request").otherwise(name)
    categories = F.when(k % 3 == 1, F.array(F.lit("Songs"), F.lit("Restricted lyrics"))).otherwise(F.array(F.lit("Songs")))
    marks = ["removed by request", "Restricted lyrics"]
    return t.part.select(k, (scalars.contains_any(scalars.wiki_text(text), marks) | F.exists(categories, lambda c: scalars.contains_any(c, marks))).alias("restricted"))


@query("SELECT p_partkey, p_partkey % 5 < 4 AS matches FROM part")
def p19_title_matches(t: Tables) -> DataFrame:
    """As a whole, by what stands in a trailing parenthesis or before it, or before a creator."""
    k, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(k % 5 == 0, F.concat(name, F.lit(" (other)"))).when(k % 5 == 1, F.concat(F.lit("Other ("), F.upper(name), F.lit(")"))).when(k % 5 == 2, F.concat(name, F.lit(" / Someone"))).when(k % 5 == 3, name).otherwise(F.concat(name, F.lit(" zwei")))
    return t.part.select(k, unicode.title_matches_udf(title, name).alias("matches"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS sound FROM part")
def s10_unique_json(t: Tables) -> DataFrame:
    """Keys repeated at any depth, and texts that are no JSON, are refused."""
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, '{"a":{"b":1},"b":[{"a":1}]}').when(k % 3 == 1, '{"a":[{"b":1,"b":2}]}').otherwise('{"a":')
    return t.part.select(k, unicode.unique_json_udf(body).alias("sound"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN '{"a":[1,"' || p_name || '"],"b":"\\u003cx\\u003e\\u0026"}' END AS body FROM part""")
def n01_canonical_json(t: Tables) -> DataFrame:
    """One form for one value; what is no JSON has none."""
    k, name = F.col("p_partkey"), F.col("p_name")
    body = F.when(k % 5 == 0, "{").otherwise(F.concat(F.lit('{ "b":"<x>&", "a":[1, "'), name, F.lit('"]}')))
    return t.part.select(k, canonical.canonical_json_udf(body).alias("body"))


@query("""
r AS (SELECT p_partkey, p_name, p_size, p_brand, CASE WHEN p_size % 2 = 0 THEN p_size * 1000000000000000000000 ELSE p_size END AS n FROM part),
c AS (SELECT *, '{"ScenarioId":"' || p_brand || '","Snippets":[{"Action":' || CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size < 10 THEN p_size::VARCHAR WHEN p_size % 10 = 0 THEN (p_size // 10)::VARCHAR ELSE (p_size // 10) || '.' || (p_size % 10) END || 'e+' || CASE WHEN p_size < 10 THEN 21 ELSE 22 END ELSE p_size::VARCHAR END
  || ',"Text":"' || p_name || ' \\u003cb\\u003e"}],"TalkData":[],"SpecialEffectData":[],"AppearCharacters":[0.5]}' AS form FROM r)
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'id_mismatch' WHEN p_size = 2 THEN 'not_array:TalkData' END AS problem, CASE WHEN p_size > 2 THEN form END AS form, CASE WHEN p_size > 2 THEN sha256(form) END AS sha256,
  CASE WHEN p_size <= 2 THEN 'digest_mismatch' WHEN p_size % 2 = 0 THEN NULL ELSE 'not_canonical' END AS stored_problem FROM c""")
def n02_scenarios(t: Tables) -> DataFrame:
    """The five fields in fixed order, and stored forms held against them; those of odd sizes keep
    a number as it was written."""
    size = F.col("p_size").cast("string")
    number = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit("e21"))).otherwise(F.concat(size, F.lit(".0")))
    talk = F.when(F.col("p_size") == 2, "{}").otherwise("[]")
    body = F.concat(F.lit('{ "TalkData": '), talk, F.lit(', "More": 1, "Snippets": [{"Text": "'), "p_name", F.lit(' <b>", "Action": '), number, F.lit('}], "AppearCharacters": [5e-1], "SpecialEffectData": [], "ScenarioId": "'), "p_brand", F.lit('"}'))
    # Dealt anew: the table is small beside the work on a row, so its few splits would leave cores idle.
    part = t.part.select("p_partkey", "p_name", "p_size", "p_brand").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    made = part.select("p_partkey", "p_size", "p_brand", number.alias("number"), canonical.scenario_form_udf(body, F.when(F.col("p_size") == 1, "another").otherwise(F.col("p_brand"))).alias("f"))
    stored = F.when(F.col("p_size") % 2 == 1, F.regexp_replace("f.body", r'("Action":)[^,]*', F.concat(F.lit("$1"), "number"))).otherwise(F.col("f.body"))
    made = made.withColumn("stored", F.coalesce(stored, F.lit("")))
    problem = canonical.stored_problem_udf(F.lit(1), F.lit("1"), "p_brand", "stored", F.when(F.col("p_size") <= 2, "x").otherwise(F.sha2(F.col("stored").cast("binary"), 256)))
    return made.select("p_partkey", "f.problem", F.col("f.body").alias("form"), "f.sha256", problem.alias("stored_problem"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(['a', trim(p_name)])), '|') AS names FROM part")
def o13_canonical_set(t: Tables) -> DataFrame:
    """O13."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.array(F.concat(F.lit(" "), name), F.lit("a"), F.lit(" "), F.lit(None).cast("string"), name, F.lit("a "))
    return t.part.select(k, F.array_join(scalars.canonical_set(raw), "|").alias("names"))


@query("SELECT p_partkey, p_name || ' (' || p_brand || ')|' || p_name || '|' || p_brand AS variants FROM part")
def g12_title_variants(t: Tables) -> DataFrame:
    """G12."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return t.part.select(k, F.array_join(scalars.title_variants(F.concat(name, F.lit(" ("), "p_brand", F.lit(")"))), "|").alias("variants"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'mapped' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'conflict' WHEN 3 THEN 'full_only' WHEN 4 THEN 'game_only' ELSE 'none' END AS outcome FROM part")
def g02_version_evidence(t: Tables) -> DataFrame:
    """The status comes from the subsequence mapping itself."""
    k = F.col("p_partkey")
    words = lambda s: F.split(F.lit(s), " ")
    none = F.lit(None).cast("array<string>")
    full = F.when(k % 6 == 0, words("a b c")).when(k % 6 == 1, words("a a c")).when(k % 6 < 4, words("a b c")).otherwise(none)
    game = F.when(k % 6 == 0, words("a c")).when(k % 6 == 1, words("a c")).when(k % 6 == 2, words("x")).when(k % 6 == 4, words("a")).otherwise(none)
    made = t.part.select(k, full.alias("f"), game.alias("g")).withColumn("s", align.subsequence_udf("g", "f"))
    return made.select(k, align.version_evidence(F.col("f"), F.col("g"), F.col("s.status")).alias("outcome"))
