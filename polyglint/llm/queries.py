"""The operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, crosstok, ctw, decontam, fracsketch, interaction, linededup, pii, qualityrules, simhash, tokencount, toxicity, urlfilter
from .common import held_out


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _hex64(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, cover=simhash.narrow_cover(2))
    return found.select("doc_id", _hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def url_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts by a rule: of every second domain (of three
    labels at most) a blocking entry on a day, and for some a later one that allows it again."""
    host = urlfilter.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    domain = pages.where("url is not null").select(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".").alias("domain")).distinct()
    number = F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 6), 16, 10).cast("long")
    listed = domain.select("domain", number.alias("n")).where("domain is not null and n % 2 = 0")
    block = listed.select("domain", F.lit("block").alias("action"), (F.col("n") % 300).alias("at"))
    allow = listed.where("n % 3 = 0").select("domain", F.lit("allow").alias("action"), (F.col("n") % 300 + 60).alias("at"))
    return block.unionByName(allow)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.pmod(F.col("page_id"), F.lit(365)))
    return urlfilter.judged(captures, url_entries(pages))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), documents=10, least=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.lm_scores(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 7, 2))
    return found.withColumn("held_out", held_out(F.col("doc_id"), 7, 2))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fracsketch.fingerprints(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.Settings(parts=True, phrases=True))
    printed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(printed(base).cast("binary"), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n = F.size("covered").cast("long")
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda g: F.when(g == "", g).otherwise(F.sha2(g.cast("binary"), 256))
    found = crosstok.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), shown=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qualityrules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.filter_interaction(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_url_filters, op3_bpe, op4_token_counts, op5_toxicity, op6_line_dedup, op7_lm_scores, op8_fingerprints, op9_pii, op10_decontamination, op11_cross_tokenizer, op12_quality_rules, op13_filter_audit)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": r"""
WITH p AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host, page_id % 365 AS fetched FROM pages),
d AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS domain FROM p WHERE host IS NOT NULL),
l AS (SELECT domain, ('0x' || substr(md5(domain), 1, 6))::BIGINT AS n FROM d),
e AS (SELECT domain, 'block' AS action, n % 300 AS day FROM l WHERE n % 2 = 0 UNION ALL SELECT domain, 'allow', n % 300 + 60 FROM l WHERE n % 6 = 0),
c AS (SELECT p.page_id, p.host, e.domain, e.action, e.day,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(e.domain) DESC NULLS LAST, e.day DESC NULLS LAST) AS rn
  FROM p LEFT JOIN e ON (p.host = e.domain OR p.host LIKE '%.' || e.domain) AND e.day <= p.fetched)
SELECT page_id, host, domain AS matched_domain, action, day AS valid_from, coalesce(action = 'allow', true) AS kept FROM c WHERE rn = 1""",
        "op6_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, trim({_LOWER.replace("coalesce(text, '')", "line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM r)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM r)), '')) AS kept_sha256 FROM k GROUP BY doc_id""",
        "op10_decontamination": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
        "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT d.doc_id, part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
  coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, letter, contains(fails, letter) AS failing, before <> '' AND regexp_matches(fails, '[' || before || '!]') AS gone, fails, n, good, toxic FROM c, s),
g AS (SELECT part, filter_order, step, letter, sum(n) FILTER (WHERE NOT failing AND NOT gone) AS kept, sum(n) FILTER (WHERE failing AND NOT gone) AS removed, sum(n) FILTER (WHERE failing AND gone) AS redundant,
  sum(n) FILTER (WHERE fails = letter) AS unique_fails, sum(good) FILTER (WHERE failing AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE failing AND NOT gone) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g""",
    }
