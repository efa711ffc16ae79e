"""Localization relations derived from the driver's tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOCALE = "en-US"


class Tables:
    """The driver's tables by name, and the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    @property
    def keyed(self) -> DataFrame:
        """One row for each (category, field, jp_key), with the largest part number of the key."""
        return self.part.groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("field"), F.col("p_name").alias("jp_key")).agg(F.max("p_partkey").alias("p"))

    @property
    def entries(self) -> DataFrame:
        source = F.element_at(F.array(*map(F.lit, ("cn", "human", "pinned", "llm", "unknown", "other"))), (F.col("p") % 6 + 1).cast("int"))
        text = F.when(F.col("p") % 7 == 0, "").otherwise(F.upper("jp_key"))
        return self.keyed.select("category", "field", "jp_key", text.alias("cn_text"), source.alias("source"), F.array(F.col("p").cast("string")).alias("ids"), F.col("p").alias("updated_at"), "p")

    @property
    def overlay(self) -> DataFrame:
        """Texts of one locale for a third of the entries, and some whose entry is gone."""
        own = self.keyed.where("p % 3 = 0").select("category", "field", "jp_key", F.lower("jp_key").alias("text"), F.when(F.col("p") % 2 == 0, "human").otherwise("llm").alias("source"), (F.col("p") % 4 + 1).alias("revision"))
        gone = self.supplier.select(F.lit("orphan").alias("category"), F.lit("supplier").alias("field"), F.col("s_name").alias("jp_key"), F.lower("s_name").alias("text"), F.lit("human").alias("source"), F.lit(1).cast("bigint").alias("revision"))
        return own.unionByName(gone).withColumn("locale", F.lit(LOCALE))

    @property
    def official(self) -> DataFrame:
        """Official texts: of most entries (some empty, some repeating the key), some keys alone, and trace-only rows."""
        text = F.when(F.col("p") % 4 == 0, "").when(F.col("p") % 5 == 0, F.col("jp_key")).otherwise(F.concat("jp_key", F.lit("-cn")))
        own = self.keyed.where("p % 8 <> 7").select("category", "field", "jp_key", F.when(F.col("p") % 13 == 0, None).otherwise(text).alias("cn_text"), F.array(F.col("p").cast("string"), F.lit("x")).alias("ids"))
        new = self.keyed.where("p % 11 = 0").select("category", "field", F.concat("jp_key", F.lit("-new")).alias("jp_key"), text.alias("cn_text"), F.array(F.lit("n")).alias("ids"))
        return own.unionByName(new)

    @property
    def pairs(self) -> DataFrame:
        """Entries of one category with two fields for a third of the keys."""
        base = self.entries.select(F.lit("cards").alias("category"), F.concat_ws(":", "jp_key", "category", "field").alias("jp_key"), "cn_text", "source", "p")
        a = base.withColumn("field", F.lit("prefix"))
        b = base.where("p % 3 = 0").withColumn("field", F.lit("gacha")).withColumn("cn_text", F.when(F.col("p") % 2 == 0, F.col("cn_text")).otherwise(F.lower("jp_key"))).withColumn("source", F.lit("llm"))
        return a.unionByName(b).select("category", "field", "jp_key", "cn_text", "source")

    @property
    def lines(self) -> DataFrame:
        """Story lines: event, episode, position, segment, text."""
        return self.conversations.select(F.col("conv_id").alias("event_id"), F.col("role").alias("episode"), F.col("turn").alias("position"), F.concat_ws(":", "conv_id", "turn").alias("segment_id"), "text")

    @property
    def localized(self) -> DataFrame:
        """Localised segments of the lines."""
        text = F.when(F.col("position") % 6 == 0, "").otherwise(F.concat(F.lit("~"), "text"))
        source = F.when(F.col("position") % 2 == 0, "cn").otherwise("human")
        return self.lines.where("position % 4 <> 3").select("segment_id", F.lit(LOCALE).alias("locale"), text.alias("text"), source.alias("source"), (F.col("position") + 1000).alias("updated_at"))

    @property
    def jobs(self) -> DataFrame:
        """A lease queue made from orders."""
        k = F.col("o_orderkey")
        state = F.when(k % 5 == 0, "leased").when(k % 5 == 1, "retry_wait").when(k % 5 == 2, "completed").otherwise("pending")
        out = self.orders.select(k.alias("job_id"), state.alias("state"), (k % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), (k * 37 % 1000).alias("next_attempt_at"), (k % 3 + 1).cast("int").alias("version"))
        leased = F.col("state") == "leased"
        return out.withColumns({"lease_owner": F.when(leased, F.concat(F.lit("w"), F.col("job_id") % 3)), "lease_expires_at": F.when(leased, F.col("job_id") * 13 % 1000)})


_RELATIONS = """
keyed AS (SELECT p_brand AS category, p_type AS field, p_name AS jp_key, max(p_partkey) AS p FROM part GROUP BY ALL),
entries AS (SELECT category, field, jp_key, CASE WHEN p % 7 = 0 THEN '' ELSE upper(jp_key) END AS cn_text, ['cn', 'human', 'pinned', 'llm', 'unknown', 'other'][p % 6 + 1] AS source, [p::VARCHAR] AS ids, p AS updated_at, p FROM keyed),
overlay AS (SELECT category, field, jp_key, lower(jp_key) AS text, CASE WHEN p % 2 = 0 THEN 'human' ELSE 'llm' END AS source, p % 4 + 1 AS revision FROM keyed WHERE p % 3 = 0
  UNION ALL SELECT 'orphan', 'supplier', s_name, lower(s_name), 'human', 1 FROM supplier),
official AS (SELECT category, field, jp_key, CASE WHEN p % 13 = 0 THEN NULL WHEN p % 4 = 0 THEN '' WHEN p % 5 = 0 THEN jp_key ELSE jp_key || '-cn' END AS cn_text, [p::VARCHAR, 'x'] AS ids FROM keyed WHERE p % 8 <> 7
  UNION ALL SELECT category, field, jp_key || '-new', CASE WHEN p % 4 = 0 THEN '' WHEN p % 5 = 0 THEN jp_key ELSE jp_key || '-cn' END, ['n'] FROM keyed WHERE p % 11 = 0),
pair_base AS (SELECT 'cards' AS category, jp_key || ':' || category || ':' || field AS jp_key, cn_text, source, p FROM entries),
pairs AS (SELECT category, 'prefix' AS field, jp_key, cn_text, source FROM pair_base
  UNION ALL SELECT category, 'gacha', jp_key, CASE WHEN p % 2 = 0 THEN cn_text ELSE lower(jp_key) END, 'llm' FROM pair_base WHERE p % 3 = 0),
lines AS (SELECT conv_id AS event_id, role AS episode, turn AS position, conv_id || ':' || turn AS segment_id, text FROM conversations),
localized AS (SELECT segment_id, CASE WHEN position % 6 = 0 THEN '' ELSE '~' || text END AS text, CASE WHEN position % 2 = 0 THEN 'cn' ELSE 'human' END AS source, position + 1000 AS updated_at FROM lines WHERE position % 4 <> 3),
jobs AS (SELECT *, CASE WHEN state = 'leased' THEN 'w' || job_id % 3 END AS lease_owner, CASE WHEN state = 'leased' THEN job_id * 13 % 1000 END AS lease_expires_at FROM (
  SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'leased' WHEN 1 THEN 'retry_wait' WHEN 2 THEN 'completed' ELSE 'pending' END AS state, (o_orderkey % 4)::INTEGER AS attempts, 3 AS max_attempts, o_orderkey * 37 % 1000 AS next_attempt_at, (o_orderkey % 3 + 1)::INTEGER AS version FROM orders))
"""


def query(sql: str | None = None):
    """Register a function of Tables under its name; sql is the statement (or more relations and a statement) of the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = f"WITH {_RELATIONS.strip()}{' ' if sql.strip()[:6].upper() == 'SELECT' else ', '}{sql.strip()}"
        return f

    return register
