"""The stages of corpus preparation: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each
stage's result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, decontam, linededup, neardup, toxicity
from .common import fresh_path, row_digest
from .queries import tokenizer_path


def _lengths(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted to all labelled documents here) scores below its threshold.
    Null and empty texts are scored too; repeated rows are judged alike; an empty table stays empty."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return scored.where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more, and passages (lines of 50 words or more) found in two,
    stay in the first alone; documents left without any text by that are copies of others and go.
    Documents that were blank before stay. Short lines need ten: they repeat by chance too."""
    left = linededup.line_dedup(docs, documents=10, least=1, keep_first=True, passage=50)
    return _lengths(left.where(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'").select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 0.8 similarity of five-word shingles one row of the smallest
    id stays. Rows are told apart by id and text, so a repeated id loses only the texts that are
    copies; rows without an id stay."""
    found = neardup.near_copies(docs.select("doc_id", "text"), width=5, similarity=0.8)
    gone = found.where("row <> kept_row").select(F.col("row").alias("__row")).distinct()
    kept = docs.withColumn("__row", row_digest()).join(gone, "__row", "left_anti")
    again = found.where("row = kept_row").groupBy("row").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["__row"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Null and empty texts stay, repeated rows
    are judged alike, an empty table stays empty."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10, remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with a check that they decode to it. A null text counts as empty and
    has no ids; repeated rows give repeated results; an empty table an empty one."""
    keep = ("doc_id", "lang", "source", "text")
    made = bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"), keep=keep)
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SimHash, the classifier and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
