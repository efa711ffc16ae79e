"""Token counts with a digest cache.

Content and tokenizer version are digested; counts stored under both are joined, only distinct
contents without a stored count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, encoded, rows, saved, shared_dir

#: Rows of the list of repeated contents that is broadcast at most; beyond it, a shuffle join is used.
BROADCAST_ROWS = 1_000_000
#: Distinct chunks whose counts a task remembers, at most.
MEMORY = 500_000
CACHE = "tokenizer string, digest string, n_tokens long"


class Counter:
    """Counts the tokens of texts with one of the two libraries, chunk by chunk.

    For tokenizers that drop white space, the tokens of a text are those of the chunks between
    ASCII white space, so each distinct chunk is encoded once. Others encode whole texts.
    """

    def __init__(self, path: str):
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.chunks, self.many = False, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.chunks = drops_space(model)
            self.many = lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.chunks:
            return self.many([t.decode() for t in texts])
        cut = [t.split() for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = list({c for x in cut for c in x if c not in self.known})
        self.known.update(zip(fresh, self.many([c.decode() for c in fresh])))
        known = self.known.__getitem__
        return [sum(map(known, x)) for x in cut]


def drops_space(model) -> bool:
    """Whether a tokenizer's white space only separates: its parts are known and probes agree."""
    import json

    data = json.loads(model.to_str())
    added = data.get("added_tokens") or []
    before = (data.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") for p in before)
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
    probe = "a b  c\t12\n'd e"
    count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    return split and plain and count(probe) == sum(map(count, probe.split()))


@lru_cache(maxsize=4)
def load(path: str) -> Counter:
    return Counter(path)


def version_of(path: str) -> str:
    """Digest of a tokenizer file and of how it is used here."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0no special tokens, no truncation, no padding").hexdigest()


def stored(spark, cache: str) -> DataFrame:
    """The cache's rows; none where nothing was ever appended."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache)
    return spark.createDataFrame([], CACHE)


def default_cache(spark, version: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/token-counts/{version}"


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs.

    cache is a parquet folder that is read and appended to; by default token-counts/<version of the
    tokenizer> in the shared folder, so that later runs encode only texts that no earlier one met. Null texts count as empty: 0 bytes, 0 tokens. Texts that differ in ASCII white space
    alone share a digest if the tokenizer drops white space. Repeated rows repeat in the result; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    version, same = version_of(path), load(path).chunks
    cache = cache or default_cache(spark, version)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    content = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if same else text
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.sha2((F.trim(content) if same else content).cast("binary"), 256).alias("digest"))
    named = saved(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    known = stored(spark, cache).where(F.col("tokenizer") == version).select("digest").distinct()
    groups = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # Most contents occur once: mark the others' later copies and the stored ones as not to be encoded.
    again = named.join(groups.where("n > 1"), "digest").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("digest", "doc_id")
    met = named.join(known, "digest", "left_semi").select("digest", "doc_id")
    skip = saved(again.unionByName(met).distinct())
    skipped = F.broadcast(skip) if skip.count() <= BROADCAST_ROWS else skip
    left = keyed.join(skipped.withColumnRenamed("digest", "d").withColumnRenamed("doc_id", "i"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_anti")
    schema = pa.schema([("digest", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for part in by_size(batch, 1):
                yield rows(schema, digest=part.column(0), n_tokens=np.array(counter.count(list(encoded(part.column(1)))), dtype=np.int64))

    fresh = left.select("digest", "text").mapInArrow(run, "digest string, n_tokens long").dropDuplicates(["digest"])
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = stored(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return named.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
