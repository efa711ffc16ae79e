"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a folder of our own,
    but only if all run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="polyglint-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a new parquet table in the shared folder; smaller than a checkpoint."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can't clash with the names we add."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def encoded(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8; null counts as empty."""
    binary = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    return (x or b"" for x in binary.to_pylist())


def by_size(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each (one row at least), so that what a task
    holds of the pieces of texts is bounded whatever their length."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def rows(schema: pa.Schema, **named: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(named[f.name], type=f.type) for f in schema], schema=schema)


def ascii_lower(text):
    """Lower-case A-Z alone with built-in functions: lower() where all is ASCII, else letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def row_digest() -> Column:
    """Digest of a row's doc_id and text, by which rows are told apart. A null id is like no other, a
    null text like an empty one."""
    name = F.col("doc_id").cast("string")
    return F.sha2(F.concat_ws(":", F.coalesce(F.length(name), F.lit(-1)).cast("string"), name, F.coalesce("text", F.lit(""))), 256)


def held_out(doc_id, modulus: int, rest: int):
    """Whether crc32 of the id's decimal text leaves the given remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
