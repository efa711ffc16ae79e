"""Staged imports and publishing: write beside, verify, then publish by one new manifest.

A store is a folder with staged parts and numbered manifests. A manifest names the parts of every
table; the highest one is what readers see. Publishing renames one file to the next number and fails
where that number is taken, so that it happens wholly or not at all, and never over another's. Parts
that no manifest names are left-overs of runs that did not publish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outcomes that let a batch go on; any other refuses the whole batch.
GOOD = ("inserted", "replayed")


def outcomes(current: DataFrame, items: DataFrame, catalog: DataFrame, key: str, values: list[str], identity: list[str]) -> DataFrame:
    """items -> (key, outcome), one row per item: repeated in the manifest, drift (the catalogue has not
    this identity for the key), inserted, replayed (current has the same values) or conflict.

    Nulls compare as values; an item without a key drifts."""
    counted = items.groupBy(key).agg(F.count("*").alias("__n"), *(F.max(F.struct(c))[c].alias(c) for c in [*identity, *values]))
    known = catalog.select(F.col(key).alias("__k"), F.struct(*identity).alias("__i")).dropDuplicates(["__k"])
    held = current.select(F.col(key).alias("__h"), F.struct(*values).alias("__v"))
    joined = counted.join(known, F.col(key) == F.col("__k"), "left").join(held, F.col(key) == F.col("__h"), "left")
    same = lambda struct, columns: F.struct(*columns).eqNullSafe(F.col(struct))
    outcome = F.when(F.col("__n") > 1, "repeated").when(F.col("__k").isNull() | ~same("__i", identity), "drift").when(F.col("__h").isNull(), "inserted").when(same("__v", values), "replayed").otherwise("conflict")
    return joined.select(key, outcome.alias("outcome"), F.col("__n").alias("n")).select(key, "outcome", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("__x")).drop("__x")


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table as a multiset of rows: sums of the four parts of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))).cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
    found = df.select(row.alias("h")).agg(F.count("*").alias("n"), *map(part, range(4))).first()
    return found["n"], "-".join(str(found[f"s{i}"] or 0) for i in range(4))


@dataclass(frozen=True)
class Staged:
    """Parts written for a batch: by table, whether it replaces the table, and (path, rows, digest)."""

    batch: str
    base: int
    tables: Mapping[str, tuple[bool, str, int, str]]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.root)).toUri(), self._conf)

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for f in self._fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json"))

    def manifest(self, generation: int | None = None) -> dict:
        """A generation's manifest, the newest by default; before the first one, an empty one."""
        numbers = self._numbers()
        at = max(numbers, default=0) if generation is None else generation
        if at == 0:
            return {"generation": 0, "batch": None, "tables": {}}
        body = self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{at:012d}.json").first()[0]
        return json.loads(body)

    def read(self, name: str, schema: str | None = None, generation: int | None = None) -> DataFrame:
        """A table of a generation; an empty one of the schema where there is none yet."""
        parts = self.manifest(generation)["tables"].get(name, {"parts": []})["parts"]
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.root}/{p['path']}" for p in parts))

    def stage(self, batch: str, added: Mapping[str, DataFrame] | None = None, replaced: Mapping[str, DataFrame] | None = None) -> Staged:
        """Write a batch's tables beside what is published: rows to add to tables, or their new whole."""
        tables = {}
        base = self.manifest()["generation"]
        for whole, given in ((False, added or {}), (True, replaced or {})):
            for name, df in given.items():
                path = f"stage/{name}/{uuid.uuid4().hex}"
                df.write.parquet(f"{self.root}/{path}")
                tables[name] = (whole, path, *digest(df))
        return Staged(batch, base, tables)

    def problems(self, staged: Staged) -> list[str]:
        """Tables whose written part is not what was to be written (another count or digest of its rows)."""
        return [name for name, (_, path, rows, sums) in staged.tables.items() if digest(self.spark.read.parquet(f"{self.root}/{path}")) != (rows, sums)]

    def publish(self, staged: Staged) -> str:
        """published; damaged, where a part fails its digest; stale, where another batch came first."""
        if self.problems(staged):
            return "damaged"
        last = self.manifest(staged.base)
        tables = dict(last["tables"])
        for name, (whole, path, rows, sums) in staged.tables.items():
            own = {"path": path, "rows": rows, "digest": sums}
            tables[name] = {"parts": [own] if whole else [*tables.get(name, {"parts": []})["parts"], own]}
        body = json.dumps({"generation": staged.base + 1, "batch": staged.batch, "tables": tables}, sort_keys=True)
        made = self._path(f"{self.root}/stage/manifest-{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(made, self._path(f"{self.root}/manifests/{staged.base + 1:012d}.json"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(made, False)
            return "stale"
        return "published"

    def left_over(self) -> list[str]:
        """Staged parts that no generation names: those of runs that did not publish, or still run."""
        named = {p["path"] for n in self._numbers() for t in self.manifest(n)["tables"].values() for p in t["parts"]}
        folder = self._path(f"{self.root}/stage")
        if not self._fs.exists(folder):
            return []
        found = [f"stage/{d.getPath().getName()}/{f.getPath().getName()}" for d in self._fs.listStatus(folder) if d.isDirectory() for f in self._fs.listStatus(d.getPath())]
        return sorted(set(found) - named)

    def swept(self) -> int:
        """Delete the left-overs; only where no other run stages."""
        gone = self.left_over()
        for path in gone:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return len(gone)


def import_batch(
    store: Store, batch: str, name: str, items: DataFrame, catalog: DataFrame, key: str, values: list[str], identity: list[str], catalog_count: int, before_publish: Callable[[Staged], None] | None = None
) -> tuple[str, DataFrame]:
    """Import a manifest's items into a table: (state, outcomes).

    catalog_drift if the catalogue has another size than the manifest was made for; refused if an item
    is neither inserted nor replayed; replayed if all are there already; else as Store.publish says.
    Only the inserted rows are written. A run that fails before the manifest is renamed, or is repeated
    after it, changes nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(key, *values).schema)
    found = outcomes(store.read(name, schema), items, catalog, key, values, identity)
    if catalog.count() != catalog_count:
        return "catalog_drift", found
    counts = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}  # five outcomes at most
    if set(counts) - set(GOOD):
        return "refused", found
    if not counts.get("inserted"):
        return "replayed", found
    fresh = items.join(found.where("outcome = 'inserted'").select(key), key, "left_semi").select(key, *values)
    staged = store.stage(batch, added={name: fresh})
    if before_publish is not None:
        before_publish(staged)
    return store.publish(staged), found


def write_all(store: Store, batch: str, documents: DataFrame, name: str = "files") -> str:
    """Publish the whole set of (path, body) documents as a new generation of one table; a path that is
    repeated or empty refuses the set, and the former generation stays."""
    faults = documents.groupBy("path").count().where("count > 1 or path is null or path = ''")
    if not faults.isEmpty():
        return "refused"
    return store.publish(store.stage(batch, replaced={name: documents.select("path", "body")}))


def exported(store: Store, folder: str, name: str = "files") -> None:
    """The newest generation's documents as text files, one folder per path, through Spark's committer."""
    store.read(name, "path string, body string").repartition("path").write.mode("overwrite").partitionBy("path").text(folder)
