"""How filters overlap: what each removes in every order, and each one's Shapley share.

A document's failures are one mask, so a part's documents are at most 2**k counts. The removals of a
set S of k filters are then the multilinear polynomial R(x) = sum of c_T prod(x_i, i in T), whose
coefficients follow from the counts: c_T = (-1)**(|T|+1) * (documents that fail all of T). A corner,
x_i in {0, 1}, is the number that a set removes; what stays is the part less that. The integral of
dR/dx_i along the diagonal (t, ..., t) is the sum of c_T/|T| over the T with i: the Shapley value. As
|T| divides k!, the value times k! is a sum of whole numbers, c_T * (k!/|T|), without rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER

#: Salts of rows without an id in the join with labels.
SALT = 1024
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """The failures that a text alone decides (A to D)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, ASCII_UPPER, ""))
    n = F.size(words)
    return [n < 200, F.size(F.array_distinct(words)) * 100 < n * 50, upper * 100 > F.length(text) * 2, text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> (part, mask, n, good, toxic).

    mask has bit i for filter i of ABCDE. E, an equal text under a smaller id, goes by a SHA-256 of the
    text: the smallest id of each digest is aggregated with map-side combine, and rows meet it on digest
    and id together, so that copies of one text never gather in one task. Rows without an id are no
    copies and have none; rows that repeat an id don't make each other copies. A document counts as
    good or toxic if any of its label rows says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("__text")))]
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("__text"))
    rows = rows.select("doc_id", "part", F.sha2(F.col("__text").cast("binary"), 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.crc32(F.col("digest").cast("binary")) % SALT).otherwise(0))
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = named.withColumn("salt", F.lit(0).cast("long"))
    cells = rows.join(named, ["doc_id", "salt"], "left").groupBy("digest", "doc_id", "part", "mask").agg(*_sums(F.lit(1), F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    marked = cells.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << len(bits)).otherwise(0))
    return marked.groupBy("part", "mask").agg(*_sums(*map(F.col, MEASURES)))


def _sums(*columns: Column) -> list[Column]:
    return [F.sum(c).cast("long").alias(name) for c, name in zip(columns, MEASURES)]


def polynomial(counts: np.ndarray, filters: int) -> np.ndarray:
    """counts[part, mask] -> coefficients c[part, T] of the removal polynomial; T = 0 has none."""
    c = np.zeros_like(counts)
    for t in range(1, 1 << filters):
        c[:, t] = counts[:, [m for m in range(1 << filters) if m & t == t]].sum(axis=1) * (-1) ** (t.bit_count() + 1)
    return c


def corners(c: np.ndarray, filters: int) -> np.ndarray:
    """The polynomial at x = the indicator of S, for every S: the monomials of subsets of S are 1."""
    return np.stack([c[:, [t for t in range(1 << filters) if t & s == t]].sum(axis=1) for s in range(1 << filters)], axis=1)


def diagonal_integrals(c: np.ndarray, filters: int) -> np.ndarray:
    """filters! times the integral over t of dR/dx_i at (t, ..., t): c_T contributes c_T * t**(|T|-1)."""
    share = [Fraction(factorial(filters), max(1, t.bit_count())) for t in range(1 << filters)]
    assert all(x.denominator == 1 for x in share)
    weights = np.array([int(x) for x in share], dtype=np.int64)
    return np.stack([(c * weights)[:, [t for t in range(1 << filters) if t >> i & 1]].sum(axis=1) for i in range(filters)], axis=1)


def audit(counted: DataFrame, letters: Sequence[str]) -> DataFrame:
    """(part, mask, n, good, toxic) -> one row per part, order of the letters and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (times k!). The work after the counts is one row per part; an empty table gives none.
    """
    k = len(letters)
    if not 1 <= k <= 6:
        raise ValueError("one to six filters")
    cell = F.collect_list(F.struct("mask", *MEASURES))  # at most 2**k entries
    arrays = ["total", "shapley", *(f"r_{m}" for m in MEASURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            cells = batch.column(1).flatten()
            count = {}
            for m in MEASURES:
                count[m] = np.zeros((batch.num_rows, 1 << k), dtype=np.int64)
                count[m][of, cells.field("mask").to_numpy()] = cells.field(m).to_numpy()
            c = {m: polynomial(count[m], k) for m in MEASURES}
            made = [count["n"].sum(axis=1)[:, None], diagonal_integrals(c["n"], k), *(corners(c[m], k) for m in MEASURES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), type=pa.list_(pa.int64())) for x in made)], names=["part", *arrays])

    parts = counted.groupBy("part").agg(cell.alias("cell")).mapInArrow(run, "part string, " + ", ".join(f"{x} array<long>" for x in arrays))
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(letters[j] for j in order), step, i, before))
            before |= 1 << i
    table = F.expr("array(" + ",".join(f"named_struct('filter_order','{o}','step',{s},'i',{i},'before',{b})" for o, s, i, b in steps) + ")")
    rows = parts.select("part", F.get("total", F.lit(0)).alias("total"), "shapley", *(f"r_{m}" for m in MEASURES), F.explode(table).alias("s"))
    at, before, own = (lambda m, x: F.get(f"r_{m}", x)), F.col("s.before"), F.expr("shiftleft(1, s.i)")
    after, all_but = before + own, F.lit((1 << k) - 1) - own
    lost = lambda m: at(m, after) - at(m, before)
    return rows.select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - at("n", after)).alias("kept"),
        lost("n").alias("removed"),
        (at("n", own) - lost("n")).alias("redundant"),
        (at("n", F.lit((1 << k) - 1)) - at("n", all_but)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("s.i")).alias("shapley"),
    )


def filter_interaction(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of the docstring of text_failures and masks over whole texts, audited by source.

    Null texts count as empty, null sources as the empty string; very long texts are one array of words
    in a task. Extra columns are not read.
    """
    return audit(masks(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic")), "ABCDE")
