"""Sequence alignment: unique subsequences and global alignment of script rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import shared_folder


def subsequence(part: Sequence, whole: Sequence) -> tuple[str, list[int]]:
    """Where part stands in whole as a subsequence: unique, ambiguous or missing. It is unique exactly
    if the earliest and the latest choice are the same."""
    early, at = [], 0
    for x in part:
        while at < len(whole) and whole[at] != x:
            at += 1
        if at == len(whole):
            return "missing", []
        early.append(at)
        at += 1
    late, at = [], len(whole) - 1
    for x in reversed(part):
        while whole[at] != x:
            at -= 1
        late.append(at)
        at -= 1
    return ("unique", early) if early == late[::-1] else ("ambiguous", [])


@F.pandas_udf(StructType([StructField("status", StringType()), StructField("positions", ArrayType(IntegerType()))]))
def subsequence_udf(part: pd.Series, whole: pd.Series) -> pd.DataFrame:
    """Columns of arrays; null counts as an empty array."""
    return pd.DataFrame([subsequence([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(part, whole)], columns=["status", "positions"])


def version_evidence(full: Column, game: Column, status: Column) -> Column:
    """Outcome of full and game lines: both with a mapping, both without one, one of them, none."""
    f, g = F.coalesce(F.size(full), F.lit(0)) > 0, F.coalesce(F.size(game), F.lit(0)) > 0
    return F.when(f & g & (status == "unique"), "mapped").when(f & g & (status == "ambiguous"), "ambiguous").when(f & g, "conflict").when(f, "full_only").when(g, "game_only").otherwise("none")


#: Points of a pair (fixed values): same text and speaker, same text, same speaker, same kind.
POINTS = (15, 12, 7, 6)
GAP = 0
MOST_ROWS, MOST_CELLS = 2000, 1_000_000


def points(a: tuple, b: tuple) -> float:
    """Points of two rows (kind, speaker, text); minus infinity for different kinds."""
    if a[0] != b[0]:
        return -np.inf
    if a[2] == b[2]:
        return POINTS[0] if a[1] == b[1] else POINTS[1]
    return POINTS[2] if a[1] == b[1] and a[1] else POINTS[3]


def alignment(left: list[tuple], right: list[tuple], gap: float = GAP) -> list[tuple[int, int]]:
    """Pairs on some best global alignment that are each other's only candidate."""
    n, m = len(left), len(right)
    score = np.array([[points(a, b) for b in right] for a in left], dtype=float).reshape(n, m)

    def table(s: np.ndarray) -> np.ndarray:
        best = np.zeros((s.shape[0] + 1, s.shape[1] + 1))
        best[0] = -gap * np.arange(s.shape[1] + 1)
        for i in range(1, s.shape[0] + 1):
            row = np.maximum(best[i - 1, 1:] - gap, best[i - 1, :-1] + s[i - 1])
            best[i, 0] = -gap * i
            # The best with gaps to the left is a running maximum.
            shift = gap * np.arange(s.shape[1] + 1)
            best[i] = np.maximum.accumulate(np.r_[best[i, 0], row] + shift) - shift
        return best

    head, tail = table(score), table(score[::-1, ::-1])[::-1, ::-1]
    on = np.isfinite(score) & np.isclose(head[:-1, :-1] + score + tail[1:, 1:], head[-1, -1])
    alone = on & (on.sum(0) == 1)[None, :] & (on.sum(1) == 1)[:, None]
    return [(int(i), int(j)) for i, j in np.argwhere(alone)]


def aligned(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, side left/right, position, kind, speaker, text) -> (key, left, right, status) where
    status is matched, or too_large for groups beyond the bounds (with null positions)."""

    kind = dict(rows.dtypes)[key]
    schema = StructType([rows.schema[key], StructField("left", LongType()), StructField("right", LongType()), StructField("status", StringType())])
    arrow = to_arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        # Plain lists: most groups are a few rows, for which a data frame costs more than the alignment.
        order = pc.sort_indices(group, sort_keys=[("position", "ascending")])
        side, position, *of = (group.column(n).take(order).to_pylist() for n in ("side", "position", "kind", "speaker", "text"))
        of = list(zip(*of))
        places = [[i for i, x in enumerate(side) if x == s] for s in ("left", "right")]
        n, m = map(len, places)

        def given(left: list, right: list, status: str) -> pa.Table:
            names = group.column(key).slice(0, 1).to_pylist() * len(left)
            return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip((names, left, right, [status] * len(left)), arrow)], names=arrow.names)

        if max(n, m) > MOST_ROWS or n * m > MOST_CELLS:
            return given([None], [None], "too_large")
        pairs = alignment(*([of[i] for i in at] for at in places)) if n and m else []
        return given([position[places[0][i]] for i, _ in pairs], [position[places[1][j]] for _, j in pairs], "matched")

    return rows.select(key, "side", "position", "kind", "speaker", "text").groupBy(key).applyInArrow(run, f"{key} {kind}, left bigint, right bigint, status string")


def preview(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Each row by what an import would do: matched, conflict (other text), missing (a left row without
    a partner), unmatched (a right one); too_large for all rows of groups beyond the bounds. The pairs
    are written to the shared folder first, as four joins read them."""
    path = shared_folder(pairs.sparkSession, "pairs")
    pairs.write.parquet(path)
    pairs = pairs.sparkSession.read.schema(pairs.schema).parquet(path)
    left = rows.where("side = 'left'").select(key, F.col("position").alias("left"), F.col("text").alias("left_text"))
    right = rows.where("side = 'right'").select(key, F.col("position").alias("right"), F.col("text").alias("right_text"))
    found = pairs.where("status = 'matched'").select(key, "left", "right")
    large = pairs.where("status = 'too_large'").select(key, F.lit(True).alias("__large"))
    joined = left.join(found, [key, "left"], "left").join(right, [key, "right"], "left").join(large, key, "left")
    outcome = F.when(F.col("__large"), "too_large").when(F.col("right").isNull(), "missing").when(F.col("left_text") == F.col("right_text"), "matched").otherwise("conflict")
    alone = right.join(found.select(key, "right"), [key, "right"], "left_anti").join(large, key, "left")
    none = F.lit(None).cast("bigint")
    return joined.select(key, "left", "right", outcome.alias("outcome")).unionByName(alone.select(key, none.alias("left"), "right", F.when(F.col("__large"), "too_large").otherwise("unmatched").alias("outcome")))


def preview_counts(previewed: DataFrame, key: str) -> DataFrame:
    """Number of rows of each outcome for each key."""
    return previewed.groupBy(key).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("matched", "conflict", "missing", "unmatched", "too_large")))
