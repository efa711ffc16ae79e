"""Keyset pages, sort modes and merging of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, key: str, after, limit: int = 50) -> DataFrame:
    """The next rows after a key, with more: whether there are others behind them. limit + 1 rows are
    taken by a distributed top-k, never the whole table."""
    picked = rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit + 1)
    return picked.agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c != key]))).alias("__r")).select(
        F.posexplode(F.slice("__r", 1, limit)).alias("rank", "__v"), (F.size("__r") > limit).alias("more")
    ).select("rank", "__v.*", "more")


def next_cursor(page_rows: DataFrame, key: str) -> DataFrame:
    """The last key as text where there is more, else ''."""
    return page_rows.agg(F.coalesce(F.max(F.when(F.col("more"), F.col(key))).cast("string"), F.lit("")).alias("cursor"))


def mixed_page(rows: DataFrame, first: str, second: str, after: tuple | None, limit: int = 50) -> DataFrame:
    """Keyset page ordered by first descending, second ascending."""
    if after is not None:
        rows = rows.where((F.col(first) < after[0]) | ((F.col(first) == after[0]) & (F.col(second) > after[1])))
    return rows.orderBy(F.desc(first), F.asc(second)).limit(limit)


def ranked(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """A top-k with its rank as a column, for results that are compared without order."""
    from pyspark.sql import Window

    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def id_sort_key(ids: Column) -> list[Column]:
    """Order by the first id as a number, largest first, those that aren't numbers last."""
    number = F.get(ids, F.lit(0)).try_cast("bigint")
    return [F.desc_nulls_last(number)]


def merged_pages(pages: Sequence[DataFrame], key: str) -> DataFrame:
    """Pages one after another without repeated keys; the first page with a key wins."""
    from .overlay import first_owner

    values = [c for c in pages[0].columns if c != key]
    return first_owner(pages, [key], values)


def all_pages(fetch, key: str, limit: int = 50):
    """Walk pages by fetch(after, limit) -> rows in order; the cursor has to advance. Yields rows."""
    after = None
    while True:
        rows = fetch(after, limit)
        yield from rows
        if len(rows) < limit:
            return
        if after is not None and not rows[-1][key] > after:
            raise ValueError("the cursor did not advance")
        after = rows[-1][key]
