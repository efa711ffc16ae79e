"""Document fingerprints by threshold-scaled sketches, with built-in functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range; where these are fewer
than LEAST, the LEAST smallest, or all there are. So the sketch of a short text is whole, and what a
sketch holds tells up to which hash it is complete (upto). Sketches of parts unite to the sketch of
the whole. Two sketches are compared up to the bound that both are complete to: shares of common
hashes there estimate likeness and containment of texts of very unequal length. A short text with no
hash below a long one's bound has no estimate beside it; its likeness counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SEED_LOW = -(2**63)
#: Fewest hashes of a sketch, where the text has as many.
LEAST = 16


def limit_of(scale: int) -> int:
    """Hashes up to this signed bound are the fraction 1/scale of all."""
    return SEED_LOW + (2**64) // scale - 1


def with_sketch(docs: DataFrame, text: str, out: str, width: int = 5, scale: int = 8) -> DataFrame:
    """docs and a column out: the sorted distinct shingle hashes of the column text below the
    threshold, or the LEAST smallest where fewer are. A shingle is `width` words (ASCII white space
    splits, A-Z lower-cased), or the whole text where it has fewer.

    Words, hashes and kept hashes are columns one after another, so that each is computed once.
    """
    kept = docs.columns
    words = F.filter(F.split(ascii_lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("__w") - F.lit(width - 1), F.lit(1)))
    low = F.filter("__h", lambda h: h <= F.lit(limit_of(scale)))
    made = docs.withColumn("__w", words).withColumn("__h", F.transform(starts, lambda i: F.xxhash64(F.slice("__w", i, F.lit(width))))).withColumn("__low", F.array_distinct(low))
    chosen = F.when(F.size("__low") >= LEAST, F.array_sort("__low")).otherwise(F.slice(F.array_sort(F.array_distinct("__h")), 1, LEAST))
    return made.select(*kept, chosen.alias(out))


def merged(a: Column, b: Column, scale: int = 8) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h <= F.lit(limit_of(scale)))
    return F.when(F.size(low) >= LEAST, low).otherwise(F.slice(both, 1, LEAST))


def upto(a: Column, scale: int = 8) -> Column:
    """The largest hash that a sketch is complete to: any, where it holds all of a short text's."""
    return F.when(F.size(a) < LEAST, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(limit_of(scale)), F.element_at(a, -1)))


def _common(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    """Both sketches up to the bound that both are complete to."""
    bound = F.least(upto(a, scale), upto(b, scale))
    return F.filter(a, lambda h: h <= bound), F.filter(b, lambda h: h <= bound)


def likeness(a: Column, b: Column, scale: int = 8) -> Column:
    """Estimate of the Jaccard similarity of the shingles, 0 to 1."""
    a, b = _common(a, b, scale)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column, scale: int = 8) -> Column:
    """Estimate of the share of a's shingles that b has."""
    a, b = _common(a, b, scale)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def printed(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: Most ranges of ids; beyond rows_each times as many rows, ranges grow, and are sorted on disk where need be.
RANGES = 4096
_EACH = 64


def _range_of(bounds: list[int]) -> Column:
    """Number of the range that doc_id falls into, by two steps of up to _EACH bounds each."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + _EACH] for i in range(0, len(bounds), _EACH)]
    upto = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    group = upto(F.array(*(F.lit(g[0]).cast("long") for g in groups)))
    inner = F.array(*(F.array(*(F.lit(x).cast("long") for x in g)) for g in groups))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * _EACH + upto(F.get(inner, group - 1)))


def followed(docs: DataFrame, columns: list[str], rows_each: int = 4000) -> DataFrame:
    """docs with next_<column>: the values of the row that follows by ascending doc_id (the first
    one's after the last).

    Ids are cut at their quantiles into ranges of about rows_each rows (at most RANGES of them, so
    bounds and first ids are few); the row of each range's first id is also sent to the range before
    it, so one shuffle brings each row its neighbour and no task sees more than its range. Rows of
    one id follow each other in the order of the columns.
    """
    from pyspark.sql import Window

    n = docs.select("doc_id").count()
    k = min(RANGES, -(-n // rows_each))
    bounds: list[int] = []
    if k > 1:
        found = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10_000, 20 * k)).alias("q")).first()["q"]
        bounds = sorted(set(found))
    span = _range_of(bounds)
    first = docs.select("doc_id", span.alias("__span")).groupBy("__span").agg(F.min("doc_id").alias("__first"))
    all_ = Window.partitionBy(F.lit(0))  # over one row a range
    before = F.coalesce(F.lag("__span").over(all_.orderBy("__span")), F.max("__span").over(all_))
    marks = F.broadcast(first.select("__first", before.alias("__before")))
    spread = docs.withColumn("__span", span).join(marks, F.col("doc_id") == F.col("__first"), "left")
    here, there = F.struct(F.col("__span").alias("at"), F.lit(False).alias("extra")), F.struct(F.col("__before").alias("at"), F.lit(True).alias("extra"))
    sent = spread.withColumn("__to", F.explode(F.when(F.col("__before").isNotNull(), F.array(here, there)).otherwise(F.array(here))))
    w = Window.partitionBy("__to.at").orderBy("__to.extra", "doc_id", *[c for c in columns if c != "doc_id"])
    kept = docs.columns
    return sent.select(*kept, "__to", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("not __to.extra").drop("__to")


def fingerprints(docs: DataFrame, width: int = 5, scale: int = 8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and n_hashes.

    The edited text has its last half (rounded down) replaced by the first as many code points of the
    next document by doc_id. A null text counts as empty; a text without words has the hash of no
    words as its one shingle. Rows with a null id are left out; a repeated id follows its own
    repetition; a lone document follows itself.
    """
    own = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = followed(with_sketch(own, "text", "sketch", width, scale), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = with_sketch(near.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited")), "edited", "edited_sketch", width, scale)
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), scale).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch"), scale).alias("near_next"),
        F.size("sketch").cast("long").alias("n_hashes"),
    )
