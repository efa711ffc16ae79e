"""Benchmark decontamination with built-in functions only.

The distinct windows of n words of all benchmark items form a set of hashes. Training texts are
scanned window by window against it; windows whose hash is in the set carry their words along and
are verified against the items' words. Hit spans, or whole documents, can then be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_digest, saved

#: Most distinct windows that are sent to every task as a set; beyond it, as a bit field.
SET_ROWS = 50_000
#: Most bits of that field, as a power of two: 3 MB.
FIELD_BITS = 24
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words and what lies between them, before lower-casing.
PIECES = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of digits, letters a-z and all non-ASCII characters."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """benchmark (item_id, text) -> (length, window, hash, items): distinct windows with the sorted ids of the items that have them."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0 and item_id is not null")
    length = F.least(F.size("w"), F.lit(size))
    each = words.select("item_id", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("x"))
    found = each.groupBy("length", F.array_join("x", " ").alias("window")).agg(F.first(F.xxhash64("x")).alias("hash"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return saved(found)


def _scanned(docs: DataFrame, found: DataFrame, set_rows: int) -> DataFrame:
    """doc_id, row (a digest of the row's id and text), n_words and met: places whose hash is that of some window."""
    lengths = sorted(r["length"] for r in found.select("length").distinct().toLocalIterator())
    base = docs.select("doc_id", row_digest().alias("row"), words_of(F.col("text")).alias("w"))
    empty = "cast(array() as array<struct<pos:int,length:int,window:string>>)"
    if not lengths or found.count() <= set_rows:
        parts = [empty]
        for n in lengths:
            known = ",".join(f"{r['hash']}L" if r["hash"] != -(2**63) else "(-9223372036854775807L - 1L)" for r in found.where(F.col("length") == n).select("hash").distinct().toLocalIterator())
            at = f"filter(sequence(1, size(w) - {n - 1}), i -> xxhash64(slice(w, i, {n})) in ({known}))"
            parts.append(f"if(size(w) >= {n}, transform({at}, i -> named_struct('pos', i - 1, 'length', {n}, 'window', array_join(slice(w, i, {n}), ' '))), {empty})")
        return base.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.expr(f"concat({', '.join(parts)})").alias("met"))
    # Too many windows for a list: a bit field says where one may be. Only such places move, and are verified.
    known = _bit_field(found)
    window = lambda i, n: F.slice("w", i, F.lit(n))

    def places(n: int) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: known(F.xxhash64(window(i, n))))
        place = F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.lit(n).alias("length"), F.array_join(window(i, n), " ").alias("window")))
        return F.when(F.size("w") >= n, place).otherwise(F.expr(empty))

    met = [places(n) for n in lengths]
    return base.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.concat(*met).alias("met"))


def _bit_field(found: DataFrame):
    """A test of hashes against two bits each in a field of 16 bits a window (2**FIELD_BITS at most);
    a fuller field lets more places through, which are verified all the same. Its bytes hold six
    bits each, above "0", so that they are read as characters."""
    size = 1 << min(max(int(16 * found.count()).bit_length(), 10), FIELD_BITS)

    def bits(of: Column) -> list[Column]:
        return [F.pmod(of, F.lit(size)), F.pmod(F.shiftrightunsigned(of, 32), F.lit(size))]

    each = found.select(F.explode(F.array(*bits(F.col("hash")))).alias("bit"))
    sixes = each.groupBy(F.floor(F.col("bit") / 6).alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 6 as int)))").alias("v"))
    field = bytearray(b"0" * (size // 6 + 1))
    for r in sixes.toLocalIterator():  # at most one row a byte
        field[r["at"]] = 48 + r["v"]
    there = F.lit(bytes(field))

    def test(of: Column) -> Column:
        read = [F.getbit(F.ascii(F.substring(there, F.floor(x / 6).cast("int") + 1, F.lit(1)).cast("string")) - 48, F.pmod(x, F.lit(6)).cast("int")) == 1 for x in bits(of)]
        return read[0] & read[1]

    return test


def _confirmed(scanned: DataFrame, found: DataFrame, set_rows: int) -> DataFrame:
    """row, covered (sorted positions of words inside windows) and items, for rows with a hit."""
    each = scanned.where("size(met) > 0").select("row", F.explode("met").alias("m")).select("row", "m.pos", "m.length", "m.window").distinct()
    small = found.count() <= set_rows
    known = found.select("length", "window", "items")
    hit = each.join(F.broadcast(known) if small else known, ["length", "window"])
    return hit.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(pos, pos + length - 1)"))))).alias("covered"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, set_rows: int = SET_ROWS) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, covered (positions of words,
    from 0, inside an occurrence of a window) and items (ids of items with a window in the text).

    An item of fewer than size words is one window, one without words none. Null texts have no words.
    One row for each row of docs, repeated ones too; without benchmark windows nothing is covered.
    Very long texts are one row's arrays of words and windows.
    """
    found = windows(benchmark, size)
    scanned = saved(_scanned(docs, found, set_rows))
    hit = _confirmed(scanned, found, set_rows)
    return scanned.select("doc_id", "row", "n_words").join(hit, "row", "left").select(
        "doc_id", "n_words", F.coalesce("covered", F.expr("cast(array() as array<int>)")).alias("covered"), F.coalesce("items", F.array().cast(hit.schema["items"].dataType)).alias("items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents", set_rows: int = SET_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) with the same columns, without the documents that have a hit
    (remove="documents"), or without the hit words and what lies between them (remove="spans").
    Documents without a hit come back as they are, null texts too."""
    found = windows(benchmark, size)
    # Saved before it is filtered: a filter pushed below would split the text anew for every window.
    hit = saved(_confirmed(saved(_scanned(docs, found, set_rows)), found, set_rows))
    marked = docs.withColumn("__row", row_digest())
    if remove == "documents":
        return marked.join(hit.select(F.col("row").alias("__row")), "__row", "left_anti").drop("__row")
    joined = marked.join(hit.select(F.col("row").alias("__row"), F.col("covered").alias("__covered")), "__row", "left")
    pieces = F.regexp_extract_all("text", F.lit(PIECES), F.lit(1))
    word = "if(text rlike '^[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]', 0, 1)"
    kept = F.expr(
        f"filter(__pieces, (x, i) -> if((i + {word}) % 2 = 0, not array_contains(__covered, int((i + {word}) / 2) - {word}),"
        f" not (array_contains(__covered, int((i + {word} - 1) / 2) - {word}) and array_contains(__covered, int((i + {word} + 1) / 2) - {word}))))"
    )
    cut = joined.withColumn("__pieces", pieces).withColumn("text", F.when(F.col("__covered").isNotNull(), F.array_join(kept, "")).otherwise(F.col("text")))
    return cut.select(*docs.columns)
