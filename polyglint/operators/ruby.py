"""Readings over performer segments, as the intersection of two lists of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import graphemes

#: Why a reading can't be dealt to segments.
REFUSALS = ("ended_early", "crosses_segment", "continues_after")


def _upto(sizes: Column) -> Column:
    """Sums up to and with each item."""
    return F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))


def partitioned(lines: DataFrame, segments: str, spans: str) -> DataFrame:
    """Adds parts and refusal to lines: segments (array of texts), spans (array of struct text, reading).

    Both lists are laid along the same graphemes. parts has for each segment the pieces of spans that it
    covers, each with its span's reading. A span with a reading must lie in one segment; spans without one
    are split. refusal is null, or else parts is: ended_early (segments left over), crosses_segment, or
    continues_after (spans left over). A span without text belongs to the segment it begins in; a segment
    without text gets none. A null list counts as empty, a null text as an empty one; only counts are
    compared, as spans and segments may spell a text differently."""
    cut = lines.withColumns({
        "__s": F.transform(F.coalesce(F.col(segments), F.array().cast("array<string>")), lambda t: F.size(graphemes(F.coalesce(t, F.lit(""))))),
        "__g": F.transform(F.coalesce(F.col(spans), F.array().cast("array<struct<text:string,reading:string>>")), lambda s: graphemes(F.coalesce(s["text"], F.lit("")))),
    })
    cut = cut.withColumns({"__se": _upto(F.col("__s")), "__pe": _upto(F.transform("__g", F.size))})
    zero = lambda ends: F.coalesce(F.element_at(ends, F.when(F.size(ends) > 0, -1).otherwise(None)), F.lit(0))
    reading = lambda i: F.coalesce(F.col(spans)[i]["reading"], F.lit(""))
    spans_ = F.transform("__g", lambda g, i: F.struct((F.get("__pe", i) - F.size(g)).alias("low"), F.get("__pe", i).alias("high"), g.alias("g"), reading(i).alias("reading")))
    segs = F.transform("__s", lambda n, i: F.struct((F.get("__se", i) - n).alias("low"), F.get("__se", i).alias("high")))
    cut = cut.withColumns({"__p": spans_, "__q": segs})
    total_s, total_p = zero(F.col("__se")), zero(F.col("__pe"))
    crosses = F.exists("__p", lambda p: (p["reading"] != "") & (p["high"] > p["low"]) & F.exists("__q", lambda q: (q["low"] < p["high"]) & (q["high"] > p["low"]) & ((p["low"] < q["low"]) | (p["high"] > q["high"]))))
    inside = lambda p, q: ((p["low"] < q["high"]) & (p["high"] > q["low"])) | ((p["low"] == p["high"]) & (p["low"] >= q["low"]) & (p["low"] < q["high"]))

    def pieces(q: Column) -> Column:
        own = lambda p: F.slice(p["g"], F.greatest(q["low"] - p["low"], F.lit(0)) + 1, F.least(p["high"], q["high"]) - F.greatest(p["low"], q["low"]))
        return F.transform(F.filter("__p", lambda p: inside(p, q)), lambda p: F.struct(F.array_join(own(p), "").alias("text"), p["reading"].alias("reading")))

    # Reading from the left: a crossing span is met before the end of either list.
    refusal = F.when(crosses, "crosses_segment").when(total_p < total_s, "ended_early").when((total_p > total_s) | F.exists("__p", lambda p: p["low"] >= total_s), "continues_after")
    return cut.withColumn("refusal", refusal).withColumn("parts", F.when(F.col("refusal").isNull(), F.transform("__q", pieces))).drop("__s", "__g", "__se", "__pe", "__p", "__q")
