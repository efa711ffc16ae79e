"""URL filters by a temporal list join.

Dated list entries (a host put on or taken off a list) become validity intervals. A capture is
judged as of its fetch time: for its host and every parent domain the latest entry at or before that
time is found, and the most specific active one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most list intervals that are broadcast; beyond it, they are joined by domain.
BROADCAST_ROWS = 500_000


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL, without user, port and a closing dot; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """A host and its parent domains of two labels and more, the longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (domain, action, at) -> (domain, action, valid_from, valid_to): an entry holds until the
    next one of its domain (valid_to null: still). Of entries of one domain at one time the last action
    by name counts; entries with a null domain or time are left out."""
    one = entries.where("domain is not null and at is not null").groupBy(F.lower("domain").alias("domain"), "at").agg(F.max("action").alias("action"))
    return one.select("domain", "action", F.col("at").alias("valid_from"), F.lead("at").over(Window.partitionBy("domain").orderBy("at")).alias("valid_to"))


def judged(captures: DataFrame, entries: DataFrame, allow: str = "allow", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures (page_id, url, fetched, ...) -> page_id, host, matched_domain, action, valid_from, kept.

    The interval that holds at the fetch time (from <= fetched < to) of the longest matching domain
    decides; no interval, or one whose action is `allow`, keeps the capture. Captures without a host
    or a fetch time match nothing and are kept; repeated captures repeat in the result.

    Captures are first reduced to distinct (host, fetched); only the domains of those meet the list,
    so a host with a third of all captures is joined once for each fetch time.
    """
    named = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched")
    keys = named.where("host is not null and fetched is not null").groupBy("host", "fetched").agg(F.lit(1).alias("one")).drop("one")
    valid = intervals(entries)
    small = valid.count() <= broadcast_rows
    probe = keys.select("host", "fetched", F.explode(domains_of(F.col("host"))).alias("domain"))
    held = probe.join(F.broadcast(valid) if small else valid, "domain").where("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    best = held.groupBy("host", "fetched").agg(F.max(F.struct(F.length("domain").alias("n"), F.struct("domain", "action", "valid_from").alias("hit"))).alias("best"))
    hit = best.select(F.col("host").alias("h"), F.col("fetched").alias("f"), "best.hit.*")
    joined = named.join(hit, (F.col("host") == F.col("h")) & (F.col("fetched") == F.col("f")), "left")
    return joined.select("page_id", "host", F.col("domain").alias("matched_domain"), "action", "valid_from", F.coalesce(F.col("action") == allow, F.lit(True)).alias("kept"))
