"""A durable lease queue as transformations of its table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import backoff


def enqueued(queue: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Requests whose key is not in the queue yet, once each (the first by order)."""
    one = requests.groupBy(key).agg(F.min(F.struct(*[c for c in requests.columns if c != key])).alias("__r")).select(key, "__r.*")
    return one.join(queue.select(key), key, "left_anti")


def expired(queue: DataFrame, now: int) -> DataFrame:
    """Leases that have run out become due again, or dead letters where no attempt is left. Attempts
    are counted when a job is claimed."""
    out = (F.col("state") == "leased") & (F.col("lease_expires_at") <= now)
    dead = F.col("attempts") >= F.col("max_attempts")
    return queue.withColumns({"state": F.when(out & dead, "dead_letter").when(out, "retry_wait").otherwise(F.col("state")), "lease_owner": F.when(out, None).otherwise(F.col("lease_owner")), "lease_expires_at": F.when(out, None).otherwise(F.col("lease_expires_at"))})


def head(queue: DataFrame, now: int) -> DataFrame:
    """The job that is next: due, by time, then id."""
    return queue.where(F.col("state").isin("pending", "retry_wait") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "job_id").limit(1)


def claimed(queue: DataFrame, now: int, owner: str, lease: int) -> DataFrame:
    """The queue after expiring leases and leasing its head."""
    due = expired(queue, now)
    first = head(due, now).select(F.col("job_id").alias("__j"))
    joined = due.join(F.broadcast(first), due.job_id == F.col("__j"), "left")
    mine = F.col("__j").isNotNull()
    return joined.withColumns(
        {"state": F.when(mine, "leased").otherwise(F.col("state")), "attempts": F.col("attempts") + mine.cast("int"), "lease_owner": F.when(mine, owner).otherwise(F.col("lease_owner")), "lease_expires_at": F.when(mine, F.lit(now + lease)).otherwise(F.col("lease_expires_at")), "version": F.col("version") + mine.cast("int")}
    ).drop("__j")


def fence(now: Column) -> Column:
    """Why a report about a job is refused, null if it isn't."""
    return F.when(F.col("__state").isNull(), "not_found").when(F.col("__version") != F.col("expected_version"), "version_conflict").when((F.col("__state") != "leased") | ~F.col("__owner").eqNullSafe(F.col("owner")), "not_owner").when(F.col("__until") <= now, "lease_expired")


def transitioned(queue: DataFrame, reports: DataFrame, least: int = 30, most: int = 3600) -> DataFrame:
    """reports (job_id, action, owner, expected_version, at) -> outcome, state and next attempt of each job.

    complete ends a job; retry waits with exponential back-off, or is a dead letter when no attempt is
    left; fail is a dead letter at once; cancel needs no lease.
    """
    q = queue.select("job_id", *(F.col(a).alias(f"__{b}") for a, b in (("state", "state"), ("version", "version"), ("lease_owner", "owner"), ("lease_expires_at", "until"), ("attempts", "attempts"), ("max_attempts", "most"))))
    joined = reports.join(q, "job_id", "left")
    refused = F.when(F.col("action") == "cancel", F.when(F.col("__state").isNull(), "not_found").when(F.col("__state").isin("completed", "cancelled", "dead_letter"), "already_ended").when(F.col("__version") != F.col("expected_version"), "version_conflict")).otherwise(fence(F.col("at")))
    state = F.when(F.col("action") == "complete", "completed").when(F.col("action") == "cancel", "cancelled").when(F.col("action") == "fail", "dead_letter").when(F.col("__attempts") >= F.col("__most"), "dead_letter").otherwise("retry_wait")
    made = joined.withColumn("outcome", F.coalesce(refused, F.lit("ok")))
    ok = F.col("outcome") == "ok"
    return made.select("job_id", "outcome", F.when(ok, state).otherwise(F.col("__state")).alias("state"), F.when(ok & (state == "retry_wait"), F.col("at") + backoff(F.col("__attempts"), least, most)).alias("next_attempt_at"))


def admitted(attempts: DataFrame, key: str, order: str, seconds: str, length: int, limit: int) -> DataFrame:
    """Attempts within their key's window: it opens with a first attempt, lasts a fixed time and admits
    a number of attempts; the next attempt after it opens a new one.

    Windows follow each other, so that a key's attempts are read in order: sorted by Spark, they pass in
    Arrow batches, of which only the last key, its window's start and its count are kept. Attempts without
    a key or a time are not judged."""
    given = attempts.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).select(key, F.col(seconds).cast("bigint").alias("__t"), F.col(order).cast("bigint").alias(order))
    dealt = given.repartition(key).sortWithinPartitions(key, "__t", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = None, 0, 0
        for batch in batches:
            keys, t = batch[key].to_numpy(), batch["__t"].to_numpy()
            starts, count = np.empty(len(t), dtype=np.int64), np.empty(len(t), dtype=np.int64)
            turns = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)) if len(keys) else []
            low = 0
            for high in turns:
                if keys[low] != last:
                    last, start, n = keys[low], int(t[low]), 0
                at = low
                while at < high:
                    if t[at] >= start + length:
                        start, n = int(t[at]), 0
                    end = at + int(np.searchsorted(t[at:high], start + length))
                    starts[at:end], count[at:end] = start, n + np.arange(1, end - at + 1)
                    n, at = n + end - at, end
                low = high
            yield pd.DataFrame({key: batch[key], order: batch[order], "admitted": count <= limit, "window_start": starts})

    kind = given.schema[key].dataType.simpleString()
    return dealt.mapInPandas(run, f"`{key}` {kind}, `{order}` bigint, admitted boolean, window_start bigint")


def cached(fresh: DataFrame, previous: DataFrame, key: str, values: str) -> DataFrame:
    """Fresh values where the refresh gave some, else the previous ones, marked as stale."""
    p = previous.select(key, F.col(values).alias("__p"))
    both = fresh.select(key, values).join(p, key, "full_outer")
    return both.select(key, F.coalesce(values, "__p").alias(values), (F.col(values).isNull() & F.col("__p").isNotNull()).alias("stale"))


def present(events: DataFrame, user: str, connection: str, order: str, joined: Column) -> DataFrame:
    """Users with at least one connection whose last event is a join."""
    last = events.groupBy(user, connection).agg(F.max_by(joined, order).alias("__on"))
    return last.where("__on").groupBy(user).agg(F.count("*").alias("connections"))
