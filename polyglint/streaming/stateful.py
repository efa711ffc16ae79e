"""Keyed state for streams: windows of attempts, and append logs fenced by epoch.

Both hold a bounded state per key: a window's start and count until a timer clears it, and a room's
snapshot with the updates since. Rows of a key are taken in their order within a micro-batch; micro-
batches are taken to follow each other in time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Keyed state of several kinds needs the RocksDB store; its files go to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class AttemptWindows(StatefulProcessor):
    """Fixed windows opened by a key's first attempt: `limit` attempts are admitted in each."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Several Arrow batches may hold one key's rows of a micro-batch: their order is fixed over all.
        given = pd.concat(list(rows)).sort_values(["t", "ord"], kind="stable")
        start, n = self.window.get() if self.window.exists() else (None, 0)
        before, admitted, starts = start, [], []
        for t in given["t"]:
            if start is None or t >= start + self.length:
                start, n = int(t), 0
            n += 1
            admitted.append(n <= self.limit)
            starts.append(start)
        self.window.update((start, n))
        if start != before:
            if before is not None:
                self.handle.deleteTimer((before + self.length) * 1000)
            self.handle.registerTimer((start + self.length) * 1000)
        yield pd.DataFrame({"key": key[0], "ord": given["ord"].to_numpy(), "admitted": admitted, "window_start": starts})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def admitted(attempts: DataFrame, key: str, order: str, seconds: str, length: int, limit: int, late: str = "0 seconds") -> DataFrame:
    """A stream of attempts -> (key, order, admitted, window_start), as jobs.admitted over a table.

    A key's state is one start and one count, cleared by a timer once the watermark has passed the window:
    any later attempt opens a new one anyway. Attempts later than the watermark are dropped; those without
    a key or a time are not judged."""
    with_state_store(attempts.sparkSession)
    given = attempts.where(F.col(key).isNotNull() & F.col(seconds).isNotNull())
    given = given.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("ord"), F.col(seconds).cast("bigint").alias("t"), F.timestamp_seconds(F.col(seconds)).alias("ts")).withWatermark("ts", late)
    found = given.groupBy("key").transformWithStateInPandas(AttemptWindows(length, limit), "key string, ord long, admitted boolean, window_start long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.col("ord").alias(order), "admitted", "window_start")


class RoomLog(StatefulProcessor):
    """A room's epoch, its next sequence number, its snapshot and the updates since."""

    def __init__(self, every: int, most_bytes: int):
        self.every, self.most = every, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "epoch long, seq long, snapshot string")
        self.tail = handle.getListState("tail", "payload string")

    def _begin(self) -> None:
        """A call takes the state once and gives it back once, whatever the number of its rows."""
        self.known = self.head.exists()
        self.now, self.seq, self.snapshot = self.head.get() if self.known else (None, 0, None)
        self.changed, self.emptied, self.old, self.new = False, False, None, []

    def _end(self) -> None:
        if self.changed:
            self.head.update((self.now, self.seq, self.snapshot))
        if self.emptied:
            self.tail.clear()
        if self.new:
            self.tail.appendList([(p,) for p in self.new])

    def _empty(self) -> None:
        self.emptied, self.old, self.new = True, [], []

    def _merged(self) -> str:
        if self.old is None:
            self.old = [r[0] for r in self.tail.get()]
        return "\n".join([*([] if self.snapshot is None else [self.snapshot]), *self.old, *self.new])

    def _one(self, kind: str, epoch: int, payload: str | None, digest: str | None) -> tuple[str, int | None, str | None]:
        if kind == "open":
            if self.known and epoch <= self.now:
                return "stale_epoch", None, None
            self._empty()
            self.known, self.changed, self.now, self.seq, self.snapshot = True, True, epoch, 0, payload
            return "opened", 0, None
        if not self.known:
            return "unavailable", None, None
        if epoch != self.now:
            return "retired", None, None
        if kind == "load":
            return "loaded", self.seq, self._merged()
        if not payload or len(payload.encode()) > self.most:
            return "too_large", None, None
        if digest != hashlib.sha256(payload.encode()).hexdigest():
            return "bad_checksum", None, None
        self.new.append(payload)
        self.changed, self.seq = True, self.seq + 1
        if self.seq % self.every == 0:
            self.snapshot = self._merged()
            self._empty()
        return "appended", self.seq, None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values("ord", kind="stable")
        text = lambda c: [None if pd.isna(x) else x for x in given[c]]
        self._begin()
        found = [self._one(k, int(e), p, d) for k, e, p, d in zip(given["kind"], given["epoch"], text("payload"), text("digest"))]
        self._end()
        outcome, seq, body = zip(*found)
        yield pd.DataFrame({"room": key[0], "ord": given["ord"].to_numpy(), "epoch": given["epoch"].to_numpy(), "outcome": outcome, "seq": pd.array(seq, dtype="Int64"), "body": body})

    def close(self) -> None:
        pass


def room_log(events: DataFrame, every: int = 64, most_bytes: int = 1 << 20) -> DataFrame:
    """A stream of (room, epoch, kind, ord, payload, digest) -> (room, ord, epoch, outcome, seq, body).

    open starts an epoch with a snapshot (stale_epoch where it isn't newer); update appends under the next
    number; load gives the snapshot and the updates since in order. Updates and loads of another epoch are
    retired, of a room without one unavailable; updates may be too_large or have a bad_checksum. After
    `every` updates they are folded into the snapshot; a new epoch drops both, which bounds the state."""
    with_state_store(events.sparkSession)
    given = events.where("room is not null and epoch is not null").select(F.col("room").cast("string").alias("room"), F.col("epoch").cast("bigint").alias("epoch"), "kind", F.col("ord").cast("bigint").alias("ord"), "payload", "digest")
    return given.groupBy("room").transformWithStateInPandas(RoomLog(every, most_bytes), "room string, ord long, epoch long, outcome string, seq long, body string", "Append", "None")


def collected(stream: DataFrame, folder: str, seconds: int | None = None) -> DataFrame:
    """Run a stream over what is there now into parquet files, from its checkpoint on; all its rows so far.
    It takes as long as it takes, unless a number of seconds is given."""
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    if seconds is None:
        run.awaitTermination()
    elif not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"not done after {seconds} s")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
