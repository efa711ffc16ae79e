"""Keyed state in streams: several micro-batches and a restart give what one table gives."""

import hashlib
import random

from polyglint.operators import jobs, logs
from polyglint.streaming import stateful


def windows(attempts, length, limit):
    out, state = {}, {}
    for key, order, t in sorted(attempts, key=lambda a: (a[2], a[1])):
        start, n = state.get(key, (None, 0))
        if start is None or t >= start + length:
            start, n = t, 0
        state[key] = (start, n + 1)
        out[key, order] = (n + 1 <= limit, start)
    return out


def feed(spark, rows, schema, folder, i):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def attempts(seed=3, n=400):
    r, t, out = random.Random(seed), 1000, []
    for i in range(n):
        t += r.choice([0, 1, 2, 15])
        out.append((r.choice("aaab"), i, t))
    return out


def test_attempts_over_batches_and_a_restart(spark, tmp_path):
    schema, rows = "k string, i long, s long", attempts()
    judge = lambda: stateful.admitted(stream(spark, schema, tmp_path), "k", "i", "s", 20, 3)
    for i in range(4):
        feed(spark, rows[50 * i : 50 * i + 50], schema, tmp_path, i)
    stateful.collected(judge(), str(tmp_path / "out"))
    for i in range(4, 8):
        feed(spark, rows[50 * i : 50 * i + 50], schema, tmp_path, i)
    found = {(r.k, r.i): (r.admitted, r.window_start) for r in stateful.collected(judge(), str(tmp_path / "out")).collect()}
    assert found == windows(rows, 20, 3)
    table = jobs.admitted(spark.createDataFrame(rows, schema), "k", "i", "s", 20, 3).collect()
    assert {(r.k, r.i): (r.admitted, r.window_start) for r in table} == found and len(table) == len(rows)


def test_attempts_of_a_table(spark):
    rows = attempts(8, 3000) + [("z", 9000 + i, 5) for i in range(5000)] + [(None, 1, 1), ("a", 2, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        found = {(r.k, r.i): (r.admitted, r.window_start) for r in jobs.admitted(spark.createDataFrame(rows, "k string, i long, s long"), "k", "i", "s", 17, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == windows([r for r in rows if None not in r], 17, 4)
    assert jobs.admitted(spark.createDataFrame([], "k string, i long, s long"), "k", "i", "s", 17, 4).collect() == []


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def room_events():
    r, out, epoch = random.Random(4), [], {"x": 0, "y": 0, "z": 0}
    for i in range(300):
        room = r.choice("xxyz")
        kind = r.choices(["open", "update", "load"], [1, 8, 2])[0]
        if room == "z" and kind == "open":
            kind = "update"
        at = epoch[room]
        if kind == "open":
            epoch[room] = at = at + r.choice([0, 1])
            out.append((room, at, "open", i, f"base{i}", None))
        else:
            payload = f"u{i}" if r.random() > 0.05 else r.choice(["", None, "w" * 50])
            digest = sha(payload or "") if r.random() > 0.05 else "bad"
            out.append((room, at - r.choice([0, 0, 0, 0, 1]), kind, i, payload, digest))
    return out


def replay(events, most):
    state, out = {}, {}
    for room, epoch, kind, i, payload, digest in events:
        now, items = state.get(room, (None, None))
        if kind == "open":
            if now is None or epoch > now:
                state[room] = (epoch, [payload])
                out[i] = ("opened", 0, None)
            else:
                out[i] = ("stale_epoch", None, None)
        elif now is None:
            out[i] = ("unavailable", None, None)
        elif epoch != now:
            out[i] = ("retired", None, None)
        elif kind == "load":
            out[i] = ("loaded", len(items) - 1, "\n".join(items))
        elif not payload or len(payload) > most:
            out[i] = ("too_large", None, None)
        elif digest != sha(payload):
            out[i] = ("bad_checksum", None, None)
        else:
            items.append(payload)
            out[i] = ("appended", len(items) - 1, None)
    return out


def test_log_over_batches_and_a_restart(spark, tmp_path):
    schema, events = "room string, epoch long, kind string, ord long, payload string, digest string", room_events()
    log = lambda: stateful.room_log(stream(spark, schema, tmp_path), every=3, most_bytes=40)
    for i in range(3):
        feed(spark, events[50 * i : 50 * i + 50], schema, tmp_path, i)
    stateful.collected(log(), str(tmp_path / "out"))
    for i in range(3, 6):
        feed(spark, events[50 * i : 50 * i + 50], schema, tmp_path, i)
    rows = stateful.collected(log(), str(tmp_path / "out")).collect()
    wanted = replay(events, 40)
    assert {r.ord: (r.outcome, r.seq, r.body) for r in rows} == wanted and len(rows) == len(events)
    assert {o for o, _, _ in wanted.values()} == {"opened", "stale_epoch", "unavailable", "retired", "loaded", "too_large", "bad_checksum", "appended"}
    # The batch forms give the same numbers and text for the last epoch of a room.
    last = max(e for r, e, k, *_ in events if r == "x" and wanted[[x for x in events if x[0] == r and x[1] == e][0][3]])
    good = [x for x in events if x[0] == "x" and x[1] == last and wanted[x[3]][0] == "appended"]
    base = next(x for x in events if x[0] == "x" and x[1] == last and wanted[x[3]][0] == "opened")
    heads = spark.createDataFrame([("x", 0)], "room string, seq long")
    numbered = logs.appended(spark.createDataFrame([(x[0], x[3], x[4]) for x in good], "room string, ord long, payload string"), heads, "room", "ord")
    assert {r.ord: r.seq for r in numbered.collect()} == {x[3]: wanted[x[3]][1] for x in good}
    whole = logs.replayed(spark.createDataFrame([("x", 0, base[4])], "room string, seq long, body string"), numbered, "room", "seq", "payload").first()
    assert whole.body == "\n".join([base[4], *(x[4] for x in good)])


def test_a_call_gives_its_state_back_once():
    import pandas as pd

    class Held:
        def __init__(self):
            self.value, self.writes = None, 0

        exists = lambda self: self.value is not None
        get = lambda self: self.value if isinstance(self.value, tuple) else iter(self.value or [])
        clear = lambda self: self.update(None)
        appendValue = lambda self, v: self.update([*(self.value or []), v])
        appendList = lambda self, v: self.update([*(self.value or []), *v])

        def update(self, v):
            self.value, self.writes = v, self.writes + 1

    log = stateful.RoomLog(5, 1 << 20)
    log.head, log.tail = Held(), Held()
    texts = [f"u{i}" for i in range(23)]
    kinds = ["open", *["update"] * 21, "load"]
    given = pd.DataFrame({"ord": range(23), "epoch": 1, "kind": kinds, "payload": texts, "digest": [hashlib.sha256(t.encode()).hexdigest() for t in texts]})
    got = [pd.concat(log.handleInputRows(("r",), iter([part]), None)) for part in (given[:13], given[13:])]
    assert log.head.writes <= 2 and log.tail.writes <= 4
    assert got[1]["body"].iloc[-1] == "\n".join(texts[:22]) and got[1]["seq"].iloc[-1] == 21
