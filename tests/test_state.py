"""Keyed state of streams: order, expiry, late rows, hot keys; tables that micro-batches write."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.operators import traffic
from codeloom.streaming import operators as live
from codeloom.streaming import state
from codeloom.streaming.runner import finish, run_append, run_batches
from codeloom.streaming.tables import KeyedTable, Versions, folders, per_epoch

SECOND = 1000000
HOUR = 3600 * SECOND


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    most = 0

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(value[0]))

    def getValue(self, key):
        return self[key]

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]


class Handle:
    """The store's interface over dicts, to count what is held."""

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()


def test_stored_queue_against_a_list():
    for chunk in (1, 2, 7):
        old, state.CHUNK = state.CHUNK, chunk
        try:
            draw, plain = random.Random(chunk), []
            queue = state.StoredQueue(Handle(), "q")
            for _ in range(60):
                queue.load()
                for _ in range(draw.randint(0, 30)):
                    if plain and draw.random() < 0.45:
                        queue.pop()
                        plain.pop(0)
                    else:
                        plain.append(draw.randrange(100))
                        queue.append(plain[-1])
                    assert len(queue) == len(plain) and (not plain or queue.oldest() == plain[0])
                queue.save()
                assert len(queue.chunks) <= len(plain) // chunk + 2
        finally:
            state.CHUNK = old


def test_rows_of_a_hot_key_come_in_order_slot_by_slot():
    processor = state.InOrder()
    processor.open = lambda handle: None
    processor.init(Handle())
    n = 200_000
    t = np.random.default_rng(1).permutation(n) * 1000
    frames = (pd.DataFrame({"t": t[i : i + 5000], "event_id": t[i : i + 5000] + 1}) for i in range(0, n, 5000))
    seen, largest = [], 0
    for frame in processor.slots(frames):
        largest = max(largest, len(frame))
        seen.append(frame["t"].to_numpy())
    assert (np.concatenate(seen) == np.arange(n) * 1000).all()
    assert largest < n / 100 and not processor.parked


def rows_stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream.withColumn("at", F.timestamp_micros("t"))


def test_hot_key_as_in_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [("hot" if draw.random() < 0.9 else f"u{draw.randrange(9)}", i, draw.randrange(40 * HOUR)) for i in range(30_000)]
    schema = "user_id string, event_id long, t long"
    stream = rows_stream(spark, tmp_path, [rows], schema)
    batch = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        waits = run_append(live.throttle(stream, limit=40, window=HOUR), "t_hot")
        allowed = run_append(live.rate_limit(stream, limit=20, period=HOUR), "t_hot")
        got = sorted(map(tuple, waits.collect())), sorted(map(tuple, allowed.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = traffic.throttle(batch, "user_id", "t", "event_id", 40, HOUR).select("event_id", "delay")
    assert got[0] == sorted(map(tuple, want.collect()))
    want = traffic.rate_limit(batch, "user_id", "t", "event_id", 20, HOUR).select("event_id", "allowed")
    assert got[1] == sorted(map(tuple, want.collect()))


def test_late_rows_count_at_the_newest_time(spark, tmp_path):
    batches = [[("a", 1, 10 * HOUR), ("a", 2, 10 * HOUR + 5)], [("a", 3, 9 * HOUR), (None, 4, 9 * HOUR)], [("a", 5, 10 * HOUR + 9)]]
    stream = rows_stream(spark, tmp_path, batches, "user_id string, event_id long, t long")
    found = dict(map(tuple, run_append(live.rate_limit(stream, limit=3, period=HOUR, delay="10 hours"), "t_late").collect()))
    assert found == {1: True, 2: True, 3: True, 4: True, 5: False}  # the late third one uses up the limit


def test_idle_sessions_end_and_leave_the_state(spark, tmp_path):
    batches = [
        [("ann", 1, HOUR, "in"), ("ann", 2, HOUR + 1, "request"), ("bob", 3, HOUR, "in"), (None, 4, HOUR, "in"), (None, 5, HOUR + 1, "request")],
        [("bob", 6, 4 * HOUR, "request"), ("cid", 7, 20 * HOUR, "request")],
        [("ann", 8, 21 * HOUR, "request"), ("bob", 9, 22 * HOUR, "in"), ("bob", 10, 22 * HOUR + 1, "request")],
    ]
    stream = rows_stream(spark, tmp_path, batches, "user_id string, event_id long, t long, kind string")
    gate = live.session_gate(stream, idle=5 * HOUR)
    writer = gate.writeStream.format("parquet").option("path", str(tmp_path / "rows"))
    finish(writer.outputMode("append"), str(tmp_path), 300)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).select("event_id", "user_id").collect())
    assert got == [(2, "ann"), (5, None), (6, "bob"), (10, "bob")]
    held = spark.read.format("statestore").option("stateVarName", "status").load(str(tmp_path / "checkpoint"))
    assert {r[0] for r in held.select("key.user_id").collect()} == {"ann", "bob", "cid"}  # the missing user is gone
    early = spark.read.format("statestore").option("stateVarName", "status").option("batchId", 0).load(str(tmp_path / "checkpoint"))
    assert {r[0] for r in early.select("key.user_id").collect()} == {"ann", "bob", None}


SCHEMA = "k string, v long, at long"


def test_keyed_table_merges_and_replays(spark, tmp_path):
    draw, plain = random.Random(2), {}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["at"], buckets=4)
    assert table.read().count() == 0
    for epoch in range(5):
        rows = [(draw.choice([f"k{i}" for i in range(30)] + [None]), draw.randrange(99), epoch * 1000 + i) for i in range(40)]
        for k, v, at in rows:
            plain[k] = (v, at)
        batch = spark.createDataFrame(rows, SCHEMA).repartition(3)
        for _ in range(1 + epoch % 2):  # every other batch runs twice
            table.merge(batch, epoch)
            assert {r.k: (r.v, r.at) for r in table.read().collect()} == plain
        assert table.read().count() == len(plain)
    table.merge(spark.createDataFrame([("k1", 7, 9999)], SCHEMA), 5)  # one bucket only
    assert {r.k: (r.v, r.at) for r in table.read().collect()} == plain | {"k1": (7, 9999)}
    table.merge(spark.createDataFrame([], SCHEMA), 6)
    assert len(folders(spark, str(tmp_path / "t"))) <= 4


def test_unfinished_epochs_do_not_count(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["at"], buckets=2)
    table.merge(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)
    table.merge(spark.createDataFrame([("a", 2, 2)], SCHEMA), 1)
    (tmp_path / "t" / "epoch=1" / "_SUCCESS").unlink()  # as if the job had died
    assert [r.v for r in table.read().collect()] == [1]
    table.merge(spark.createDataFrame([("a", 2, 2)], SCHEMA), 1)
    assert [r.v for r in table.read().collect()] == [2]


def test_a_newer_model_is_used_by_the_next_micro_batch(spark, tmp_path):
    from codeloom.operators.ngrams import Bigrams

    models = Versions(spark, str(tmp_path / "m"), Bigrams.load)
    model = lambda text: Bigrams.train(spark.createDataFrame([(text,)], "text string"), store=False)
    models.publish(model("red green red green blue red"))
    save = live.suggest_on_change(models, str(tmp_path / "out"), n=1)
    batch = spark.createDataFrame([(1, "some red"), (2, ""), (3, None), (4, "green")], "event_id long, text string")
    save(batch, 0)
    models.publish(model("red yellow"))
    save(batch, 1)
    save(batch, 1)
    found = per_epoch(spark, str(tmp_path / "out"), "event_id long, rank int, completion string, version int").collect()
    assert sorted((r.version, r.event_id, r.completion) for r in found) == [(1, 1, "green"), (1, 4, "blue"), (2, 1, "yellow")]


@pytest.mark.parametrize("lines", [[], ['{"event_id": 1, "user_id": 2, "event_type": "x"}', "", "[1]", '{"event_id": "x"}', "{", '{"user_id": null}']])
def test_lines_are_events_or_rejects(spark, tmp_path, lines):
    (tmp_path / "in").mkdir()
    if lines:
        (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    save = live.ingest(str(tmp_path / "out"))
    run_batches(spark.readStream.text(str(tmp_path / "in")), save, "t_ingest")
    events = per_epoch(spark, str(tmp_path / "out" / "events"), "event_id long, user_id long, event_type string").collect()
    rejects = per_epoch(spark, str(tmp_path / "out" / "rejects"), "line string").collect()
    assert [tuple(r) for r in events] == ([(1, 2, "x"), (None, None, None)] if lines else [])
    assert sorted(r.line for r in rejects) == (sorted(["", "[1]", '{"event_id": "x"}', "{"]) if lines else [])


class Calls(Handle):
    """Counts the calls that a processor makes to the store."""

    def __init__(self):
        self.calls, self.timers = [], set()

    def counted(self, state):
        for name in ("exists", "get", "update", "updateValue", "getValue", "containsKey", "removeKey", "put"):
            if hasattr(state, name):
                setattr(state, name, lambda *a, f=getattr(state, name), n=name: self.calls.append(n) or f(*a))
        return state

    def getMapState(self, *_):
        return self.counted(Map())

    def getValueState(self, *_):
        return self.counted(Value())

    getListState = getValueState

    def listTimers(self):
        self.calls.append("listTimers")
        return sorted(self.timers)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.remove(at)


class Times:
    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("made", [state.RateLimit("u", 3, HOUR), state.Throttle("u", 3, HOUR), state.SessionGate("u", HOUR)], ids=["rate", "throttle", "session"])
def test_a_key_with_few_rows_takes_few_calls_of_the_store(made):
    handle = Calls()
    made.init(handle)
    for batch in range(3):
        rows = {"t": [batch * HOUR + 5, batch * HOUR + 2], "event_id": [batch * 2 + 1, batch * 2], "kind": ["request", "in"]}
        handle.calls.clear()
        (found,) = made.handleInputRows((7,), iter([pd.DataFrame(rows)]), Times())
        assert found["event_id"].tolist()[-1] == batch * 2 + 1 and set(found["u"]) == {7}
        assert len(handle.calls) <= 6 and len(handle.timers) == 1
