"""Streams in several micro-batches against the batch operators."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions.text import micros
from codeloom.operators import traffic
from codeloom.operators.telemetry import telemetry, windowed_counts
from codeloom.operators.users import merge_updates, session_gate
from codeloom.plans import streams
from codeloom.plans.users import updates
from codeloom.sources.tables import read_table, stream_events, stream_json
from codeloom.streaming import operators as live
from codeloom.streaming.runner import run_append, run_batches, with_event_time

HOUR = 3600 * 1000000


@pytest.fixture(scope="module")
def batch(spark, folder):
    return read_table(spark, folder, "events").withColumn("t", micros(F.col("ts"))).cache()


@pytest.fixture(scope="module")
def parts(spark, folder, tmp_path_factory):
    """The events in four files of increasing time."""
    out = tmp_path_factory.mktemp("events")
    events = read_table(spark, folder, "events")
    n = events.count()
    for i in range(4):
        part = events.where((F.col("event_id") >= n * i // 4) & (F.col("event_id") < n * (i + 1) // 4))
        part.coalesce(1).write.mode("append").parquet(str(out))
    return str(out)


def stream(spark, parts):
    rows = stream_events(spark, parts, "*.parquet", files_per_trigger=1)
    return with_event_time(rows.withColumn("t", micros(F.col("ts"))))


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rate_limit(spark, parts, batch):
    out = run_append(live.rate_limit(stream(spark, parts), limit=1, period=24 * HOUR), "t_limit")
    want = traffic.rate_limit(batch, "user_id", "t", "event_id", 1, 24 * HOUR)
    assert pairs(out, "event_id", "allowed") == pairs(want, "event_id", "allowed")


def test_throttle(spark, parts, batch):
    out = run_append(live.throttle(stream(spark, parts), limit=2, window=24 * HOUR), "t_throttle")
    want = traffic.throttle(batch, "user_id", "t", "event_id", 2, 24 * HOUR)
    assert pairs(out, "event_id", "delay") == pairs(want, "event_id", "delay")


def test_debounce(spark, parts, batch):
    out = run_append(live.debounce(stream(spark, parts), gap=HOUR), "t_debounce")
    want = traffic.debounce(batch, ["user_id"], "t", "event_id", HOUR)
    closed = batch.agg(F.max("t")).first()[0] // 1000 * 1000 - HOUR
    assert pairs(out, "event_id") == pairs(want.where(F.col("t") + HOUR <= closed), "event_id")


def test_profile(spark, parts, batch, tmp_path):
    table = live.profile_table(spark, str(tmp_path / "profile"))
    run_batches(updates(stream_events(spark, parts, "*.parquet", files_per_trigger=1)), table.merge, "t_profile")
    out = table.read()
    columns = ("user_id", "dictionary", "key", "value")
    assert pairs(out, *columns) == pairs(merge_updates(updates(batch)), *columns)


def test_json_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"completion": "x", "rating": 0.5}\n{"completion": "y"}\n')
    feedback = stream_json(spark, str(tmp_path / "in"), "completion string, rating double")
    assert pairs(run_append(feedback, "t_json"), "completion") == [("x",), ("y",)]


def test_session_gate(spark, parts, batch):
    kind = (
        F.when(F.col("event_type") == "signup", "in")
        .when(F.col("event_type") == "error", "out")
        .when(F.col("event_type") == "click", "request")
    )
    out = run_append(
        live.session_gate(stream(spark, parts).withColumn("kind", kind).where("kind is not null")), "t_gate"
    )
    known = batch.withColumn("status", kind)
    want = session_gate(
        known.where("status = 'request'").select("user_id", "t", "event_id"),
        known.where("status in ('in', 'out')"),
    )
    assert pairs(out, "event_id") == pairs(want, "event_id")


def test_telemetry_windows(spark, parts, batch):
    out = run_append(live.telemetry_windows(stream(spark, parts), "6 hours", "3 hours"), "t_windows")
    want = windowed_counts(telemetry(batch), "6 hours", "3 hours").withColumn("start", micros(F.col("start")))
    closed = batch.agg(F.max("t")).first()[0] // 1000 * 1000 - HOUR
    want = want.where(F.col("start") + 6 * HOUR <= closed)
    assert pairs(out, "start", "event_name", "n") == pairs(want, "start", "event_name", "n")


def test_runs_can_be_cleared(spark):
    from codeloom import session

    kept = session.RUNS[:]
    session.RUNS.clear()
    stored = session.materialise(spark.range(3), "short")
    assert stored.count() == 3
    (path,) = session.RUNS
    session.clear_runs(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs) and not session.RUNS
    session.RUNS.extend(kept)


def test_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], live.PROFILE_SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.PROFILE_SCHEMA).parquet(str(tmp_path / "in"))
    table = live.profile_table(spark, str(tmp_path / "profile"))
    run_batches(stream, table.merge, "nothing")
    assert table.read().count() == 0 and table.read().columns == table.schema.names


def test_a_micro_batch_is_many_files(spark, tmp_path, monkeypatch):
    """Parts of any size come as one micro-batch each, of as many files; no task writes or reads a whole part."""
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    day = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, {})"
    for name, second in (("even", "id"), ("early", "case when id < 897 then id / 100 else id end")):
        rows = spark.range(0, 900, 1, 4).selectExpr("id as event_id", day.format(second) + " as ts", "id % 7 as user_id")
        path, files = streams.paced(spark, rows, lambda writer, path: writer.parquet(path))
        seen = []
        stream = stream_events(spark, path, "*.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint", files)
        run_batches(stream, lambda batch, epoch: seen.append([r[0] for r in batch.select("event_id").collect()]), f"t_paced_{name}")
        assert files == 6 and sorted(x for part in seen for x in part) == list(range(900))
        parts = [part for part in seen if part]
        assert len(parts) == (3 if name == "even" else 2) and all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
        largest = max(r[0] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().select("count").collect())
        assert largest < len(max(parts, key=len)) / 2
