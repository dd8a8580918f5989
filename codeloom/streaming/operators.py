"""Streaming twins of the batch operators, on event time with explicit watermarks."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.operators.telemetry import event_name
from codeloom.operators.traffic import SECOND
from codeloom.streaming.state import RateLimit, SessionGate, Throttle, decided
from codeloom.streaming.tables import KeyedTable


def rate_limit(requests, key="user_id", limit=params.RATE_LIMIT,
               period=params.RATE_PERIOD_S * SECOND, delay="1 hour"):
    """(event_id, allowed) of a stream with (key, event_id, t, at).

    A request is decided in the micro-batch that brings it, in (t, event_id) order; one that comes
    after later ones were decided counts at the time of the newest of them. State is at most
    ``limit`` allowed times per key, until the watermark is ``period`` past the key's newest row.
    """
    found = decided(requests, key, RateLimit(key, limit, period), "event_id bigint, allowed boolean", delay)
    return found.select("event_id", "allowed")


def throttle(requests, key="user_id", limit=params.THROTTLE_LIMIT,
             window=params.THROTTLE_WINDOW_S * SECOND, delay="1 hour"):
    """(event_id, delay); the state holds the arrivals inside the window. Late rows as in ``rate_limit``."""
    found = decided(requests, key, Throttle(key, limit, window), "event_id bigint, delay bigint", delay)
    return found.select("event_id", "delay")


def debounce(events, key="user_id", gap=params.DEBOUNCE_MS * 1000, delay="1 hour"):
    """The last event of every session closed by the watermark."""
    session = F.session_window("at", f"{gap} microseconds")
    last = F.max(F.struct("t", "event_id")).alias("last")
    sessions = events.withWatermark("at", delay).groupBy(key, session.alias("s")).agg(last)
    return sessions.select(key, "last.t", "last.event_id")


def session_gate(events, key="user_id", idle=params.SESSION_IDLE_S * SECOND, delay="1 hour"):
    """(event_id, key, t) of requests served while their user is signed in.

    ``kind`` is "in", "out" or "request". A user without any row for ``idle`` is signed out; the state
    of idle users goes with the watermark.
    """
    found = decided(events, key, SessionGate(key, idle), "event_id bigint, t bigint", delay)
    return found.select("event_id", key, "t")


PROFILE_SCHEMA = "user_id bigint, dictionary string, key string, value string, ts timestamp_ntz, event_id bigint"


def profile_table(spark, path, buckets=16, schema=PROFILE_SCHEMA):
    """The keyed table of profile entries: one row per (user, dictionary, key), the newest update."""
    return KeyedTable(spark, path, schema, ["user_id", "dictionary", "key"], ["ts", "event_id"], buckets)


def telemetry_windows(events, length="6 hours", slide=None, delay="1 hour"):
    """Events per closed tumbling or sliding window and name; ``start`` in microseconds."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    named = events.withColumn("event_name", event_name(F.col("event_type")))
    counted = named.withWatermark("at", delay).groupBy(window.alias("w"), "event_name")
    return counted.agg(F.count("*").alias("n")).select(
        F.unix_micros("w.start").alias("start"), "event_name", "n"
    )


def suggest_on_change(models, path, key="event_id", n=params.INLINE_SUGGESTIONS):
    """A ``foreachBatch`` function: the ``n`` best continuations of every changed text.

    ``models`` gives the newest version of the model at every micro-batch. Changes have ``key`` and
    ``text``, the text before the cursor after the change; (key, rank, completion, version) goes to the
    epoch's folder below ``path``.
    """

    def run(batch, epoch):
        version, model = models.newest()
        best = model.extend(batch.select(key, "text"), [key], "text", beams=n)
        best = best.select(key, "rank", "completion", F.lit(version).alias("version"))
        best.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run


def ingest(path, line="value", schema="event_id bigint, user_id bigint, event_type string"):
    """A ``foreachBatch`` function: parsed lines go to ``path``/events, lines that do not parse to ``path``/rejects.

    A line that is no JSON object, or has a value of another type, is rejected as a whole, with its
    text. Both folders of an epoch are overwritten when it is run again.
    """

    def run(batch, epoch):
        parsed = F.from_json(line, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        rows = batch.select(line, parsed.alias("e")).persist()
        bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
        rows.where(~bad).select("e.*").drop("_bad").write.mode("overwrite").parquet(f"{path}/events/epoch={epoch}")
        rows.where(bad).select(F.col(line).alias("line")).write.mode("overwrite").parquet(f"{path}/rejects/epoch={epoch}")
        rows.unpersist()

    return run
