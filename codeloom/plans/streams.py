"""Streaming twins over the event table, run to the end of the available data."""

from pyspark.sql import functions as F

from codeloom.functions.text import micros
from codeloom.operators.ngrams import Bigrams
from codeloom.plans.registry import query
from codeloom.plans.scoring import BIGRAM_SQL, CONTINUATIONS_SQL
from codeloom.plans.sql import words_sql
from codeloom.plans.traffic import DAY, HOUR, limit_sql, throttle_sql
from codeloom.plans.users import PROFILE_SQL, updates
from codeloom.session import materialise, run_dir
from codeloom.sources.tables import documents, notification, read_table, stream_events
from codeloom.streaming import operators as live
from codeloom.streaming.runner import run_append, run_batches, with_event_time
from codeloom.streaming.tables import Versions, per_epoch

# The watermark after the last event, in microseconds: whole milliseconds minus one hour.
CLOSED = "(SELECT epoch_ms(max(ts)) * 1000 - 3600000000 FROM events)"


BATCHES = 3
FILE_ROWS = 100000  # rows that one task writes, and reads in a micro-batch


def part_files(spark, path):
    """Number of data files in a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sum(s.getPath().getName().startswith("part-") for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root))


def paced(spark, rows, write, *columns):
    """(folder, files): rows written in BATCHES parts of increasing time, ``files`` files each, for one micro-batch each.

    A part with rows for fewer files is filled up with empty ones.
    """
    path = run_dir(spark, "arrivals")
    first, last, n = rows.agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    files = max(1, -(-n // (BATCHES * FILE_ROWS)))
    for i in range(BATCHES):
        lo, hi = (first + (last - first) * k / BATCHES for k in (i, i + 1)) if first else (None, None)
        part = rows.where((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) | F.lit(i == BATCHES - 1)))
        part = part.select(*columns or part.columns)
        write((part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append"), path)
        for _ in range(files * (i + 1) - part_files(spark, path)):
            write(part.limit(0).coalesce(1).write.mode("append"), path)
    return path, files


def event_stream(spark, folder):
    """The event table as it arrives: three micro-batches."""
    path, files = paced(spark, read_table(spark, folder, "events"), lambda writer, path: writer.parquet(path))
    return stream_events(spark, path, "*.parquet", files_per_trigger=files)


def events(spark, folder):
    rows = event_stream(spark, folder)
    return with_event_time(rows.withColumn("t", micros(F.col("ts"))))


@query("stream_rate_limit", limit_sql(3, DAY))
def rate_limit(spark, folder):
    return run_append(live.rate_limit(events(spark, folder), limit=3, period=DAY), "rate_limit")


@query(
    "stream_throttle",
    f"SELECT event_id, delay FROM ({throttle_sql(3, DAY, 'user_id')})",
)
def throttle(spark, folder):
    return run_append(live.throttle(events(spark, folder), limit=3, window=DAY), "throttle")


@query(
    "stream_debounce",
    f"""
    WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS t,
                 lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
    SELECT user_id, event_id, t FROM r WHERE (next IS NULL OR next >= t + {HOUR}) AND t + {HOUR} <= {CLOSED}
    """,
)
def debounce(spark, folder):
    """As the batch form, for the sessions the watermark has closed."""
    return run_append(live.debounce(events(spark, folder), gap=HOUR), "debounce")


IDLE = 2 * DAY


@query(
    "stream_session_gate",
    f"""
    WITH e AS (SELECT event_id, 'user-' || user_id AS user_id, epoch_us(ts) AS t,
                 CASE event_type WHEN 'signup' THEN 'in' WHEN 'error' THEN 'out' ELSE 'request' END AS kind
               FROM events WHERE event_type IN ('signup', 'error', 'click')),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) >= {IDLE} THEN 1 ELSE 0 END AS gap FROM e),
    s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY t, event_id) AS part FROM g),
    l AS (SELECT *, last_value(CASE WHEN kind <> 'request' THEN kind END IGNORE NULLS)
            OVER (PARTITION BY user_id, part ORDER BY t, event_id) AS status FROM s)
    SELECT event_id, user_id, t FROM l WHERE kind = 'request' AND status = 'in'
    """,
)
def session_gate(spark, folder):
    """A user without any event for two days is signed out."""
    kind = (
        F.when(F.col("event_type") == "signup", "in")
        .when(F.col("event_type") == "error", "out")
        .when(F.col("event_type") == "click", "request")
    )
    known = events(spark, folder).withColumn("kind", kind).where("kind is not null")
    named = known.withColumn("user_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return run_append(live.session_gate(named, idle=IDLE), "session_gate")


@query("stream_profile", f"WITH {PROFILE_SQL} SELECT user_id, dictionary, key, value FROM m")
def profile(spark, folder):
    """Micro-batches merged into a keyed table: one row per user, dictionary and key."""
    table = live.profile_table(spark, run_dir(spark, "profile"))
    run_batches(updates(event_stream(spark, folder)), table.merge, "profile-run")
    return table.read().select("user_id", "dictionary", "key", "value")


LINE_SQL = """'{"event_id": ' || event_id || ', "user_id": ' || CASE WHEN event_id % 11 = 0 THEN '"x"' ELSE user_id::varchar END
    || ', "event_type": "' || event_type || CASE WHEN event_id % 7 = 0 THEN '"' ELSE '"}' END"""


@query(
    "stream_ingest",
    f"""
    SELECT event_id, user_id, event_type, NULL::varchar AS line FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0
    UNION ALL SELECT NULL, NULL, NULL, {LINE_SQL} FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0
    """,
)
def ingest(spark, folder):
    """Event lines, some cut short or with a name for a number: events and rejects of three micro-batches."""
    rows = read_table(spark, folder, "events")
    user = F.when(F.col("event_id") % 11 == 0, '"x"').otherwise(F.col("user_id").cast("string"))
    end = F.when(F.col("event_id") % 7 == 0, '"').otherwise('"}')
    line = F.concat(
        F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user_id": '), user, F.lit(', "event_type": "'), "event_type", end
    )
    arrivals, files = paced(spark, rows.withColumn("value", line), lambda writer, path: writer.text(path), "value")
    path = run_dir(spark, "ingested")
    run_batches(spark.readStream.option("maxFilesPerTrigger", files).text(arrivals), live.ingest(path), "ingest-run")
    found = per_epoch(spark, f"{path}/events", "event_id bigint, user_id bigint, event_type string")
    return found.unionByName(per_epoch(spark, f"{path}/rejects", "line string"), allowMissingColumns=True)


WINDOW_SQL = """
    WITH w AS (SELECT epoch_us(time_bucket(INTERVAL {step} HOURS, ts)) AS b,
                 CASE WHEN event_type = 'error' THEN 'error' ELSE 'completion' END AS event_name FROM events),
    s AS (SELECT event_name, unnest([{starts}]) AS start FROM w)
    SELECT start, event_name, count(*) AS n FROM s WHERE start + 6 * 3600000000 <= {closed} GROUP BY ALL
"""


@query("stream_telemetry_tumbling", WINDOW_SQL.format(step=6, starts="b", closed=CLOSED))
def telemetry_tumbling(spark, folder):
    return run_append(live.telemetry_windows(events(spark, folder)), "tumbling")


@query(
    "stream_telemetry_sliding",
    WINDOW_SQL.format(step=3, starts="b, b - 3 * 3600000000", closed=CLOSED),
)
def telemetry_sliding(spark, folder):
    return run_append(live.telemetry_windows(events(spark, folder), "6 hours", "3 hours"), "sliding")


CHANGE_SCHEMA = (
    "uri string, contentChanges array<struct<range:struct<"
    "start:struct<line:int,character:int>,end:struct<line:int,character:int>>,text:string>>"
)


def changes(events):
    """Change notifications of click events: the document is number ``k`` of the event."""
    k = F.from_json("props", "k string")["k"]
    text = F.concat(
        F.lit('{"uri": "doc/'), k,
        F.lit('", "contentChanges": [{"range": {"start": {"line": 0, "character": 0}, '
              '"end": {"line": 0, "character": 1}}, "text": "a"}, '
              '{"range": {"start": {"line": 0, "character": 0}, "end": {"line": '), k,
        F.lit(', "character": '), F.col("user_id"), F.lit('}}, "text": "b"}]}'),
    )
    return events.where("event_type = 'click'").select("event_id", text.alias("message"))


def last_change(messages):
    """(event_id, uri, line, character): the end of the last content change."""
    parsed = messages.select("event_id", F.from_json("message", CHANGE_SCHEMA).alias("m"))
    end = F.element_at("m.contentChanges", -1)["range"]["end"]
    return parsed.select("event_id", "m.uri", end["line"].alias("line"), end["character"].alias("character"))


@query(
    "change_position",
    """
    SELECT event_id, 'doc/' || (props->>'k') AS uri, (props->>'k')::int AS line, user_id::int AS character
    FROM events WHERE event_type = 'click'
    """,
)
def change_position(spark, folder):
    return last_change(changes(read_table(spark, folder, "events")))


def edits(events, docs):
    """Change notifications with the new text of the document: the beginning of document ``k``, as far as typed."""
    k = F.from_json("props", "k long")["k"]
    clicks = events.where("event_type = 'click'").select("event_id", "ts", k.alias("doc_id")).join(docs, "doc_id")
    typed = F.substring("text", F.lit(1), (F.col("event_id") % 400 + 1).cast("int"))
    change = F.struct(F.array(F.struct(typed.alias("text"))).alias("contentChanges"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("uri"))
    return clicks.select("event_id", "ts", F.to_json(change).alias("message"))


@query(
    "stream_suggest_on_change",
    f"""
    WITH {BIGRAM_SQL}, {CONTINUATIONS_SQL},
    e AS (SELECT event_id, doc_id, list_extract({words_sql('left(text, event_id % 400 + 1)')}, -1) AS prev
          FROM (SELECT event_id, (props->>'k')::bigint AS doc_id FROM events WHERE event_type = 'click') JOIN documents USING (doc_id)),
    c AS (SELECT event_id, doc_id, tok, (row_number() OVER (PARTITION BY event_id ORDER BY ln(p) DESC, tok))::int AS rank
          FROM e JOIN next USING (prev) QUALIFY rank <= 3)
    SELECT event_id, rank, json_object('jsonrpc', '2.0', 'method', 'textDocument/completion',
      'params', json_object('event', event_id, 'label', tok))::varchar AS message
    FROM c
    """,
)
def suggest_on_change(spark, folder):
    """A notification per change and continuation of the text that the change brings."""
    docs = documents(spark, folder)
    models = Versions(spark, run_dir(spark, "models"), Bigrams.load)
    models.publish(Bigrams.train(docs, store=False))
    changed = materialise(edits(read_table(spark, folder, "events"), docs), "edits")
    path, files = paced(spark, changed, lambda writer, path: writer.parquet(path))
    stream = stream_events(spark, path, "*.parquet", "event_id bigint, ts timestamp_ntz, message string", files)
    parsed = stream.select("event_id", F.from_json("message", CHANGE_SCHEMA).alias("m"))
    changed = parsed.select("event_id", F.element_at("m.contentChanges", -1)["text"].alias("text"))
    offers = run_dir(spark, "offers")
    run_batches(changed, live.suggest_on_change(models, offers), "suggest-run")
    offered = per_epoch(spark, offers, "event_id bigint, rank int, completion string, version int")
    message = notification("textDocument/completion", event=F.col("event_id"), label=F.col("completion"))
    return offered.select("event_id", "rank", message.alias("message"))
