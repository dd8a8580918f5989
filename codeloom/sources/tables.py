"""Scans, event streams, user rows and append-only sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import lines

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df, key):
    """Spread a scan that comes in fewer splits than there are cores (one large row group).

    Only for plain scans, before work that is heavy per row. A scan with enough splits, the normal case on a
    cluster, is returned as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def documents(spark, folder, *columns):
    """The document table, ready for work that is heavy per text."""
    table = read_table(spark, folder, "documents")
    return spread(table.select("doc_id", *(columns or ["text"])), "doc_id")


def conversations(spark, folder):
    return spread(read_table(spark, folder, "conversations"), "conv_id")


def read_sources(spark, path, glob=None):
    """One row per source file: (path, text). Line ends become a single newline."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("value", r"\r\n?", "\n").alias("text"),
    )


def stream_events(spark, folder, glob="*.parquet", schema=EVENT_SCHEMA, files_per_trigger=64):
    """Editor events as a stream over parquet files; the schema is never inferred.

    ``files_per_trigger`` bounds a micro-batch, and with it what one key can bring to one task.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_json(spark, folder, schema):
    """JSON-lines events (changes, telemetry, feedback) as a stream."""
    return spark.readStream.schema(schema).json(folder)


def explode_lines(df, text="text"):
    """One row per line with its 0-based number."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def lookup_users(users, usernames):
    """Rows of the named users; a few names go to the scan as a pushed-down filter."""
    return users.where(F.col("username").isin(list(usernames)))


def register(existing, attempts, key="username", order=("ts", "event_id"), row_id="event_id"):
    """Every registration attempt with ``created``: true for the first one of a new name.

    Names are reduced to their first attempt before the anti join, and the flag comes back on
    the unique attempt id, so a name that is tried very often is never one task's work.
    """
    first = attempts.groupBy(key).agg(F.min_by(row_id, F.struct(*order)).alias(row_id))
    winners = first.join(existing.select(key).distinct(), key, "left_anti")
    winners = winners.select(row_id, F.lit(True).alias("created"))
    return attempts.join(winners, row_id, "left").withColumn(
        "created", F.coalesce("created", F.lit(False))
    )


def append_users(created, path):
    """Append the accepted registrations to the user table."""
    created.where("created").drop("created").write.mode("append").parquet(path)


def notification(method, **fields):
    """JSON-RPC notification text of a row."""
    body = F.struct(*[c.alias(n) for n, c in fields.items()])
    return F.to_json(
        F.struct(F.lit("2.0").alias("jsonrpc"), F.lit(method).alias("method"), body.alias("params"))
    )


def write_notifications(df, column, path):
    """One JSON-RPC message per line."""
    df.select(F.col(column).alias("value")).write.mode("append").option("lineSep", "\r\n").text(path)
