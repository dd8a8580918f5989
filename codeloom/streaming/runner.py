"""Running a stream over everything available, into tables of the shared folder."""

from pyspark.sql import functions as F

from codeloom.functions.text import micros
from codeloom.session import run_dir


def with_event_time(events, out="at"):
    """Add the event time as an instant (UTC), which watermarks and windows need."""
    return events.withColumn(out, F.timestamp_micros(micros(F.col("ts"))))


def finish(writer, path, timeout):
    stream = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    if not stream.awaitTermination(timeout):
        stream.stop()
        raise TimeoutError(f"stream did not finish within {timeout} s")


def run_append(df, name, timeout=600):
    """Run an append-mode stream to a parquet table and return the table."""
    path = run_dir(df.sparkSession, name)
    writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
    finish(writer, path, timeout)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def run_batches(df, save, name, timeout=600):
    """Run a stream through a ``foreachBatch`` function of (rows, epoch)."""
    path = run_dir(df.sparkSession, name)
    finish(df.writeStream.foreachBatch(save), path, timeout)
