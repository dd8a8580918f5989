"""Telemetry and feedback summaries."""

from pyspark.sql import functions as F


def event_name(event_type):
    return F.when(event_type == "error", "error").otherwise("completion")


def telemetry(events):
    """(event_name, ts, status, user): editor events in telemetry form.

    ``props`` is JSON with an integer ``k``; an error keeps its type, others get a status.
    """
    k = F.from_json("props", "k int")["k"]
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "value",
        event_name(F.col("event_type")).alias("event_name"),
        F.when(k >= 50, "success").otherwise("failure").alias("status"),
    )


def counts(events):
    return events.groupBy("event_name", "status").agg(F.count("*").alias("n"))


def windowed_counts(events, length="6 hours", slide=None):
    """Events per tumbling or sliding window and name."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(window.alias("w"), "event_name").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "event_name", "n"
    )


def feedback_rates(feedback, by):
    """Acceptance rate and mean rating per group."""
    return feedback.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.col("accepted").cast("int")).alias("accepted_rate"),
        F.avg("rating").alias("mean_rating"),
    )
