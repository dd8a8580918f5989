"""Limits, cache and telemetry over the event table."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import micros
from codeloom.operators import telemetry as tele
from codeloom.operators import traffic
from codeloom.plans.registry import query
from codeloom.sources.tables import read_table

DAY = 86400 * traffic.SECOND
HOUR = 3600 * traffic.SECOND


def requests(spark, folder):
    events = read_table(spark, folder, "events")
    return events.withColumn("t", micros(F.col("ts")))


def throttle_sql(limit, window, key):
    return f"""
    WITH r AS (SELECT {key} AS k, event_id, epoch_us(ts) AS t FROM events),
    c AS (SELECT k, event_id, t, count(*) OVER w AS arrivals, min(t) OVER w AS oldest FROM r
          WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN {window - 1} PRECEDING AND 1 PRECEDING))
    SELECT event_id, t, arrivals, CASE WHEN arrivals >= {limit} THEN {window} - (t - oldest) ELSE 0 END AS delay FROM c
    """


@query("throttle_delay", throttle_sql(3, DAY, "user_id"))
def throttle_delay(spark, folder):
    decided = traffic.throttle(requests(spark, folder), "user_id", "t", "event_id", 3, DAY)
    return decided.drop("user_id")


@query("throttle_default", throttle_sql(params.THROTTLE_LIMIT, params.THROTTLE_WINDOW_S * 1000000, "event_type"))
def throttle_default(spark, folder):
    """Default limits, by event type: few and busy keys."""
    return traffic.throttle(requests(spark, folder), "event_type", "t", "event_id").drop("event_type")


def debounce_sql(gap, key):
    return f"""
    WITH r AS (SELECT {key}, event_id, epoch_us(ts) AS t,
                 lead(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS next FROM events)
    SELECT {key}, event_id, t FROM r WHERE next IS NULL OR next >= t + {gap}
    """


@query("debounce", debounce_sql(HOUR, "user_id"))
def debounce(spark, folder):
    return traffic.debounce(requests(spark, folder), ["user_id"], "t", "event_id", HOUR)


@query("debounce_command", debounce_sql(params.DEBOUNCE_MS * 1000, "user_id, event_type"))
def debounce_command(spark, folder):
    """Default gap per user and command."""
    return traffic.debounce(requests(spark, folder), ["user_id", "event_type"], "t", "event_id")


def limit_sql(limit, period):
    """One user's events in order; the array holds the allowed times, newest last."""
    return f"""
    WITH RECURSIVE r AS (
      SELECT user_id, event_id, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (
      SELECT user_id, event_id, i, true AS allowed, [t] AS kept FROM r WHERE i = 1
      UNION ALL
      SELECT r.user_id, r.event_id, r.i,
             len(list_filter(f.kept, lambda x: r.t - x < {period})) < {limit},
             CASE WHEN len(list_filter(f.kept, lambda x: r.t - x < {period})) < {limit}
                  THEN list_append(list_filter(f.kept, lambda x: r.t - x < {period}), r.t)
                  ELSE list_filter(f.kept, lambda x: r.t - x < {period}) END
      FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
    SELECT event_id, allowed FROM f
    """


@query("rate_limit", limit_sql(3, DAY))
def rate_limit(spark, folder):
    decided = traffic.rate_limit(
        requests(spark, folder), "user_id", "t", "event_id", 3, DAY
    )
    return decided.select("event_id", "allowed")


@query("rate_limit_hourly", limit_sql(2, HOUR))
def rate_limit_hourly(spark, folder):
    decided = traffic.rate_limit(requests(spark, folder), "user_id", "t", "event_id", 2, HOUR)
    return decided.select("event_id", "allowed")


@query(
    "cache_split",
    """
    WITH cached AS (SELECT user_id, props, arg_max('cached ' || event_id, (ts, event_id)) AS known
                    FROM events WHERE event_type = 'purchase' GROUP BY ALL),
    r AS (SELECT user_id, props, event_id,
            row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'click')
    SELECT event_id, known IS NOT NULL AS hit, known IS NULL AND i = 1 AS computes,
           coalesce(known, md5(user_id || props)) AS result
    FROM r LEFT JOIN cached USING (user_id, props)
    """,
)
def cache_split(spark, folder):
    events = read_table(spark, folder, "events")
    label = F.concat(F.lit("cached "), "event_id")
    cached = events.where("event_type = 'purchase'").groupBy("user_id", "props").agg(
        F.max_by(label, F.struct("ts", "event_id")).alias("result")
    )
    asked = events.where("event_type = 'click'").select("user_id", "props", "ts", "event_id")
    served = traffic.cache_lookup(
        asked, cached, ["user_id", "props"], ["ts", "event_id"], "event_id",
        F.md5(F.concat("user_id", "props")),
    )
    return served.select("event_id", "hit", "computes", "result")


@query(
    "cache_lru_keep",
    f"""
    SELECT user_id, props, max(ts) AS last_used FROM events GROUP BY ALL
    ORDER BY last_used DESC, user_id, props LIMIT {params.CACHE_SIZE}
    """,
)
def cache_keep(spark, folder):
    return traffic.newest_keys(read_table(spark, folder, "events"), ["user_id", "props"], "ts")


@query(
    "latest_doc_state",
    """
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max((props->>'k')::int, (ts, event_id)) AS line
    FROM events GROUP BY user_id
    """,
)
def latest_doc_state(spark, folder):
    """Newest change per document (one per user), with the line of its last change."""
    events = read_table(spark, folder, "events")
    changed = events.withColumn(
        "state", F.struct("event_type", F.from_json("props", "k int")["k"].alias("line"))
    )
    newest = traffic.latest_state(changed, "user_id", ["ts", "event_id"], "state")
    return newest.select("user_id", "state.*")


TELEMETRY_SQL = """
tele AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'completion' END AS event_name,
           CASE WHEN (props->>'k')::int >= 50 THEN 'success' ELSE 'failure' END AS status FROM events)
"""


@query(
    "telemetry_counts",
    f"WITH {TELEMETRY_SQL} SELECT event_name, status, count(*) AS n FROM tele GROUP BY ALL",
)
def telemetry_counts(spark, folder):
    return tele.counts(tele.telemetry(read_table(spark, folder, "events")))


@query(
    "telemetry_tumbling",
    f"WITH {TELEMETRY_SQL} SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_name, count(*) AS n FROM tele GROUP BY ALL",
)
def telemetry_tumbling(spark, folder):
    return tele.windowed_counts(tele.telemetry(read_table(spark, folder, "events")))


@query(
    "telemetry_sliding",
    f"""
    WITH {TELEMETRY_SQL}, w AS (SELECT event_name, time_bucket(INTERVAL 3 HOURS, ts) AS b FROM tele)
    SELECT start, event_name, count(*) AS n
    FROM (SELECT event_name, b AS start FROM w UNION ALL SELECT event_name, b - INTERVAL 3 HOURS FROM w) GROUP BY ALL
    """,
)
def telemetry_sliding(spark, folder):
    events = tele.telemetry(read_table(spark, folder, "events"))
    return tele.windowed_counts(events, "6 hours", "3 hours")


@query(
    "feedback_rates",
    """
    SELECT user_id, count(*) AS n, avg((event_type = 'purchase')::int) AS accepted_rate, round(avg(value), 6) AS mean_rating
    FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id
    """,
)
def feedback_rates(spark, folder):
    events = read_table(spark, folder, "events").where(F.col("event_type").isin("purchase", "view"))
    feedback = events.select(
        "user_id", (F.col("event_type") == "purchase").alias("accepted"), F.col("value").alias("rating")
    )
    rates = tele.feedback_rates(feedback, ["user_id"])
    return rates.withColumn("mean_rating", F.round("mean_rating", 6))
