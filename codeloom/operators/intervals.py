"""Joins of points in time with time spans of very different length."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialise
from codeloom.skew import same

BASE = 60 * 1000000  # width of the finest bins, in microseconds


def interval_join(points: DataFrame, spans: DataFrame, keys, t="t", start="start", end="end", base=BASE, how="inner") -> DataFrame:
    """Rows of ``points`` with every span of the same key that holds their time: start <= t < end.

    A span belongs to the level whose bins are as long as it is, or longer by less than twice, so it
    lies in two bins at most, however long it is; a point looks into one bin per level that occurs.
    Both meet by (key, level, bin): an equality join, in which a key with very many rows is spread over
    its bins, and adaptive execution splits what is left. Missing keys match missing keys; a point without
    a time and an empty span, or one without a start or an end, match nothing. With ``how`` = "left" points
    without a span stay, with nulls. Of the spans, keys are left out of the result.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    length = F.col(end) - F.col(start)
    level = F.greatest(F.ceil(F.log2(length / F.lit(base))), F.lit(0)).cast("int")
    held = materialise(spans.where(length > 0).withColumn("_level", level), "spans")
    width = F.lit(base) * F.expr("shiftleft(1L, _level)")
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # at most 64
    bins = F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.floor((F.col(end) - 1) / width).cast("bigint"))
    binned = held.withColumn("_bin", F.explode(bins))
    looks = [
        F.struct(F.lit(i).alias("_level"), F.floor(F.col(t) / F.lit(base << i)).cast("bigint").alias("_bin")) for i in levels
    ] or [F.struct(F.lit(-1).alias("_level"), F.lit(0).cast("bigint").alias("_bin"))]
    if how == "left":
        points = points.withColumn("_point", F.monotonically_increasing_id())
        points = materialise(points, "points")
    placed = points.select("*", F.inline(F.array(*looks)))
    meet = same("l", "r", [*keys, "_level", "_bin"]) & (F.col(f"l.{t}") >= F.col(f"r.{start}")) & (F.col(f"l.{t}") < F.col(f"r.{end}"))
    added = [c for c in spans.columns if c not in keys]
    found = placed.alias("l").join(binned.alias("r"), meet).select(*[f"l.{c}" for c in points.columns], *[f"r.{c}" for c in added])
    if how != "left":
        return found
    lost = points.join(found.select("_point").distinct(), "_point", "left_anti")
    return found.unionByName(lost, allowMissingColumns=True).drop("_point")


def live_tokens(requests: DataFrame, tokens: DataFrame, user="user_id", t="t", row_id="event_id", base=BASE) -> DataFrame:
    """Requests with ``live``, the number of their user's valid tokens, and ``token``, the one issued last (ties: largest id).

    ``tokens`` has user, token, issued, lifetime and revoked (a time or null): a token is valid from
    its issue on, before its end and before its revocation. Request ids are unique.
    """
    end = F.least(F.col("issued") + F.col("lifetime"), F.coalesce("revoked", F.col("issued") + F.col("lifetime")))
    spans = tokens.select(user, "token", "issued", end.alias("_end"))
    found = interval_join(requests.select(user, t, row_id), spans, user, t, "issued", "_end", base)
    held = found.groupBy(row_id).agg(F.count("*").alias("live"), F.max(F.struct("issued", "token")).alias("_last"))
    held = held.select(row_id, "live", F.col("_last.token").alias("token"))
    return requests.join(held, row_id, "left").withColumn("live", F.coalesce("live", F.lit(0)))
