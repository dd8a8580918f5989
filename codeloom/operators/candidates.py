"""Ranking of suggestion candidates per request."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom import params


def rank(candidates, request, tie, n=params.STREAM_SUGGESTIONS, score="score", out="rank"):
    """The ``n`` best candidates per request by descending score, ties by ``tie``.

    ``row_number() <= n`` becomes a per-task limit before the shuffle (WindowGroupLimit), so a
    request with very many candidates sends at most ``n`` rows per task.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    order = Window.partitionBy(*request).orderBy(F.desc(score), tie)
    return candidates.withColumn(out, F.row_number().over(order)).where(F.col(out) <= n)
