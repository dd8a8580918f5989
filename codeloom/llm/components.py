"""Connected components of a table of links, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialise


def _large(edges):
    """Links every larger neighbour of a node to the smallest one."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small(edges):
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return rest.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _state(edges):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with a link: the smallest id it can reach.

    ``edges`` has columns a and b of one orderable type; links to itself, repeated links and null
    ends are ignored. Each round is stored in the shared folder; rounds grow with the logarithm of
    the longest chain.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = materialise(_small(_large(edges)), "links")
        after = _state(edges)
        if after == state:
            break
        state = after
    heads = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(heads)
