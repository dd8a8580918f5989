"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact check.

Native DataFrame functions only. Windows as long as an item get a 64-bit SimHash of the item
vocabulary's shingles in them, weighted by rarity. A window meets the items of which it holds a heavy
shingle: the heaviest shingles of an item make up more than 100 - PERCENT % of its weight, so any match
holds one of them. A fingerprint is cut into RADIUS + 1 blocks: two fingerprints within RADIUS bits agree
on one block at least, so of the pairs that meet those with an equal block include all pairs within the
radius. (Blocks alone are three bits long, and nearly every pair agrees on one.) A pair at the similarity asked for differs in 64 * 0.15 bits on average and
lies beyond RADIUS = 20 with a probability of about 2 in 10,000. Candidates are checked exactly:

    sum of w * min(count in window, count in item)
    ------------------------------------------------------------------------------  >= PERCENT / 100
    sum of w * max(count in window, count in item) + w0 * shingles foreign to the item

with w = round(16 ln(1 + items / items with the shingle)), at most 255, and w0 that of one item.

Items of over passages.LONGEST words are compared whole, too. Storing each of their windows would grow
with the square of their length, so they are retrieved by their heavy shingles alone, and the sums of their
windows are running sums.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import passages
from codeloom.llm.common import sent_if_small
from codeloom.session import materialise

BITS, RADIUS, PERCENT = 64, 20, 80
WINDOW = ["id", "body", "n", "start"]


def rarity(df):
    """Weight of a shingle that df of ``items`` items hold."""
    return F.least(F.greatest(F.round(16 * F.log1p(F.col("items") / df)), F.lit(1)), F.lit(255)).cast("bigint")


def fingerprint(h="h", w="w"):
    """Aggregate column: bit k is set if the shingles with bit k hold more than half of the weight."""
    share = lambda k: F.sum(F.shiftrightunsigned(F.col(h), k).bitwiseAND(F.lit(1)) * F.col(w))
    bits = [F.when(2 * share(k) > F.sum(w), F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(F.lit(0)) for k in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def blocks(mark="mark"):
    """Array column of (block, value) that cuts a fingerprint into RADIUS + 1 parts."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(F.col(mark), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"),
            )
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
        ]
    )


def item_tables(benchmark: DataFrame, key="item_id", text="text", pieces=False):
    """Stored tables of item shingles, of the vocabulary, and of item fingerprints by block.

    The vocabulary of items that are too long for stored windows has n = 0.
    """
    items = benchmark.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
    rows = materialise(passages.known(items.where(F.col("item").isNotNull()), pieces), "items")
    number = F.lit(rows.select(F.count_distinct("item")).first()[0])
    df = rows.groupBy("h").agg(F.count_distinct("item").alias("df")).withColumn("items", number)
    weights = df.select("h", rarity(F.col("df")).alias("w"))
    rows = materialise(rows.join(weights, "h"), "items")
    marks = rows.withColumn("weight", F.col("w") * F.col("count")).groupBy("item", "piece", "n")
    marks = marks.agg(F.sum("weight").alias("total"), fingerprint(w="weight").alias("mark"))
    marks = materialise(marks.withColumn("items", number), "marks")
    least = marks.groupBy("n").agg(F.ceil(F.min("total") * PERCENT / 100).cast("bigint").alias("least"))
    vocabulary = rows.where(F.col("n") <= passages.LONGEST).select("h", "n", "w").distinct().join(least, "n")
    long = rows.where(F.col("n") > passages.LONGEST).select("h", F.lit(0).alias("n"), "w", F.lit(0).cast("bigint").alias("least"))
    return rows, marks, materialise(vocabulary.unionByName(long.distinct()), "vocabulary")


def heavy(rows, marks):
    """(item, piece, n, total, items, h): each item's heaviest shingles, of more than 100 - PERCENT % of its weight."""
    order = Window.partitionBy("item", "piece", "n").orderBy(F.desc("w"), "h")
    above = F.coalesce(F.sum(F.col("w") * F.col("count")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("above", above).join(marks.select("item", "piece", "n", "total", "items"), ["item", "piece", "n"])
    placed = placed.where(F.col("above") * 100 <= F.col("total") * (100 - PERCENT))
    return sent_if_small(materialise(placed.select("item", "piece", "n", "total", "items", "h"), "heavy"))


def whole_items(found, rows, marks):
    """(id, item, similarity) of the windows that match an item of over LONGEST words, from its hits."""
    rows = materialise(rows.where(F.col("n") > passages.LONGEST), "long")
    if rows.isEmpty():
        return None
    pairs = found.drop("n").join(heavy(rows, marks), "h").select("id", "body", "item", "piece", "n", "total", "items")
    pairs = materialise(pairs.distinct(), "pairs")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("id", "body")]
    both = found.drop("n", "w", "least").alias("l").join(pairs.alias("r"), same).select("l.*", "item", "piece", "n", "total", "items")
    both = both.join(sent_if_small(rows), ["item", "piece", "n", "h"])
    sums = passages.sliding(both)
    whole = F.col("total") + F.col("more") + (F.col("size") - F.col("own")) * rarity(F.lit(1))
    sums = sums.withColumn("whole", whole).where(F.col("common") * 100 >= F.col("whole") * PERCENT)
    return sums.select("id", "item", (F.col("common") / F.col("whole")).alias("similarity"))


def candidates(inside, own, rows, marks) -> DataFrame:
    """(window, item, piece, total, items) of the windows and items whose fingerprints are within the radius.

    ``inside`` holds the shingles of windows, ``own`` their fingerprints.
    """
    near = heavy(rows, marks).select("item", "piece", "n", "h")
    met = inside.select(*WINDOW, "h").join(near, ["n", "h"]).select(*WINDOW, "item", "piece").distinct()
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in WINDOW]
    met = met.alias("l").join(own.alias("r"), same).select("l.*", "mark")
    wanted = sent_if_small(marks).select("item", "piece", "n", "total", "items", F.col("mark").alias("wanted"))
    pairs = met.join(wanted, ["item", "piece", "n"]).where(F.arrays_overlap(blocks("mark"), blocks("wanted")))
    pairs = pairs.where(F.bit_count(F.col("mark").bitwiseXOR(F.col("wanted"))) <= RADIUS)
    return pairs.select(*WINDOW, "item", "piece", "total", "items")


def leaks(docs: DataFrame, benchmark: DataFrame, key="doc_id", text="text", item="item_id", pieces=False) -> DataFrame:
    """(id, item, similarity) of every document that holds a benchmark item, the best window of each.

    Null and empty texts, and items with fewer than five words or without an id, match nothing; a
    repeated item id counts once per different text. Repeated rows give one row. Documents without
    an id can leak too; their id is null. Every item is compared whole; with ``pieces`` an item of over
    256 words is compared in pieces of equal length, and one piece makes a leak.
    """
    rows, marks, vocabulary = item_tables(benchmark, item, "text", pieces)
    hits = materialise(passages.hits(docs, sent_if_small(vocabulary), key, text), "hits")
    long = None if pieces else whole_items(hits.where("n = 0"), rows, marks)
    found = hits.where("n > 0")
    inside = passages.windows(found).groupBy(*WINDOW, "size", "h", "w").agg(F.count("*").alias("seen"))
    inside = materialise(inside, "windows")
    own = inside.withColumn("weight", F.col("w") * F.col("seen")).groupBy(*WINDOW).agg(fingerprint(w="weight").alias("mark"))
    pairs = candidates(inside, own, rows.where(F.col("n") <= passages.LONGEST), marks)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in WINDOW]
    both = inside.alias("l").join(pairs.alias("r"), same).select("l.*", "item", "piece", "total", "items")
    both = both.join(sent_if_small(rows).select("item", "piece", "n", "h", "count"), ["item", "piece", "n", "h"])
    sums = both.groupBy(*WINDOW, "size", "item", "piece", "total", "items").agg(
        F.sum(F.col("w") * F.least("seen", "count")).alias("common"),
        F.sum(F.col("w") * F.greatest(F.col("seen") - F.col("count"), F.lit(0))).alias("more"),
        F.sum("seen").alias("own"),
    )
    whole = F.col("total") + F.col("more") + (F.col("size") - F.col("own")) * rarity(F.lit(1))
    sums = sums.withColumn("whole", whole).where(F.col("common") * 100 >= F.col("whole") * PERCENT)
    sums = sums.select("id", "item", (F.col("common") / F.col("whole")).alias("similarity"))
    both = sums if long is None else sums.unionByName(long)
    return both.groupBy("id", "item").agg(F.max("similarity").alias("similarity"))
