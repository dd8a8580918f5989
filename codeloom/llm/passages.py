"""Where known passages may lie in texts, with DataFrame functions only.

A passage is a sequence of words (runs of letters and digits, lower-cased); its features are the
64-bit hashes of its five-word shingles. ``hits`` finds each place of a text where a known shingle
stands, ``windows`` all stretches of a passage's length that hold enough of them. A stretch that is
left out cannot reach the share asked for, so nothing is lost before the comparison.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
LONGEST = 256  # words of a passage; longer ones are cut into pieces, if their caller wants pieces
GAP = r"[^\p{L}\p{N}]+"


def words(text):
    """Column: lower-cased runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def shingles(hashes, size):
    """Column: hashes of all five-word shingles, from word hashes and their number."""
    at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)])
    return F.transform(F.sequence(F.lit(0), size - SHINGLE), at)


def hashed(df: DataFrame, *keep) -> DataFrame:
    """Keeps columns and adds m, the number of shingles, and sh, their hashes; needs column words.

    Explode ``sh`` with an outer generator only: Spark moves the filter that it derives from an
    inner one below the projections, where the words would be hashed anew for every element.
    """
    rows = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    size = F.size("wh")
    return rows.select(
        *keep, F.greatest(size - SHINGLE + 1, F.lit(0)).alias("m"), F.when(size >= SHINGLE, shingles(F.col("wh"), size)).alias("sh")
    )


def known(passages: DataFrame, pieces=True) -> DataFrame:
    """(item, piece, n, h, count) of passages (item, text): pieces of n words and their shingles.

    Passages with fewer than five words have no shingle and are left out. Without ``pieces`` a
    passage is whole however long it is; a number tells the texts of an item of equal length apart.
    """
    rows = passages.select("item", words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    if not pieces:
        rows = rows.distinct().select("item", F.xxhash64("words").alias("piece"), F.size("words").alias("n"), "words")
        rows = hashed(rows, "item", "piece", "n").select("item", "piece", "n", F.explode_outer("sh").alias("h"))
        return rows.groupBy("item", "piece", "n", "h").agg(F.count("*").alias("count"))
    cut = F.greatest(F.ceil(F.size("words") / LONGEST), F.lit(1)).cast("int")
    length = F.ceil(F.size("words") / cut).cast("int")
    rows = rows.select("item", "words", length.alias("step"), F.posexplode(F.sequence(F.lit(0), cut - 1)).alias("piece", "_"))
    part = F.slice("words", F.col("piece") * F.col("step") + 1, F.col("step"))
    rows = rows.select("item", "piece", part.alias("words")).where(F.size("words") >= SHINGLE).distinct()
    rows = hashed(rows.withColumn("n", F.size("words")), "item", "piece", "n", "words")
    rows = rows.select("item", "piece", "n", F.explode_outer("sh").alias("h"))
    return rows.groupBy("item", "piece", "n", "h").agg(F.count("*").alias("count"))


def hits(docs: DataFrame, vocabulary: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(id, body, m, pos, h, n, w, least) of each shingle of ``docs`` that the vocabulary holds.

    ``vocabulary`` has one row per (h, n) with a whole weight w and least, the smallest weight of a
    window of n words that can match. ``body`` tells apart texts that share an id.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("body"), words(F.col("text")).alias("words"))
    rows = hashed(rows, "id", "body").select("id", "body", "m", F.posexplode_outer("sh").alias("pos", "h"))
    return rows.join(vocabulary, "h").distinct()


def windows(found: DataFrame) -> DataFrame:
    """(id, body, n, start, size, h, w): the known shingles of every window that may match.

    Hits are dealt into blocks of n positions, each with the block after it, so a window lies in
    one group of at most 2 n hits however long the text is.
    """
    block = F.floor(F.col("pos") / F.col("n")).cast("int")
    dealt = found.withColumn("block", F.explode(F.array(block, block - 1))).where("block >= 0")
    hit = F.struct("pos", "h", "w")
    groups = dealt.groupBy("id", "body", "m", "n", "least", "block").agg(F.collect_list(hit).alias("known"))
    inside = lambda x, s: (x["pos"] >= s) & (x["pos"] <= s + F.col("n") - SHINGLE)
    weight = lambda s: F.aggregate(
        "known", F.lit(0).cast("bigint"), lambda a, x: a + F.when(inside(x, s), x["w"]).otherwise(F.lit(0).cast("bigint"))
    )
    first = F.col("block") * F.col("n")
    places = F.sequence(first, F.greatest(first, F.least(first + F.col("n"), F.col("m")) - 1))
    starts = F.filter(places, lambda s: weight(s) >= F.col("least"))
    rows = groups.select("id", "body", "m", "n", "known", F.explode_outer(starts).alias("start"))
    rows = rows.where("start is not null")
    kept = F.filter("known", lambda x: inside(x, F.col("start")))
    size = F.least(F.col("n") - SHINGLE + 1, F.col("m") - F.col("start")).alias("size")
    return rows.select("id", "body", "n", "start", size, F.inline_outer(kept)).drop("pos")


def sliding(found: DataFrame) -> DataFrame:
    """(id, item, total, items, common, more, own, size): sums of the windows that may be the best.

    From (id, body, m, item, piece, n, total, items, pos, h, w, count), the places of an item's shingles in a
    text. An occurrence of h counts as common in the windows that hold it but not the count-th one
    before it, and as more in the others that hold it. Both are stretches of window starts, so sums
    over all windows are running sums over the ends of stretches, linear in the places however long the
    item is. Between two ends only the size changes; it falls, so the last start there is the best.
    """
    key = ["id", "body", "m", "item", "piece", "n", "total", "items"]
    places = found.groupBy(*key, "h", "w", "count").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    before = lambda i: F.coalesce(F.get("at", (i - F.col("count")).cast("int")), F.lit(-1))
    stretch = F.transform("at", lambda p, i: F.struct(p.alias("pos"), before(i).alias("before")))
    rows = places.select(*key, "w", F.explode_outer(stretch).alias("x")).select(*key, "w", "x.pos", "x.before")
    first = F.greatest(F.col("pos") - F.col("n") + SHINGLE, F.lit(0))
    shared = F.greatest(first, F.col("before") + 1)
    end = lambda at, own, common, more: F.struct(
        at.alias("start"), F.lit(own).alias("own"), (F.col("w") * common).alias("common"), (F.col("w") * more).alias("more")
    )
    ends = F.array(end(first, 1, 0, 1), end(shared, 0, 1, -1), end(F.col("pos") + 1, -1, -1, 0))
    ends = rows.select(*key, F.explode_outer(ends).alias("x")).groupBy(*key, F.col("x.start").alias("start"))
    ends = ends.agg(*[F.sum(f"x.{c}").alias(c) for c in ("own", "common", "more")])
    order = Window.partitionBy(*key).orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = ends.select(
        *key, F.lead("start").over(order).alias("next"), *[F.sum(c).over(upto).alias(c) for c in ("own", "common", "more")]
    )
    size = F.least(F.col("n") - SHINGLE + 1, F.col("m") - F.col("next") + 1).alias("size")
    return sums.where("own > 0").select("id", "item", "total", "items", "common", "more", "own", size)
