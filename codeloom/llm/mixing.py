"""Mixing sources to target weights; DataFrame functions only.

A source's words, its documents in order of their id, are packed into blocks of a fixed number of
words. The mix is a sequence of slots, one block each, in shards of a fixed number of slots. Every
slot of a shard draws its source by weight, so a shard's counts are multinomial. A source that was
drawn more often than its target needs gives the extra slots, picked at random, to sources drawn too
seldom, so totals are exact. The slots of a source are numbered and numbers mapped to blocks by a
pseudorandom permutation of the source's blocks, another one for each pass over them; slots and
blocks are then joined by (source, block). The last slot needed is cut where the target is reached.

All randomness comes from MD5 of names and numbers: reruns agree, whatever the partitions.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import sent_if_small
from codeloom.llm.order import running
from codeloom.session import materialise
from codeloom.skew import null_safe_join

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 4  # half rounds of a permutation
WALK = 64  # passes at most until a permuted number falls below n; out of reach for more than 4096 numbers
SLOTS_PER_TASK = 1_000_000


def draw(*names):
    """Column: 60 bits of the MD5 of names and numbers."""
    text = F.concat_ws(":", *[(F.lit(n) if isinstance(n, (str, int)) else n).cast("string") for n in names])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def whole(x, by):
    """Column: x divided by a positive number, rounded down; exact for all that occurs here."""
    return ((x - x % by) / by).cast("bigint")


def permuted(x, n, *names, back=False):
    """Column: where the pseudorandom permutation ``names`` of 0..n-1 sends x, or with ``back`` what it sends to x.

    A Feistel network on pairs (left of a, right of b) with a * b >= n, passed again while the
    result is not below n.
    """
    n = F.greatest(n, F.lit(1))
    a = F.ceil(F.sqrt(n)).cast("bigint")
    b = whole(n + a - 1, a)

    def turn(pair, i):
        left, right = pair[0], pair[1]
        if back:
            left_too = F.pmod(left - draw(*names, i, right) % a, a)
            right_too = F.pmod(right - draw(*names, i, left) % b, b)
        else:
            left_too = (left + draw(*names, i, right)) % a
            right_too = (right + draw(*names, i, left)) % b
        return F.when(i % 2 == 0, F.array(left_too, right)).otherwise(F.array(left, right_too))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def once(y):
        return F.aggregate(
            F.array(*[F.lit(i) for i in order]), F.array(whole(y, b), y % b), turn, lambda pair: pair[0] * b + pair[1]
        )

    steps = F.sequence(F.lit(1).cast("bigint"), F.least(a * b - n + 1, F.lit(WALK)))
    return F.aggregate(steps, x.cast("bigint"), lambda y, k: F.when((k > 1) & (y < n), y).otherwise(once(y)))


def within(points: DataFrame, spans: DataFrame, total) -> DataFrame:
    """Joins ``point`` in 0..total-1 with the one of the spans (lo, hi, ...) that holds it.

    The range is cut into as many cells as there are spans, and both sides meet by cell.
    """
    spans = materialise(spans.where("hi > lo"), "spans")
    width = F.lit(max(1, -(-total // max(1, spans.count()))))
    cells = spans.withColumn("cell", F.explode(F.sequence(whole(F.col("lo"), width), whole(F.col("hi") - 1, width))))
    cells = sent_if_small(materialise(cells, "cells"))
    return points.withColumn("cell", whole(F.col("point"), width)).join(cells, "cell").where("point >= lo and point < hi").drop("cell")


def targets(sources: DataFrame, weights=(5, 2, 1), share=1.5, most=2) -> DataFrame:
    """Adds weight and target to sources (rank, words, ...); stored.

    Weights repeat along the rank. Together the targets are ``share`` of all words; none is above ``most``
    times its source's words, and what that cuts off is shared by weight among the others. Sorted by words
    against weight, the sources that are cut come first; the level of the others is found by running sums.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("bigint")).withColumn("room", F.col("words") * most)
    sources = running(sources.withColumn("ratio", F.col("room") / F.col("weight")), ["ratio", "rank"], spent=F.col("room"), passed=F.col("weight"))
    words, weighed = sources.agg(F.sum("words"), F.sum("weight")).first()
    level = (F.lit(share * (words or 0)) - F.col("spent")) / (F.lit(weighed or 1) - F.col("passed"))
    fits = sources.withColumn("level", level).where("level * weight <= room")
    found = fits.agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0] or 0.0
    target = F.least(F.lit(found) * F.col("weight"), F.col("room").cast("double"))
    return materialise(sources.withColumn("target", target).drop("ratio", "spent", "passed", "room"), "targets")


class Mix(NamedTuple):
    docs: DataFrame  # id, name (source), rank, start, size, source_size, target, taken, text; one row per document
    pieces: DataFrame  # shard, slot, at, id, first, words, rank, start: in order of (shard, slot, at) the mix itself
    sources: DataFrame  # name, rank, words, weight, target, quota, drawn


def mix(
    docs: DataFrame, key="doc_id", text="text", source="source", weights=(5, 2, 1), share=1.5, most=2, block=128, per_shard=8192, texts=False
) -> Mix:
    """The mix of all documents, as pieces: ``words`` words of document ``id`` from word ``first`` on.

    Words are runs of anything but ASCII white space; a null or empty text has none and is never
    taken. Sources rank by code point, a null source last, and are one source each. A null id is an id
    like any other, repeated rows are documents of their own. No document is taken more than ``most`` times (a
    whole number), and the words taken of a source are its target, rounded. Without words the mix is
    empty. ``texts`` keeps the texts, for ``mixed_texts``. Other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    kept = F.col(text).cast("string") if texts else F.lit(None).cast("string")
    rows = docs.select(F.col(source).alias("name"), F.col(key).alias("id"), size.alias("size"), kept.alias("text"))
    by_name = F.col("name").asc_nulls_last()
    packed = running(rows, [by_name, "id", "size"], start=F.col("size"))
    sources = packed.groupBy("name").agg(F.sum("size").alias("words"), F.min("start").alias("begin"))
    sources = targets(running(sources, [by_name], rank=F.lit(1)), weights, share, most)
    goal = F.floor(F.col("target") + 0.5).cast("bigint")
    blocks = whole(F.col("words") + block - 1, F.lit(block))
    quota = F.least(whole(F.col("goal") + block - 1, F.lit(block)) + most, F.col("blocks") * most)
    sources = sources.withColumns({"goal": goal, "blocks": blocks})
    sources = running(sources.withColumn("quota", F.when(F.col("goal") > 0, quota).otherwise(0)), ["rank"], lo=F.col("quota"))
    sources, slots = _slots(sources, block, most, per_shard)

    known = sent_if_small(sources.select("name", "rank", "begin", F.col("words").alias("source_size"), "target"))
    packed = null_safe_join(packed, known, "name").withColumn("start", F.col("start") - F.col("begin")).drop("begin")
    last = F.col("start") + F.col("size") - 1
    index = F.explode(F.sequence(whole(F.col("start"), F.lit(block)), whole(last, F.lit(block))))
    parts = packed.where("size > 0").select("rank", "id", "start", "size", index.alias("index"))
    at, first = F.greatest(F.col("start") - F.col("index") * block, F.lit(0)), F.greatest(F.col("index") * block - F.col("start"), F.lit(0))
    parts = parts.withColumns({"at": at, "first": first})
    n = F.least(F.col("size") - F.col("first"), F.lit(block) - F.col("at"))
    parts = parts.withColumn("n", n).drop("size")
    pieces = slots.join(parts, ["rank", "index"]).withColumn("words", F.least(F.col("take") - F.col("at"), F.col("n"))).where("words > 0")
    taken = pieces.groupBy("rank", "start").agg(F.sum("words").alias("taken"))
    # only a document with words owns its place in the source
    both = packed.withColumn("place", F.when(F.col("size") > 0, F.col("start"))).alias("l").join(
        taken.withColumnRenamed("start", "place").alias("r"), ["rank", "place"], "left"
    )
    taken = F.coalesce("taken", F.lit(0)).alias("taken")
    done = both.select("id", "name", "rank", "start", "size", "source_size", "target", taken, "text")
    return Mix(done, pieces.select("shard", "slot", "at", "id", "first", "words", "rank", "start"), sources.select("name", "rank", "words", "weight", "target", "quota", "drawn"))


def _slots(sources, block, most, per_shard):
    """The sources with how often each was drawn, and (shard, slot, rank, index, take) of the slots that take words."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // SLOTS_PER_TASK))
    numbers = spark.range(0, total, 1, tasks).select(F.col("id").alias("slot"), whole(F.col("id"), F.lit(per_shard)).alias("shard"))
    points = numbers.withColumn("point", draw("draw", F.col("slot")) % max(1, total))
    spans = sources.select("rank", "lo", (F.col("lo") + F.col("quota")).alias("hi"))
    drawn = materialise(within(points, spans, total).select("shard", "slot", "rank"), "drawn")

    counts = running(drawn.groupBy("rank", "shard").agg(F.count("*").alias("n")), ["rank", "shard"], earlier=F.col("n"))
    sums = counts.groupBy("rank").agg(F.sum("n").alias("drawn"), F.min("earlier").alias("zero"))
    sources = sources.drop("lo").join(sums, "rank", "left").fillna(0, ["drawn", "zero"])
    surplus, lack = (F.greatest(x, F.lit(0)) for x in (F.col("drawn") - F.col("quota"), F.col("quota") - F.col("drawn")))
    sources = running(sources.withColumns({"surplus": surplus, "lack": lack}), ["rank"], spare=F.col("surplus"), lo=F.col("lack"))
    extra = sources.agg(F.sum("surplus")).first()[0] or 0

    # the slots of a source, numbered from 0; those of a source drawn too often in random order
    window = F.row_number().over(Window.partitionBy("rank", "shard").orderBy("slot")) - 1
    known = sent_if_small(sources.select("rank", "quota", "drawn", "zero", "spare"))
    own = drawn.withColumn("nth", window).join(counts.select("rank", "shard", "earlier"), ["rank", "shard"]).join(known, "rank")
    nth = F.col("earlier") - F.col("zero") + F.col("nth")
    shuffled = permuted(nth, F.col("drawn"), "keep", F.col("rank"))
    own = own.withColumn("place", F.when(F.col("drawn") > F.col("quota"), shuffled).otherwise(nth))
    own = materialise(own.select("shard", "slot", "rank", "place", "quota", "spare"), "numbered")
    kept = own.where("place < quota").select("shard", "slot", "rank", "place")
    moved = own.where("place >= quota").select("shard", "slot", (F.col("spare") + F.col("place") - F.col("quota")).alias("extra"))
    moved = moved.withColumn("point", permuted(F.col("extra"), F.lit(max(1, extra)), "spare"))
    spans = sources.select("rank", "drawn", "lo", (F.col("lo") + F.col("lack")).alias("hi"))
    given = within(moved, spans, extra).select("shard", "slot", "rank", (F.col("drawn") + F.col("point") - F.col("lo")).alias("place"))

    short = F.col("words") % block  # words of the last block, if it is not full
    last = [
        F.lit(e) * F.col("blocks") + permuted(F.col("blocks") - 1, F.col("blocks"), "block", F.col("rank"), e, back=True) for e in range(most)
    ]
    ends = F.when((short > 0) & (F.col("blocks") > 0), F.array(*last)).otherwise(F.array().cast("array<bigint>"))
    known = sent_if_small(materialise(sources.select("rank", "words", "goal", "blocks", ends.alias("ends")), "last-blocks"))
    slots = kept.unionByName(given).join(known, "rank")
    turn = whole(F.col("place"), F.col("blocks"))
    slots = slots.withColumn("index", permuted(F.col("place") % F.col("blocks"), F.col("blocks"), "block", F.col("rank"), turn))
    slots = materialise(slots, "slots")
    gaps = F.size(F.filter("ends", lambda p: p < F.col("place")))
    before = F.col("place") * block - (F.lit(block) - short) * gaps
    length = F.least(F.col("words") - F.col("index") * block, F.lit(block))
    take = F.least(F.col("goal") - before, length)
    return sources, slots.withColumn("take", take).where("take > 0").select("shard", "slot", "rank", "index", "take")


def mixed_texts(mixed: Mix) -> DataFrame:
    """(shard, slot, text) of a mix made with ``texts``: the words of every slot, joined by one space."""
    uses = mixed.pieces.groupBy("rank", "start").agg(F.collect_list(F.struct("shard", "slot", "at", "first", "words")).alias("uses"))
    rows = mixed.docs.where("size > 0").select("rank", "start", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("all"))
    cut = rows.join(uses, ["rank", "start"]).select("all", F.explode("uses").alias("u"))
    part = F.slice("all", (F.col("u.first") + 1).cast("int"), F.col("u.words").cast("int"))
    cut = cut.select("u.shard", "u.slot", "u.at", F.array_join(part, " ").alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("at", "part")))
    return cut.groupBy("shard", "slot").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("text"))
