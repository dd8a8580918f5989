"""Rate limit, throttle, debounce and cache decisions over request tables.

Times are integer microseconds. A key with very many requests is cut into time slices and so
shared out over tasks; what a slice needs from outside comes from a small per-slice summary.
Operators that join on a key want it filled: see ``user_key``.
"""

from collections import deque

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom import params
from codeloom.session import materialise
from codeloom.skew import ROWS_PER_TASK, null_safe_join, slice_number, with_width

SECOND = 1000000
CHUNK_PERIODS = 4
MIN_TIME, MAX_TIME = -(1 << 62), 1 << 62


def user_key(user):
    """User id as text; a missing user shares one key."""
    return F.coalesce(user.cast("string"), F.lit(params.ANONYMOUS))


def throttle(requests, key, t, row_id, limit=params.THROTTLE_LIMIT,
             window=params.THROTTLE_WINDOW_S * SECOND, rows=ROWS_PER_TASK):
    """(key, row_id, t, arrivals, delay): the wait until fewer than ``limit`` arrivals are left.

    Arrivals in the last ``window`` count whether delayed or not, in (t, row_id) order. Each
    request is joined by a marker where its window opens. A running count gives the arrivals
    between marker and request, a backward running value the first arrival after the marker;
    both are linear in the rows, which a sliding frame is not. A hot key is cut into time
    slices: a head row brings in the count of earlier slices, a tail row the next arrival.
    """
    def place(at, kind):
        return F.struct(at.cast("long").alias("_t"), F.lit(kind).alias("_kind"))

    requests = materialise(requests.select(key, t, row_id), "requests")
    roles = F.array(place(F.col(t), "own"), place(F.col(t) - F.lit(window), "opens"))
    arrivals = requests.select(key, F.col(row_id).alias("_id"), F.inline(roles))
    placed = (
        with_width(arrivals, key, t, rows, requests)
        .withColumn("_blk", slice_number(F.col("_t")))
        .withColumn("_weight", (F.col("_kind") == "own").cast("long"))
        .withColumn("_seen", F.when(F.col("_kind") == "own", F.col("_t")))
    )
    both = placed.drop("_width").unionByName(slice_edges(placed, key), allowMissingColumns=True)
    part = Window.partitionBy(key, "_blk")
    # A request that leaves exactly when the window opens sorts before the marker.
    late = (F.col("_kind") == "opens").cast("int")
    forward = part.orderBy("_t", late, "_id").rowsBetween(Window.unboundedPreceding, -1)
    backward = part.orderBy(F.desc("_t"), late.desc(), F.desc("_id")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    own = F.col("_kind") == "own"
    counted = both.select(
        key,
        "_id",
        "_t",
        "_kind",
        F.coalesce(F.sum("_weight").over(forward), F.lit(0)).alias("_n"),
        F.last("_seen", ignorenulls=True).over(backward).alias("_oldest"),
    ).where(F.col("_kind").isin("own", "opens"))
    decided = counted.groupBy(key, "_id").agg(
        F.max(F.when(own, F.col("_t"))).alias(t),
        (F.max(F.when(own, F.col("_n"))) - F.max(F.when(~own, F.col("_n")))).alias("arrivals"),
        F.max(F.when(~own, F.col("_oldest"))).alias("_oldest"),
    )
    wait = F.lit(window) - (F.col(t) - F.col("_oldest"))
    return decided.select(
        key,
        F.col("_id").alias(row_id),
        t,
        "arrivals",
        F.when(F.col("arrivals") >= limit, wait).otherwise(F.lit(0)).cast("long").alias("delay"),
    )


def slice_edges(placed, key):
    """Head and tail rows of the slices of hot keys."""
    summary = placed.where("_width is not null").groupBy(key, "_blk").agg(
        F.sum("_weight").alias("_weight"), F.min("_seen").alias("_seen")
    )
    timeline = Window.partitionBy(key)
    earlier = timeline.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    later = timeline.orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    outside = summary.select(
        key,
        "_blk",
        F.sum("_weight").over(earlier).alias("_before"),
        F.last("_seen", ignorenulls=True).over(later).alias("_after"),
    )
    head = edge("head", F.lit(MIN_TIME), weight=F.col("_before"))
    tail = edge("tail", F.lit(MAX_TIME), seen=F.col("_after"))
    return outside.select(key, "_blk", F.inline(F.array(head, tail)))


def edge(kind, at, weight=None, seen=None):
    """One head or tail row of a slice."""
    def known(value):
        return (F.lit(None) if value is None else value).cast("long")

    return F.struct(
        at.cast("long").alias("_t"),
        F.lit(kind).alias("_kind"),
        known(weight).alias("_weight"),
        known(seen).alias("_seen"),
    )


def debounce(events, key, t, row_id, gap=params.DEBOUNCE_MS * 1000):
    """The events no other event of the same key follows within ``gap``.

    In a block of length ``gap`` only the last event can fire, and it fires when the next
    block does not start within ``gap``; so two mergeable aggregates per block are enough.
    """
    key = list(key)
    blocks = events.withColumn("_blk", F.floor(F.col(t) / F.lit(gap)).cast("long"))
    ends = blocks.groupBy(*key, "_blk").agg(
        F.max(F.struct(t, row_id)).alias("_last"), F.min(t).alias("_first")
    )
    none = F.lit(None)
    both = ends.select(
        *key,
        F.inline(
            F.array(
                block_end(F.col("_blk"), F.col("_last"), none.cast("long")),
                block_end(F.col("_blk") - 1, none.cast(ends.schema["_last"].dataType), F.col("_first")),
            )
        ),
    )
    merged = both.groupBy(*key, "_blk").agg(F.max("_last").alias("_last"), F.max("_next").alias("_next"))
    quiet = F.col("_next").isNull() | (F.col("_next") >= F.col(f"_last.{t}") + F.lit(gap))
    fired = merged.where(F.col("_last").isNotNull() & quiet)
    return fired.select(*key, f"_last.{t}", f"_last.{row_id}")


def block_end(block, last, following):
    """What a block knows of its own last event, or of the first event of the next block."""
    return F.struct(block.alias("_blk"), last.alias("_last"), following.cast("long").alias("_next"))


def fold(limit, period, emit):
    """mapInPandas body: walk sorted chunks with a queue of at most ``limit`` allowed times.

    A chunk may begin with a row that carries the queue it starts from. With ``emit`` =
    "denied" the denied rows come out, with "exit" one row per chunk with its final queue.
    """

    def run(batches):
        current, queue = None, deque()
        for batch in batches:
            out = []
            for unit, t, row_id, own, state in zip(
                zip(batch["_key"], batch["_c0"], batch["_chunk"]),
                batch["_t"], batch["_id"], batch["_own"], batch["_state"],
            ):
                if unit != current:
                    if emit == "exit" and current is not None:
                        out.append((*current, list(queue)))
                    current, queue = unit, deque()
                if state is not None:
                    queue.extend(state)
                    continue
                while queue and t - queue[0] >= period:
                    queue.popleft()
                if len(queue) < limit:
                    queue.append(t)
                elif own and emit == "denied":
                    out.append((row_id,))
            if out:
                yield pd.DataFrame(out, columns=COLUMNS[emit])
        if emit == "exit" and current is not None:
            yield pd.DataFrame([(*current, list(queue))], columns=COLUMNS[emit])

    return run


COLUMNS = {"denied": ["_id"], "exit": ["_key", "_c0", "_chunk", "_exit"]}
UNIT = ["_key", "_c0", "_chunk"]


def folded(rows, states, limit, period, emit, row_id_type="bigint"):
    """Run ``fold`` over chunk rows, each chunk starting from its row in ``states``."""
    heads = states.select(
        *UNIT,
        F.lit(MIN_TIME).cast("long").alias("_t"),
        F.lit("0").cast(rows.schema["_id"].dataType).alias("_id"),
        F.col("_entry").alias("_state"),
    )
    both = rows.withColumn("_state", F.lit(None).cast("array<bigint>")).unionByName(
        heads, allowMissingColumns=True
    )
    both = both.withColumn("_own", F.coalesce("_own", F.lit(False))).repartition(*UNIT)
    schema = {
        "denied": f"_id {row_id_type}",
        "exit": "_key string, _c0 bigint, _chunk bigint, _exit array<bigint>",
    }[emit]
    return both.sortWithinPartitions(*UNIT, "_t", "_id").mapInPandas(fold(limit, period, emit), schema)


def rate_limit(requests, key, t, row_id, limit=params.RATE_LIMIT,
               period=params.RATE_PERIOD_S * SECOND, rows=ROWS_PER_TASK, rounds=None):
    """Requests with ``allowed``: fewer than ``limit`` allowed ones in the last ``period``.

    Denied requests do not count, so a decision depends on earlier decisions. Almost all of
    that chain can be avoided:

    * a request with fewer than ``limit`` arrivals in the last ``period`` is allowed, whatever
      was decided before;
    * the other requests form clusters separated by ``period`` without such requests. Before a
      cluster everything is allowed, so each cluster can be decided on its own;
    * a cluster of a hot key is cut into chunks of a few periods. All chunks are folded from a
      guessed queue. While a chunk's guess differs from what the one before ended with, the
      cluster's chunks are merged in pairs and folded again, so the rounds are at most one more
      than the logarithm of its chunks. The result is exact.

    ``rounds``, a list, gets a number for every round.
    """
    period = int(period)
    base = requests.select(
        user_key(F.col(key)).alias("_key"), F.col(t).alias("_t"), F.col(row_id).alias("_id")
    )
    counted = throttle(base, "_key", "_t", "_id", limit, period, rows)
    marked = counted.select(
        "_key",
        "_t",
        "_id",
        F.floor(F.col("_t") / F.lit(period)).cast("long").alias("_blk"),
        (F.col("arrivals") >= limit).alias("_open"),
    )
    marked = materialise(marked, "requests")

    spans = marked.where("_open").groupBy("_key", "_blk").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last")
    )
    timeline = Window.partitionBy("_key").orderBy("_blk")
    previous = F.lag("_last").over(timeline)
    spans = spans.withColumn(
        "_starts", previous.isNull() | (F.col("_first") - previous >= F.lit(period))
    )
    begun = timeline.rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn(
        "_c0", F.last(F.when(F.col("_starts"), F.col("_first")), ignorenulls=True).over(begun)
    )
    # Chunks are no shorter than a few periods: a wrong guess is forgotten within one.
    length = F.greatest(F.ceil(F.col("_width") / F.lit(period)), F.lit(CHUNK_PERIODS)).cast("long")
    chunk = F.coalesce(F.floor(F.col("_blk") / F.when(F.col("_width") > 0, length)).cast("long"), F.lit(0))
    spans = with_width(spans, "_key", "_t", rows, marked).withColumn("_chunk", chunk)
    inside = spans.select("_key", "_blk", "_c0", "_chunk", F.lit(True).alias("_own"))
    before = spans.where("_starts").select(
        "_key", (F.col("_blk") - 1).alias("_blk"), "_c0", "_chunk", F.lit(False).alias("_own")
    )
    chained = (
        marked.join(inside.unionByName(before), ["_key", "_blk"])
        .where(F.col("_own") | (F.col("_t") > F.col("_c0") - F.lit(period)))
        .select(*UNIT, "_t", "_id", "_own")
    )
    chained = materialise(chained, "contested")
    chained, states = agree(chained, limit, period, rounds)
    kind = requests.schema[row_id].dataType.simpleString()
    denied = folded(chained, states, limit, period, "denied", kind).select(
        F.col("_id").alias(row_id), F.lit(False).alias("allowed")
    )
    return requests.join(denied, row_id, "left").withColumn(
        "allowed", F.coalesce("allowed", F.lit(True))
    )


def agree(rows, limit, period, rounds=None):
    """Rows and the right starting queue of every chunk: fold, compare neighbours, merge in pairs."""
    ordered = Window.partitionBy("_key", "_c0").orderBy("_chunk")
    empty = F.array().cast("array<bigint>")
    states = rows.select(*UNIT).distinct().withColumn("_entry", empty)
    if states.select(F.lag("_chunk").over(ordered).alias("p")).where("p is not null").isEmpty():
        return rows, states
    cluster, done = ["_key", "_c0"], []
    while True:
        exits = folded(rows, states, limit, period, "exit")
        # Only times still inside the period at the first row of the chunk matter.
        starts = rows.groupBy(*UNIT).agg(F.min("_t").alias("_start"))
        handed = F.coalesce(F.lag("_exit").over(ordered), empty)
        linked = states.join(exits, UNIT).withColumn("_handed", handed).join(starts, UNIT)
        linked = linked.withColumn(
            "_handed", F.filter("_handed", lambda x: F.col("_start") - x < F.lit(period))
        )
        linked = materialise(linked, "links")
        if rounds is not None:
            rounds.append(len(rounds) + 1)
        wrong = materialise(linked.where("_handed <> _entry").select(*cluster).distinct(), "wrong")
        done.append((rows.join(wrong, cluster, "left_anti"), linked.join(wrong, cluster, "left_anti")))
        if wrong.isEmpty():
            break
        merged = F.shiftright("_chunk", 1)
        rows = materialise(rows.join(wrong, cluster, "left_semi").withColumn("_chunk", merged), "contested")
        halved = linked.join(wrong, cluster, "left_semi").withColumn("_half", merged)
        halved = halved.groupBy(*cluster, "_half").agg(F.min_by("_handed", "_chunk").alias("_entry"))
        states = materialise(halved.withColumnRenamed("_half", "_chunk").select(*UNIT, "_entry"), "chunks")
    decided, queues = done[0][0], done[0][1].select(*UNIT, "_entry")
    for more, state in done[1:]:
        decided, queues = decided.unionByName(more), queues.unionByName(state.select(*UNIT, "_entry"))
    return decided, queues


def cache_lookup(requests, cached, key, order, row_id, compute, result="result"):
    """Requests with ``hit``, ``computes`` and ``result``.

    Keys are made distinct before the cache is asked. A missing key is computed once, at its
    first request (``computes``), and every request of the key gets that result. A missing part of
    a key is a value like any other, and a stored null is a hit.
    """
    key = list(key)
    wanted = requests.groupBy(*key).agg(F.min_by(row_id, F.struct(*order)).alias("_first"))
    known = cached.select(*key, F.col(result).alias("_known"), F.lit(True).alias("_cached"))
    found = F.coalesce("_cached", F.lit(False))
    looked = null_safe_join(wanted, known, key, "left").select(
        *key,
        "_first",
        found.alias("hit"),
        F.when(found, F.col("_known")).otherwise(compute).alias(result),
    )
    served = null_safe_join(requests, looked, key)
    first = (F.col("_first") == F.col(row_id)) & ~F.col("hit")
    return served.withColumn("computes", first).drop("_first")


def newest_keys(requests, key, t, size=params.CACHE_SIZE):
    """The ``size`` most recently used keys; a top-n, not a one-partition window."""
    used = requests.groupBy(*key).agg(F.max(t).alias("last_used"))
    return used.orderBy(F.desc("last_used"), *key).limit(size)


def latest_state(changes, key, order, state):
    """The newest ``state`` per key."""
    return changes.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))
