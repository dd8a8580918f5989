"""Building blocks that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialise

ROWS_PER_TASK = 1000000  # a key with more rows than this is shared out over several tasks
SENT_ROWS = 100000  # longest list of hot keys sent to every task; a longer one is joined by shuffle


def sent_if_short(df: DataFrame, rows=SENT_ROWS) -> DataFrame:
    """A stored table, marked for broadcast after its rows are counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(df: DataFrame, keys, rows=ROWS_PER_TASK, *extra) -> DataFrame:
    """(keys, ``_n``, extra): the keys with more than ``rows`` rows and over how many tasks.

    Counts are combined per task before the shuffle. The list is stored.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_count"), *extra).where(F.col("_count") > rows)
    return materialise(counted.withColumn("_n", F.ceil(F.col("_count") / F.lit(rows))).drop("_count"), "hot-keys")


def same(left, right, keys):
    """Equality of the keys of two aliased tables; a missing key equals a missing one."""
    match = F.lit(True)
    for key in keys:
        match = match & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return match


def null_safe_join(fact: DataFrame, lookup: DataFrame, keys, how="inner") -> DataFrame:
    """Join in which a missing key is a key like any other; the fact's key columns stay."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    added = [F.col(f"r.{c}") for c in lookup.columns if c not in keys]
    return fact.alias("l").join(lookup.alias("r"), same("l", "r", keys), how).select("l.*", *added)


def with_width(df: DataFrame, key, t, rows=ROWS_PER_TASK, of=None) -> DataFrame:
    """Add ``_width``: the length of the time slices a hot key is cut into, else null.

    Keys are counted in ``of`` (default ``df``), which should be stored; a missing key is a key like
    any other.
    """
    of = df if of is None else of
    span = (F.max(t) - F.min(t) + 1).alias("_span")
    width = F.greatest(F.ceil(F.col("_span") / F.col("_n")), F.lit(1)).cast("long").alias("_width")
    hot = sent_if_short(hot_keys(of, [key], rows, span)).select(key, width)
    return null_safe_join(df, hot, key, "left")


def slice_number(t, width="_width"):
    """Slice of a time; all times of a key that is not hot are in slice 0."""
    return F.coalesce(F.floor(t / F.col(width)).cast("long"), F.lit(0))


def last_before(events: DataFrame, key, t, order, value, alias, rows=ROWS_PER_TASK) -> DataFrame:
    """Add ``alias``: the newest non-null ``value`` of the same key strictly before the row.

    Rows are ordered by (``t``, ``order``). A key is one window partition, a hot key one per time
    slice. What a slice needs from earlier ones is carried in as one extra row, taken from a
    per-slice summary, that stands before all others of the slice. The input is stored, so
    counting its keys does not compute it again.
    """
    cut = with_width(materialise(events, "events"), key, t, rows).withColumn("_blk", slice_number(F.col(t)))
    stamp = F.when(F.col(value).isNotNull(), F.struct(t, order))
    summary = cut.where("_width is not null").groupBy(key, "_blk").agg(
        F.max_by(value, stamp).alias("_v")
    )
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        key,
        "_blk",
        F.last("_v", ignorenulls=True).over(earlier).alias(value),
        F.lit(True).alias("_carry"),
    ).where(F.col(value).isNotNull())
    both = (
        cut.drop("_width")
        .withColumn("_carry", F.lit(False))
        .unionByName(carry, allowMissingColumns=True)
    )
    within = (
        Window.partitionBy(key, "_blk")
        .orderBy(F.desc("_carry"), t, order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        both.withColumn(alias, F.last(value, ignorenulls=True).over(within))
        .where(~F.col("_carry"))
        .drop("_blk", "_carry")
    )
