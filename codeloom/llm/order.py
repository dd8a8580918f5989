"""Running sums over a total order of any size, without one task that sees all rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import shares
from codeloom.session import materialise

ROWS_PER_PART = 200_000


def running(df: DataFrame, order, **sums) -> DataFrame:
    """Adds a column per name: the sum of that expression over all rows that come earlier; stored.

    ``order`` names columns (or gives sort columns). Rows are dealt into ranges of the order; only one
    row per range passes a single task. Rows equal in ``order`` stand next to one another, in any
    order. Needs no column named ``_part``, ``_whole`` or ``_earlier_...``.
    """
    stored = materialise(df.withColumns({f"_{k}": v for k, v in sums.items()}), "unordered")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shares(stored, ROWS_PER_PART), min(shares(stored, ROWS_PER_PART // 50), least))
    cut = materialise(stored.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_earlier_{k}") for k in sums])
    whole = whole.select(
        "_part", *[F.coalesce(F.sum(f"_earlier_{k}").over(earlier), F.lit(0)).alias(f"_earlier_{k}") for k in sums]
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumns({f"_{k}": F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in sums})
    added = [(F.col(f"_{k}") + F.col(f"_earlier_{k}")).cast("bigint").alias(k) for k in sums]
    return materialise(placed.join(whole, "_part").select(*df.columns, *added), "ordered")
