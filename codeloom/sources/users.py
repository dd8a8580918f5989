"""The user table kept between jobs: bucketed by name, so that jobs read only what they ask for."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UserTable:
    """Users in a folder, in buckets by ``username``; one row per name.

    The folder outlives the job; the table is declared anew in each session. Looking up names reads
    the buckets of these names. The anti join of a registration and the joins of ``with_users`` leave
    the stored side where it is: only the other side is shuffled, into as many parts as buckets.
    """

    def __init__(self, spark: SparkSession, name, path, schema="username string, secret_digest string, permissions array<string>", buckets=16):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.columns = spark.createDataFrame([], schema).columns
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet "
            f"CLUSTERED BY (username) SORTED BY (username) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(f"`{self.name}`")

    def lookup(self, usernames) -> DataFrame:
        """The rows of a few names; other buckets are not read."""
        return self.rows().where(F.col("username").isin(list(usernames)))

    def asked(self, df: DataFrame) -> DataFrame:
        """Rows dealt like the buckets."""
        return df.repartition(self.buckets, "username")

    def attempts(self, attempts: DataFrame, order=("ts", "event_id"), row_id="event_id") -> DataFrame:
        """Registration attempts with ``created``: true for the first attempt of a name that is not stored.

        A name that is tried very often is reduced to its first attempt before it meets the table; an
        attempt without a name creates nothing. Attempt ids are unique.
        """
        first = attempts.where(F.col("username").isNotNull()).groupBy("username").agg(F.min_by(row_id, F.struct(*order)).alias(row_id))
        new = self.asked(first).join(self.rows().select("username").hint("merge"), "username", "left_anti")
        flags = new.select(row_id, F.lit(True).alias("created"))
        return attempts.join(flags, row_id, "left").withColumn("created", F.coalesce("created", F.lit(False)))

    def add(self, created: DataFrame):
        """Appends the rows of accepted attempts, into the buckets of their names."""
        self.asked(created.where("created").select(*self.columns)).write.insertInto(self.name)

    def with_users(self, df: DataFrame, *columns) -> DataFrame:
        """Rows with columns of their user; nulls for unknown ones."""
        return self.asked(df).join(self.rows().select("username", *columns).hint("merge"), "username", "left")
