"""Tables that micro-batches write: keyed tables, versions of a model, results per epoch.

A batch that is run again after a failure overwrites what its epoch wrote, so nothing is applied twice.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def folders(spark, path):
    """Names of the finished folders below a path (those with a success mark), newest epoch last."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    done = [p.getName() for p in found if p.getName().partition("=")[2].isdigit() and fs.exists(mark(p, "_SUCCESS"))]
    return sorted(done, key=lambda name: int(name.partition("=")[2]))


class KeyedTable:
    """One row per key, kept up by micro-batches: the row with the largest ``order`` wins.

    Keys are dealt into buckets by hash. A merge reads and rewrites the buckets that its batch touches, under
    the batch's epoch; what holds is each bucket's newest finished epoch. The epoch before stays, so a
    batch that is run again starts from what it started from at first; older ones are removed.
    """

    def __init__(self, spark, path, schema, keys, order, buckets=16):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, list(keys), list(order), buckets
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema

    def versions(self, before=None):
        """bucket -> its epochs, oldest first."""
        found = {}
        for name in folders(self.spark, self.path):
            epoch = int(name.partition("=")[2])
            if before is None or epoch < before:
                root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                for status in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
                    if status.getPath().getName().startswith("bucket="):
                        found.setdefault(int(status.getPath().getName()[7:]), []).append(epoch)
        return found

    def read(self, before=None, buckets=None):
        """Rows as of the newest epoch (before one), of some buckets only if asked."""
        held = self.versions(before)
        wanted = [b for b in held if buckets is None or b in buckets]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/epoch={held[b][-1]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def newest(self, rows):
        others = [c for c in self.schema.names if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(*self.order)).alias("_row"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}") for c in self.schema.names])

    def merge(self, batch, epoch):
        """Applies a batch; the same batch under the same epoch again changes nothing."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.schema.names).persist()
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # at most one number per bucket
        if touched:
            whole = self.newest(self.read(epoch, touched).unionByName(self.newest(rows))).withColumn("bucket", bucket)
            whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}")
            self.clean()
        rows.unpersist()

    def clean(self):
        """Removes epochs of which no bucket is among its two newest ones."""
        kept = {e for epochs in self.versions().values() for e in epochs[-2:]}
        for name in folders(self.spark, self.path):
            if int(name.partition("=")[2]) not in kept:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Versions:
    """Versions of a model in one folder; the newest finished one is loaded, once per version."""

    def __init__(self, spark, path, load):
        self.spark, self.path, self.load, self.held = spark, path, load, (None, None)

    def publish(self, model):
        """Stores the next version and gives its number."""
        found = folders(self.spark, self.path)
        number = int(found[-1].partition("=")[2]) + 1 if found else 1
        model.save(f"{self.path}/version={number}")
        return number

    def newest(self):
        """(number, model)."""
        name = folders(self.spark, self.path)[-1]
        if self.held[0] != name:
            self.held = name, self.load(self.spark, f"{self.path}/{name}")
        return int(name.partition("=")[2]), self.held[1]


def per_epoch(spark, path, schema):
    """All rows that finished epochs have written below a path."""
    paths = [f"{path}/{name}" for name in folders(spark, path)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
