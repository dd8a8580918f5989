"""Word and shingle hashing shared by the near-duplicate operators, and small table helpers."""

import math
import sys
import types

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 1 << 18  # words remembered by one Python worker
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def worker_state():
    """A dict of this Python worker that outlives its tasks; functions come anew with each task."""
    return sys.modules.setdefault("_codeloom_state", types.ModuleType("_codeloom_state")).__dict__


def mix(x):
    """Spreads 64-bit values evenly (in numpy, wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text, cache):
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; None has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(hashes, size):
    """Hashes of all runs of ``size`` words, in order; with fewer words one run of all of them."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * STEP + hashes[i : i + n])
    return out


def shingle_set(text, size, cache):
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(word_hashes(text, cache), size))


def text_batches(spark, rows=2000, size=8 << 20):
    """Bounds what the JVM and a Python worker hold of texts at once: Arrow batches by rows and bytes.

    A setting of the session, which the operators on texts need; smaller values are left alone.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        own = spark.conf.get(name, None)
        if own is None or not 0 < int(own.rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def shares(df: DataFrame, rows: int) -> int:
    """Number of parts of about ``rows`` rows; ``df`` should be a stored table."""
    return max(1, math.ceil(df.count() / rows))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, with underscores after it if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of any table, whatever else it holds."""
    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))


def sent_if_small(df: DataFrame, rows=200_000) -> DataFrame:
    """A stored table, marked for broadcast if it has at most ``rows`` (short) rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
