"""Exact duplicates through a cuckoo-filter index of live digests.

A text's key is the SHA-256 of its normal form (each run of ASCII white space is one space, null
is empty). An index is a table of shards; a shard holds the stored keys (digest, smallest id, number
of live rows) in buckets and a cuckoo filter over them. A digest the filter has never seen is new
without a look at the keys; a hit is verified against the full digests stored in the bucket. A
filter that overflows is rebuilt at twice the size from the stored keys.

Every task first folds its own rows into a small index of its own and sends its live keys only, so
a text that makes up a third of all rows arrives once per task. Shards are dealt by digest.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import mix, shares
from codeloom.session import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
SLOTS = 4
MAX_KICKS = 200
KEYS_PER_SHARD = 200_000
KEYS_PER_TASK = 100_000  # live keys a task holds before it sends them on
ENTRY = "digest binary, keep_id {id}, group_size bigint"


class Overflow(Exception):
    """The filter found no place for a fingerprint."""


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each has two buckets, one found from the other."""

    def __init__(self, keys):
        need = max(1, int(keys / (SLOTS * 0.9)) + 1)
        self.mask = np.uint64((1 << (need - 1).bit_length()) - 1)
        self.table = np.zeros((int(self.mask) + 1, SLOTS), np.uint16)

    def places(self, hashes):
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = mix(hashes) & self.mask
        return mark, first, self.other(first, mark)

    def other(self, bucket, mark):
        return (bucket ^ mix(mark.astype(np.uint64))) & self.mask

    def contains(self, hashes):
        mark, a, b = self.places(hashes)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def place(self, mark, bucket):
        """Puts fingerprints into free slots of their buckets; gives back those that found none."""
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]
        rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
        for slot in range(SLOTS):  # the r-th newcomer of a bucket takes its r-th free slot
            free = self.table[bucket, slot] == 0
            fits = free & (rank == 0)
            self.table[bucket[fits], slot] = mark[fits]
            rank = np.where(free, rank - 1, rank)
            mark, bucket, rank = mark[~fits], bucket[~fits], rank[~fits]
        return mark, bucket

    def insert(self, hashes):
        """Places all fingerprints at once, pushing out others for at most MAX_KICKS rounds."""
        mark, first, _ = self.places(hashes)
        mark, bucket = self.place(mark, first)
        mark, bucket = self.place(mark, self.other(bucket, mark))
        for turn in range(MAX_KICKS):
            if not len(mark):
                return
            head = np.r_[True, bucket[1:] != bucket[:-1]]  # one newcomer of a bucket pushes at a time
            at, slot = bucket[head], (mark[head].astype(np.int64) + turn) % SLOTS
            out = self.table[at, slot].copy()
            self.table[at, slot] = mark[head]
            mark, bucket = self.place(np.r_[out, mark[~head]], np.r_[self.other(at, out), bucket[~head]])
        if len(mark):
            raise Overflow

    def delete(self, hashes):
        """Takes one copy of each fingerprint out; the caller has verified that each is stored."""
        mark, a, b = self.places(hashes)
        for m, i, j in zip(mark, a, b):
            row = i if (self.table[i] == m).any() else j
            slot = np.flatnonzero(self.table[row] == m)
            if len(slot):
                self.table[row, slot[0]] = 0


def hash_of(digests):
    """First eight bytes of each digest, as the filter's hash."""
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


class LiveIndex:
    """Live digests of one shard: stored keys and the filter that guards them."""

    def __init__(self, room=1024):
        self.keys = {}  # digest -> [smallest id, rows]
        self.filter = CuckooFilter(room)
        self.resizes = 0

    def resize(self):
        room = self.filter.table.size
        while True:
            room *= 2
            self.resizes += 1
            self.filter = CuckooFilter(room)
            try:
                return self.filter.insert(hash_of(list(self.keys)))
            except Overflow:
                continue

    def insert(self, digests, ids, rows):
        """Adds rows; equal digests are folded first."""
        if not len(digests):
            return
        batch = pd.DataFrame({"d": digests, "i": ids, "n": rows})
        batch = batch.groupby("d", sort=False, dropna=False).agg({"i": "min", "n": "sum"})
        digests, fresh = list(batch.index), []
        for digest, i, n, hit in zip(
            digests, batch["i"].tolist(), batch["n"].tolist(), self.filter.contains(hash_of(digests))
        ):
            stored = self.keys.get(digest) if hit else None
            if stored is None:  # new, or another digest with the same fingerprint
                self.keys[digest] = [None if i != i else i, n]
                fresh.append(digest)
            else:
                known = [x for x in (stored[0], None if i != i else i) if x is not None]
                stored[0], stored[1] = min(known, default=None), stored[1] + n
        if fresh:
            try:
                self.filter.insert(hash_of(fresh))
            except Overflow:
                self.resize()

    def delete(self, digests, rows=None):
        """Takes rows out; a digest without rows is no longer live. Unknown digests are ignored."""
        gone = []
        rows = [1] * len(digests) if rows is None else rows
        for digest, n in zip(digests, rows):
            stored = self.keys.get(digest)
            if stored is not None:
                stored[1] -= n
                if stored[1] <= 0:
                    del self.keys[digest]
                    gone.append(digest)
        if gone:
            self.filter.delete(hash_of(gone))

    def lookup(self, digests):
        """Smallest id of each live digest, else None."""
        hits = self.filter.contains(hash_of(digests)) if len(digests) else []
        return [self.keys[d][0] if hit and d in self.keys else None for d, hit in zip(digests, hits)]

    def entries(self, kind):
        ids = pd.Series([v[0] for v in self.keys.values()], dtype="Int64" if kind else object)
        return pd.DataFrame(
            {
                "digest": list(self.keys),
                "keep_id": ids,
                "group_size": np.fromiter((v[1] for v in self.keys.values()), np.int64, len(self.keys)),
            }
        )


def normal(text):
    """Column: null as empty, runs of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(id, digest) of every row."""
    return df.select(
        F.col(key).alias("id"), F.unhex(F.sha2(normal(F.col(text).cast("string")).cast("binary"), 256)).alias("digest")
    )


def _columns(pdf):
    ids = pdf["id" if "id" in pdf else "keep_id"]
    return [bytes(d) for d in pdf["digest"]], ids, pdf["group_size"] if "group_size" in pdf else 1


def build_index(rows: DataFrame, keys_per_shard=KEYS_PER_SHARD) -> DataFrame:
    """Index of a stored table of (id, digest): one row per live digest, of whole bigint ids.

    Columns digest, keep_id (smallest id, null when all are null), group_size.
    """
    schema = ENTRY.format(id=rows.schema["id"].dataType.simpleString())
    kind = "int" in schema.split("keep_id ")[1]
    n = shares(rows, keys_per_shard)

    def fold(batches):
        index = LiveIndex()
        for pdf in batches:
            index.insert(*_columns(pdf))
            if len(index.keys) >= KEYS_PER_TASK:
                yield index.entries(kind)
                index = LiveIndex()
        yield index.entries(kind)

    def merge(pdf):
        index = LiveIndex(min(len(pdf), keys_per_shard))
        index.insert(*_columns(pdf))
        return index.entries(kind)

    shard = F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("shard")
    folded = rows.mapInPandas(fold, schema).withColumn("shard", shard)
    return folded.groupBy("shard").applyInPandas(merge, schema)


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, keys_per_shard=KEYS_PER_SHARD) -> DataFrame:
    """The index after rows (id, digest) came and went.

    A removed row takes one from its digest's rows and digests without rows leave the index; the
    smallest id stays as recorded while the digest lives. Removing an unknown digest changes nothing.
    """
    schema = index.schema
    n = shares(index, keys_per_shard)
    came = added.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    went = removed.groupBy("digest").agg((-F.count("*")).alias("group_size"))
    both = index.unionByName(came).unionByName(went, allowMissingColumns=True)
    kind = "int" in index.schema["keep_id"].dataType.simpleString()

    def merge(pdf):
        live = LiveIndex(min(len(pdf), keys_per_shard))
        out = pdf["group_size"] < 0
        live.insert(*_columns(pdf[~out]))
        live.delete([bytes(d) for d in pdf["digest"][out]], (-pdf["group_size"][out]).tolist())
        return live.entries(kind)

    return both.groupBy(F.pmod(F.xxhash64("digest"), F.lit(n)).alias("shard")).applyInPandas(merge, schema)


def exact_duplicates(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row of ``df``.

    The row with the smallest id of equal texts is kept. Null and empty texts are equal. Rows without
    an id join their group, and keep_id is null only if no row of the group has an id; they are kept
    only then. Repeated rows with the kept id are all reported as kept.
    """
    rows = materialise(digests(df, key, text), "digests")
    index = build_index(rows)
    return rows.join(index, "digest").select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
