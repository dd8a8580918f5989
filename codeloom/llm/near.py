"""Near-duplicate texts: MinHash bands, sequential Bayesian pruning, exact check, components.

A text's set is its distinct word shingles. 48 bands of 6 minima of 8 bits are kept (see Bands); texts
that agree on a whole band are candidates. At similarity 0.8 a pair shares no band with a probability of
(1 - 0.8^6)^48, about 5e-7. The bands of a candidate pair are compared 48 minima at a time; the
pair is dropped once the posterior probability of reaching the threshold is below MISS, and what is
left is checked on the full sets.

Nothing is expanded into pairs of a group. Texts with equal sets are one node. A band's bucket first
compares all members with its smallest id, then those outside the found component with another
member; what still has members of different components is compared block by block inside tasks,
and only links leave them. A pair in one component needs no further look.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WordHashes, shares, shingle_set, text_batches, texts
from codeloom.llm.components import components
from codeloom.session import materialise

MISS = 1e-6
BLOCK = 2048  # members of a bucket compared at once
ROWS_PER_SHARD = 4_000
HELD = 4_000_000  # shingles a task remembers
CHUNK = 512


class Bands:
    """Number of bands, minima in each, minima per step of the sequential test, bytes of a minimum.

    A band key holds a band's minima in its low six bytes, and the band's number above.
    """

    def __init__(self, bands=48, rows=6, batch=48, octets=1):
        self.bands, self.rows, self.batch, self.octets = bands, rows, batch, octets
        self.kind = np.dtype(f"<u{octets}")
        draw = np.random.default_rng(20)
        self.factor = (draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.flip = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]

    def short(self, low):
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - 8 * self.octets)).astype(self.kind)

    def packed(self, sets):
        return np.zeros((sets, self.bands, 8 // self.octets), self.kind)

    def numbered(self, packed):
        return packed.view("<u8")[:, :, 0].astype(np.int64) | (np.arange(self.bands, dtype=np.int64) << 48)

    def keys(self, items):
        """Band keys of a sorted set of hashes."""
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        x = (items >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(x), CHUNK):
            np.minimum(low, ((x[None, start : start + CHUNK] ^ self.flip) * self.factor).min(1), out=low)
        packed = self.packed(1)
        packed[0, :, : self.rows] = self.short(low).reshape(self.bands, -1)
        return self.numbered(packed)[0]

    def keys_of_groups(self, items, starts):
        """Band keys (groups, bands) of many sets of hashes that follow one another."""
        x = (items >> np.uint64(32)).astype(np.uint32)
        low = np.empty((self.bands * self.rows, len(starts)), np.uint32)
        for i in range(self.bands * self.rows):
            np.minimum.reduceat((x ^ self.flip[i]) * self.factor[i], starts, out=low[i])
        packed = self.packed(len(starts))
        packed[:, :, : self.rows] = self.short(low).T.reshape(len(starts), self.bands, self.rows)
        return self.numbered(packed)

    def minima(self, keys):
        """The minima of an array (n, bands) of band keys."""
        parts = np.ascontiguousarray(keys.astype("<i8")).view(self.kind)
        return parts.reshape(len(keys), self.bands, -1)[:, :, : self.rows].reshape(len(keys), -1)


def least_matches(percent, scheme, miss=MISS):
    """For each step, the fewest equal minima with which a pair may still reach the threshold.

    Prior: similarity uniform on [0, 1]; a minimum of 8 bits agrees with probability s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256**scheme.octets
    least = []
    for n in range(scheme.batch, scheme.bands * scheme.rows + 1, scheme.batch):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(like - like.max(1, keepdims=True))
        chance = like[:, s >= percent / 100].sum(1) / like.sum(1)
        least.append(int(np.argmax(chance >= miss)))
    return least


def may_link(a, b, least, batch):
    """Which row pairs of two arrays of minima survive all steps."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, fewest in enumerate(least):
        part = slice(step * batch, (step + 1) * batch)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= fewest]
    return alive


def linked(a, b, percent):
    """Whether two sorted sets reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(items: DataFrame, words, scheme, keep_text=False) -> DataFrame:
    """(id, n, f1, f2, bands): size and 128-bit fingerprint of the set, and its band keys."""
    kind = items.schema["id"].dataType.simpleString()
    kept = ["text"] if keep_text else []

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for value in batch.column(1):
                own = shingle_set(value.as_py(), words, cache)
                mark = xxhash.xxh3_128_intdigest(own.tobytes())
                n.append(len(own))
                f1.append((mark >> 64) - (1 << 63))
                f2.append((mark & ((1 << 64) - 1)) - (1 << 63))
                bands.append(scheme.keys(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), *([batch.column(1)] if kept else [])],
                ["id", "n", "f1", "f2", "bands", *kept],
            )

    schema = f"id {kind}, n bigint, f1 bigint, f2 bigint, bands array<bigint>" + ", text string" * keep_text
    return items.select("id", "text").mapInArrow(run, schema)


def verify(pairs: DataFrame, found: DataFrame, words, percent, scheme) -> DataFrame:
    """The pairs (a, b) that survive the sequential test and reach the similarity on full sets."""
    kind = found.schema["id"].dataType.simpleString()
    side = lambda c: found.select(F.col("id").alias(c), F.col("bands").alias(f"bands_{c}"), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "bands_a", "bands_b", "text_a", "text_b")
    least = least_matches(percent, scheme)

    def run(batches):
        cache, sets = WordHashes(), {}

        def set_of(key, value):
            if key not in sets:
                if len(sets) >= 64:
                    del sets[next(iter(sets))]
                sets[key] = shingle_set(value, words, cache)
            return sets[key]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).flatten().to_numpy().reshape(-1, scheme.bands) for i in (2, 3)]
            hits = []
            for i in may_link(scheme.minima(keys[0]), scheme.minima(keys[1]), least, scheme.batch).tolist():
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own = set_of(a, batch.column(4)[i].as_py())
                if linked(own, shingle_set(batch.column(5)[i].as_py(), words, cache), percent):
                    hits.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hits, pa.int64())), batch.column(1).take(pa.array(hits, pa.int64()))], ["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def labelled(members, labels):
    """Members (key, id) with the component found so far as label, of buckets that hold several."""
    named = members.select("key", "id").join(labels, "id", "left")
    named = named.select("key", "id", F.coalesce("component", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    return materialise(named.join(mixed.where("lo <> hi").select("key", "n"), "key"), "mixed")


def in_blocks(mixed, found, words, percent, scheme) -> DataFrame:
    """Links (a, b) of different label among the members of a bucket.

    A bucket is cut into blocks; a group compares two of them, a pair only in the first band that
    its texts share. Pairs that survive the sequential test are checked on the spot, so a task
    gives out links only, however many members are almost similar enough.
    """
    kind = found.schema["id"].dataType.simpleString()
    least = least_matches(percent, scheme)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = mixed.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", "id", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(found, "id")
    dealt = mixed.agg(F.sum(blocks)).first()[0] or 0  # a member stands in a group with every block of its bucket
    n = max(1, math.ceil(dealt / ROWS_PER_SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n)))

    def compare(keys, band, label, own, same):
        """Index pairs of one group that survive the sequential test."""
        first = np.arange(len(keys)) if same else np.flatnonzero(own == own.min())
        low = scheme.minima(keys)
        for x in first.tolist():
            rest = np.arange(x + 1, len(keys)) if same else np.flatnonzero(own != own[x])
            rest = rest[label[rest] != label[x]]
            if len(rest):
                shared = (keys[rest] == keys[x]).argmax(1)
                rest = rest[shared == band]
                for y in rest[may_link(np.broadcast_to(low[x], (len(rest), low.shape[1])), low[rest], least, scheme.batch)].tolist():
                    yield x, y

    def run(table):
        cache, sets, held = WordHashes(), {}, 0
        order = [("key", "ascending"), ("i", "ascending"), ("j", "ascending")]
        table = table.take(pc.sort_indices(table, order)).combine_chunks()
        number = lambda c: table.column(c).to_numpy()
        key, i, j, own = number("key"), number("i"), number("j"), number("own")
        label = table.column("label").dictionary_encode().combine_chunks().indices.to_numpy()
        ids = table.column("id").combine_chunks()
        node = ids.dictionary_encode().indices.to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, scheme.bands)
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        a, b = [], []

        def set_of(row):
            nonlocal held
            if node[row] not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[node[row]] = shingle_set(table.column("text")[row].as_py(), words, cache)
                held += len(sets[node[row]])
            return sets[node[row]]

        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            for x, y in compare(bands[lo:hi], int(key[lo] >> 48), label[lo:hi], own[lo:hi], i[lo] == j[lo]):
                if linked(set_of(lo + x), set_of(lo + y), percent):
                    a.append(lo + x)
                    b.append(lo + y)
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return rows.groupBy("shard").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, key="doc_id", text="text", words=5, percent=80, scheme=None) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased. Texts are linked when
    100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable. A text without words has no shingles and only its own id; so has a row without an id
    (null). Rows that repeat an id are separate texts; each gets the component of its own text.
    """
    text_batches(df.sparkSession)
    items, scheme = texts(df, key, text), scheme or Bands()
    marks = materialise(signatures(items, words, scheme), "signatures")
    bands = marks.where("n > 0 and id is not null").select("id", "bands")
    return near_groups(marks.drop("bands"), bands, lambda ids: items.join(ids, "id", "left_semi"), words, percent, scheme)


def near_groups(marks, bands, texts_of, words, percent, scheme, sign=None) -> DataFrame:
    """(id, n_shingles, component_id) from stored marks (id, n, f1, f2) and band keys (id, bands).

    ``texts_of`` gives (id, text) for a table of ids; it is asked for candidates only. ``sign`` turns that into
    (id, bands, text), with the same band keys; without it they are those of ``signatures``.
    """
    sets = marks.where("n > 0 and id is not null")
    first = materialise(sets.groupBy("f1", "f2").agg(F.min("id").alias("rep")), "sets")
    nodes = bands.join(first.select(F.col("rep").alias("id")), "id", "left_semi")
    members = nodes.select("id", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
    members = materialise(members.join(shared.where("leader <> last"), "key").select("key", "id", "leader"), "members")
    wanted = members.select("id").distinct()
    sign = sign or (lambda items: signatures(items, words, scheme, keep_text=True).where("n > 0"))
    found = materialise(sign(texts_of(wanted)).select("id", "bands", "text"), "candidates")

    def check(pairs):
        return materialise(verify(pairs, found, words, percent, scheme), "edges")

    led = materialise(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    edges = check(led)
    mixed = labelled(members, components(edges))
    chosen = mixed.groupBy("key").agg(F.min_by(F.struct("id", "label"), F.xxhash64("key", "id")).alias("c"))
    second = mixed.join(chosen, "key").where("label <> c.label and id <> c.id")
    second = second.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
    second = materialise(second.join(led, ["a", "b"], "left_anti"), "pairs")
    edges = edges.union(check(second))
    mixed = labelled(mixed, components(edges))
    edges = edges.union(materialise(in_blocks(mixed, found, words, percent, scheme), "edges"))
    linked_to = components(edges)
    whole = marks.join(first, ["f1", "f2"], "left").join(linked_to.withColumnRenamed("id", "rep"), "rep", "left")
    return whole.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id")).alias("component_id"))
