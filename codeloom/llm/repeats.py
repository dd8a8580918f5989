"""Repeated substrings, by blockwise suffix sorting with a difference cover.

Removes every byte that lies in a string of WIDTH bytes that also starts somewhere else. Suffixes
are dealt into buckets by the content of their first WIDTH bytes: the k-gram in them with the
smallest hash names the bucket, so equal strings meet whatever stands before them. Neighbouring
suffixes with the same smallest k-gram travel as one run. A bucket with one run holds nothing
repeated, and a run whose whole content occurs twice is repeated throughout; only buckets with
different contents are sorted, a bounded block of buckets at a time. A block's suffixes are ordered by
their first and last bytes; long ties are resolved by ranks computed beforehand for the cover sample,
the positions p with p mod 7 in {0, 1, 3}: for any two suffixes a shift below 7 brings both to
sample positions.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import mix, shares, text_batches, worker_state
from codeloom.session import materialise

WIDTH, GRAM = 200, 64
CHUNK = 1 << 19  # bytes hashed at once
ROWS_PER_BLOCK = 20_000
BUCKET_ROWS = 50_000  # most contents of a bucket that one task sorts
PERIOD, COVER = 7, (0, 1, 3)  # every difference mod 7 is a difference of two members
BASE = 0xD6E8FEB86659FD93
BYTE_VALUE = np.random.default_rng(4).integers(0, 1 << 63, 256, dtype=np.uint64)


def powers():
    """BASE^i and its inverses, modulo 2^64; computed once in a worker."""
    known = worker_state()
    if "powers" not in known:
        up = np.full(CHUNK + 1, BASE, np.uint64)
        down = np.full(CHUNK + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known["powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return known["powers"]


def slide(keys, width):
    """Smallest of each ``width`` neighbouring keys."""
    n = len(keys)
    pad = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = keys
    rows = pad.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data, width=WIDTH, gram=GRAM):
    """(bucket, content, start, length) of the runs of window starts in a byte string."""
    data = np.frombuffer(data, np.uint8)
    up, down = powers()
    found = []
    for first in range(0, max(len(data) - width + 1, 0), CHUNK - width + 1):
        part = data[first : first + CHUNK]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * up[: len(part)], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[: len(part) - gram + 1])
        place = np.arange(len(grams), dtype=np.uint64)
        low = slide((grams & np.uint64(0xFFFFFFFFFFF00000)) | place, width - gram + 1)
        start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        length = np.diff(np.r_[start, len(low)])
        bucket = grams[(low[start] & np.uint64(0xFFFFF)).astype(np.int64)]
        end = start + length + width - 1
        content = mix((total[end] - total[start]) * down[start] + length.astype(np.uint64))
        found.append((bucket.view(np.int64), content.view(np.int64), start + first, length))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(c).astype(np.int64) for c in zip(*found)]


def dense(*keys):
    """Rank of each row of parallel key arrays, equal rows alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def words_at(text, places):
    """Eight bytes from each place, as one big-endian number."""
    window = np.lib.stride_tricks.sliding_window_view(text, 8)[places]
    return np.ascontiguousarray(window).view(">u8")[:, 0].astype(np.uint64)


def cover_ranks(text, depth):
    """Rank of the ``depth`` bytes from each cover position, by doubling; -1 elsewhere."""
    place = np.arange(len(text) - max(depth, 8) + 1)
    place = place[np.isin(place % PERIOD, COVER)]
    rank = np.full(len(text), -1, np.int64)
    known = PERIOD  # the top seven of eight bytes
    rank[place] = dense(words_at(text, place) >> np.uint64(8))
    while known < depth:  # steps by multiples of the period lead to cover positions again
        after = min(2 * known, depth)
        rank[place] = dense(rank[place], rank[place + after - known])
        known = after
    return rank


def repeated_starts(contents, width=WIDTH):
    """For byte strings of at least ``width`` bytes, which of their windows occur more than once."""
    length = np.array([len(c) for c in contents])
    count = length - width + 1
    text = np.frombuffer(b"".join(contents) + bytes(width + 16), np.uint8)
    offset = np.cumsum(length) - length
    place = np.repeat(offset - (np.cumsum(count) - count), count) + np.arange(count.sum())
    depth = -(-(width - 16) // PERIOD) * PERIOD  # with up to 6 bytes before it, it reaches the last 16 bytes
    tie = dense(words_at(text, place), words_at(text, place + width - 16), words_at(text, place + width - 8))
    seen = np.bincount(tie)[tie] > 1
    again = np.zeros(len(place), bool)
    if seen.any():
        rank = cover_ranks(text, depth)
        for shift in range(PERIOD):
            sure = np.flatnonzero(seen & np.isin((place + shift) % PERIOD, COVER))
            if len(sure):
                group = dense(tie[sure], rank[place[sure] + shift])
                again[sure] |= np.bincount(group)[group] > 1
    return np.split(again, np.cumsum(count)[:-1])


def covered(spans, size):
    """Merged (from, to) of byte spans; touching ones are one."""
    merged = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(lo, min(hi, size)) for lo, hi in merged]


def cut_spans(data, spans):
    """Bytes that stay when (from, to) spans go."""
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


def run_table(rows: DataFrame, width, gram) -> DataFrame:
    """(t1, t2, id, n, sha, bucket, content, start, length): runs and digest of each text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                own = batch.slice(first, 256)
                n, sha, columns = [], [], [[], [], [], []]
                for value in own.column(3).to_pylist():
                    data = (value or "").encode()
                    n.append(len(data))
                    sha.append(hashlib.sha256(data).hexdigest())
                    for column, found in zip(columns, runs(data, width, gram)):
                        column.append(found)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                lists = [pa.array(c, pa.list_(t)) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:3], pa.array(n, pa.int64()), pa.array(sha), *lists],
                    ["t1", "t2", "id", "n", "sha", "bucket", "content", "start", "length"],
                )

    lists = "bucket array<bigint>, content array<bigint>, start array<int>, length array<int>"
    return rows.mapInArrow(run, f"t1 bigint, t2 bigint, id {kind}, n bigint, sha string, {lists}")


def sorted_blocks(mixed: DataFrame, width) -> DataFrame:
    """(t1, t2, spans) of contents that occur once: where their repeated windows lie.

    ``mixed`` has t1, t2, bucket, start, single and content, a byte string; buckets are sorted one
    block at a time.
    """
    n = shares(mixed, ROWS_PER_BLOCK)

    def run(table):
        table = table.take(pc.sort_indices(table, [("bucket", "ascending")])).combine_chunks()
        bucket, start = table.column("bucket").to_numpy(), table.column("start").to_numpy()
        t1, t2 = table.column("t1").to_numpy(), table.column("t2").to_numpy()
        single, edge = table.column("single").to_pylist(), np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        out = []
        block, held = [], 0
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
            block.extend(range(lo, hi))
            held += hi - lo
            if held < ROWS_PER_BLOCK // 4 and hi < len(bucket):
                continue
            contents = [table.column("content")[i].as_py() for i in block]
            for i, again in zip(block, repeated_starts(contents, width)):
                if single[i] and again.any():
                    at = np.flatnonzero(np.diff(np.r_[False, again, False].astype(np.int8)))
                    spans = [(int(start[i] + a), int(start[i] + b - 1 + width)) for a, b in zip(at[::2], at[1::2])]
                    out.extend((int(t1[i]), int(t2[i]), lo, hi) for lo, hi in spans)
            block, held = [], 0
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("t1", "t2", "lo", "hi"), columns, kinds)})

    shard = F.pmod(F.xxhash64("bucket"), F.lit(n))
    return mixed.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "t1 bigint, t2 bigint, lo int, hi int")


def single_windows(rows: DataFrame, width) -> DataFrame:
    """(t1, t2, lo, hi) of the repeated windows of contents of very large buckets.

    Each window is a row with a 128-bit digest; counts are combined before the shuffle, so no task
    holds a bucket.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = row["content"]
                marks = [hashlib.blake2b(data[i : i + width], digest_size=16).digest() for i in range(len(data) - width + 1)]
                pairs = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
                size = len(pairs)
                columns = [pairs[:, 0].copy(), pairs[:, 1].copy(), np.full(size, row["t1"]), np.full(size, row["t2"])]
                columns += [np.arange(size, dtype=np.int32) + np.int32(row["start"]), np.full(size, row["single"])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["f1", "f2", "t1", "t2", "lo", "single"])

    schema = "f1 bigint, f2 bigint, t1 bigint, t2 bigint, lo int, single boolean"
    windows = materialise(rows.select("t1", "t2", "start", "single", "content").mapInArrow(run, schema), "windows")
    again = windows.groupBy("f1", "f2").agg(F.count("*").alias("times")).where("times > 1").select("f1", "f2")
    found = windows.where("single").join(again, ["f1", "f2"], "left_semi")
    return found.select("t1", "t2", "lo", (F.col("lo") + width).alias("hi"))


def contents(parts: DataFrame) -> DataFrame:
    """One row per wanted run of a text, with its bytes; ``wanted`` lists bucket, start, size, single."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                own = batch.slice(first, 64).to_pydict()
                rows = []
                for t1, t2, text, wanted in zip(own["t1"], own["t2"], own["text"], own["wanted"]):
                    data = text.encode()
                    for w in wanted:
                        piece = data[w["start"] : w["start"] + w["size"]]
                        rows.append((t1, t2, w["bucket"], w["start"], w["single"], piece))
                columns = list(zip(*rows)) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["t1", "t2", "bucket", "start", "single", "content"]
                )

    schema = "t1 bigint, t2 bigint, bucket bigint, start int, single boolean, content binary"
    return parts.select("t1", "t2", "text", "wanted").mapInArrow(run, schema)


def repeats(df: DataFrame, key="doc_id", text="text", width=WIDTH, gram=GRAM, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``df``.

    Bytes are those of the text in UTF-8; null counts as empty. ``spans`` are the removed (lo, hi).
    Strings are judged on the input and never cross texts; they may overlap each other and lie in
    one text. A bucket of more than ``bucket_rows`` different contents is not sorted in one task but
    compared window by window. A row that repeats another one is a text like any other, so all its strings of
    ``width`` bytes are repeated. Rows without an id are texts too.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    named = [F.xxhash64(F.col("id").cast("string")).alias("t1"), F.xxhash64("text").alias("t2")]
    rows = rows.select(*named, "id", "text")
    table = materialise(run_table(rows, width, gram), "runs")
    flat = table.select("t1", "t2", F.inline_outer(F.arrays_zip("bucket", "content", "start", "length")))
    flat = flat.where("bucket is not null")
    same = flat.groupBy("bucket").agg(F.min("content").alias("c1"), F.max("content").alias("c2"), F.count("*").alias("times"))
    same = materialise(same.where("times > 1").selectExpr("bucket", "c1 <> c2 as mixed"), "buckets")
    shared = materialise(flat.join(same, "bucket"), "shared")  # apart, so a hot bucket can be split
    place = F.struct("t1", "t2", "start", "length")
    kinds = shared.where("mixed").groupBy("bucket", "content").agg(F.count("*").alias("times"), F.min(place).alias("p"))
    kinds = materialise(kinds, "kinds")
    many = kinds.where("times > 1").select("bucket", "content")
    whole = shared.where("not mixed").select("t1", "t2", "start", "length")
    whole = whole.union(shared.where("mixed").join(many, ["bucket", "content"]).select("t1", "t2", "start", "length"))
    whole = whole.select("t1", "t2", F.col("start").alias("lo"), (F.col("start") + F.col("length") + width - 1).alias("hi"))
    wanted = F.struct("bucket", "p.start", (F.col("p.length") + width - 1).alias("size"), (F.col("times") == 1).alias("single"))
    asked = kinds.groupBy("p.t1", "p.t2").agg(F.collect_list(wanted).alias("wanted"))
    spans = whole.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    known = materialise(asked.join(spans, ["t1", "t2"], "full"), "asked")
    parts = materialise(rows.join(known, ["t1", "t2"]), "parts")
    large = kinds.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > bucket_rows)
    pieces = materialise(contents(parts.where("wanted is not null")), "contents")
    found = sorted_blocks(materialise(pieces.join(large, "bucket", "left_anti"), "blocks"), width)
    found = found.union(single_windows(pieces.join(large, "bucket", "left_semi"), width))
    found = found.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("more"))
    joined = parts.select("t1", "t2", "text", "spans").join(found, ["t1", "t2"], "left")

    def finish(batches):
        for batch in batches:
            own = batch.to_pydict()
            out = []
            for t1, t2, value, a, b in zip(*(own[c] for c in ("t1", "t2", "text", "spans", "more"))):
                data = value.encode()
                cuts = covered({(s["lo"], s["hi"]) for s in [*(a or []), *(b or [])]}, len(data))
                digest = hashlib.sha256(cut_spans(data, cuts)).hexdigest()
                out.append((t1, t2, sum(hi - lo for lo, hi in cuts), len(cuts), digest, [{"lo": x, "hi": y} for x, y in cuts]))
            columns = list(zip(*out)) or [[]] * 6
            pair = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pair]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["t1", "t2", "n_removed", "n_spans", "kept", "spans"]
            )

    schema = "t1 bigint, t2 bigint, n_removed bigint, n_spans bigint, kept string, spans array<struct<lo: int, hi: int>>"
    done = joined.mapInArrow(finish, schema).dropDuplicates(["t1", "t2"])
    result = table.select("t1", "t2", "id", "n", "sha").join(done, ["t1", "t2"], "left")
    return result.select(
        "id",
        F.col("n").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<lo: int, hi: int>>")).alias("spans"),
    )
