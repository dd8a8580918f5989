"""Repeated paragraphs inside documents, by MinHash bands, exact check and components.

A paragraph is a line of at least LINE words. Paragraphs whose five-word shingles are similar are
linked (8 bands of 3 minima: a pair at similarity 0.8 shares none with a probability of 0.003),
checked exactly, and joined into components; the first one of a component stays.

A passage pasted into the middle of a line is no paragraph of its own. So texts also get anchors: of
every WINDOW neighbouring runs of GRAM words the one of smallest hash. Texts that share RUN words in a
row share an anchor among them, always. An anchor points to its first place; anchors that point to the same
text at the same distance make one stretch, the words of that text around it are fetched, and the stretch is
compared word by word: every run of RUN equal words or more, to its last equal word, is a repeated
passage. It goes on past single words that differ, at most EDGE words past the outer anchors, while at least
four of five words of what is added are equal, so a passage with some words changed is one.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import STEP, mix, shingles, text_batches, worker_state
from codeloom.llm.near import Bands, near_groups
from codeloom.llm.repeats import covered, cut_spans, slide
from codeloom.session import materialise

LINE, RUN, WORDS = 15, 20, 5
GRAM, WINDOW = 12, 9  # GRAM + WINDOW - 1 = RUN
EDGE = 2 * RUN  # words past its outer anchors in which a stretch may still grow
COST, DROP = 4, 12  # a word that differs outweighs four equal ones: spans at four fifths or more
ASKED = 512  # stretches served from one copy of a text
BLOCK = 1 << 16  # bytes whose words are hashed together
LINES, ANCHORS = ["lo", "hi", "size", "f1", "f2", "bands"], ["c", "at"]
SCHEME = Bands(8, 3, 24, 2)
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))


def words_of(data):
    """Byte spans of the words of a text, and the number of the line each is in."""
    points = np.frombuffer(data, np.uint8)
    white = np.ones(len(points) + 2, bool)
    white[1:-1] = WHITE[points]
    start, end = np.flatnonzero(white[:-1] & ~white[1:]), np.flatnonzero(~white[:-1] & white[1:])
    return start, end, np.searchsorted(np.flatnonzero(points == 10), start)


def powers(size):
    """Powers of STEP and their inverses up to ``size``, kept by the worker for texts of usual length."""
    state = worker_state()
    if len(state.get("powers", ((),))[0]) <= size:
        both = []
        for base in (STEP, INVERSE):
            row = np.full(max(size + 1, 1 << 15), base, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        if size > 1 << 20:
            return both
        state["powers"] = both
    return state["powers"]


def prefix_hash(values):
    """Sums of values times powers of STEP, and the inverse powers: hashes of runs by one difference."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, down


def hashes_of(data, start, end):
    """Hashes of the words data[start:end] of a text, A-Z lower-cased; equal words are equal wherever they stand."""
    points, out = np.frombuffer(data.lower(), np.uint8), np.empty(len(start), np.uint64)
    edge = np.unique([*np.searchsorted(start, np.arange(0, len(points), BLOCK)), len(start)]).tolist()
    for i, j in zip(edge[:-1], edge[1:]):
        total, down = prefix_hash(points[start[i] : end[j - 1]].astype(np.uint64) + np.uint64(1))
        lo, hi = start[i:j] - start[i], end[i:j] - start[i]
        out[i:j] = mix((total[hi] - total[lo]) * down[lo])
    return out


def anchors_of(own):
    """(hash, word number) arrays of the anchors of a text, from its words' hashes."""
    n = len(own) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    total, down = prefix_hash(own)
    value = mix((total[GRAM:] - total[:n]) * down[:n])
    width = min(WINDOW, n)
    low = ~slide(value, width)  # the largest of the windows' smallest values is a run's own if one chose it
    pad = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    chosen = value == ~slide(np.concatenate([pad, low, pad]), width)
    chosen[1:] &= value[1:] != value[:-1]
    at = np.flatnonzero(chosen)
    return value[at].view(np.int64), at.astype(np.int32)


def distinct_anchors(own):
    """The first of each anchor of a text, and the places of the others: (hash, at, repeated at, its first place)."""
    value, at = anchors_of(own)
    _, first, back = np.unique(value, return_index=True, return_inverse=True)
    later = np.setdiff1d(np.arange(len(value)), first, assume_unique=True)
    first_of = first[back]  # unique gives the first index of each value
    keep = np.sort(first)
    return value[keep], at[keep], at[later], at[first_of[later]]


def grown(first, last, i, step):
    """The furthest equal run, going ``step`` from run i, that ends a stretch in which few enough words differ."""
    j, reach, score, best = i, i, 0, 0
    while 0 <= j + step < len(first):
        score -= COST * (first[j + 1] - last[j] if step > 0 else first[j] - last[j - 1])
        if best - score > DROP:
            break
        j += step
        score += last[j] - first[j]
        if score > best:
            reach, best = j, score
    return reach


def similar_runs(own, other, shift):
    """Word spans (first, last + 1) in which own[i] equals other[i - shift] mostly, ``other`` as (start, words).

    Each holds RUN equal words in a row; from there it grows over words that differ as long as it gains more
    than COST equal words for each, and never over more than DROP / COST of them without such a gain.
    """
    start, words = other
    lo, hi = max(0, start + shift), min(len(own), start + shift + len(words))
    if hi - lo < RUN:
        return []
    same = np.zeros(hi - lo + 2, np.int8)
    same[1:-1] = own[lo:hi] == words[lo - shift - start : hi - shift - start]
    edge = np.diff(same)
    first, last = (np.flatnonzero(edge == 1) + lo).tolist(), (np.flatnonzero(edge == -1) + lo).tolist()
    found, i = [], 0
    while i < len(first):
        if last[i] - first[i] >= RUN:
            begin, i = grown(first, last, i, -1), grown(first, last, i, 1)
            found.append((first[begin], last[i]))
        i += 1
    return found


def own_repeats(own):
    """Word spans of RUN words or more that stand before in the same text."""
    _, _, later, first = distinct_anchors(own)
    found, reach, n = [], -1, len(own)
    for at, before in zip(later.tolist(), first.tolist()):
        if at + GRAM <= reach:
            continue
        lo, hi, shift = at, at + GRAM, at - before
        while lo > shift and own[lo - 1] == own[lo - 1 - shift]:
            lo -= 1
        while hi < n and own[hi] == own[hi - shift]:
            hi += 1
        reach = hi
        if hi - lo >= RUN:
            found.append((lo, hi))
    return found


def short(hashes):
    """Word hashes as 32-bit numbers, to send and compare."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def lines_of(own, line, start, end):
    """(lo, hi, n, f1, f2, bands) of the lines with LINE words or more, all of a text at once.

    f1 and f2 are hashes of a line's words in order: equal lines are one node.
    """
    new = np.ones(len(own) + 1, bool)
    np.not_equal(line[1:], line[:-1], out=new[1:-1])
    edge = np.flatnonzero(new)
    long = np.flatnonzero(np.diff(edge) >= LINE)
    if not len(long):
        return None
    first, after = edge[long], edge[long + 1]
    count = after - first - WORDS + 1
    at = np.cumsum(count) - count
    mark = shingles(own, WORDS)[np.repeat(first - at, count) + np.arange(count.sum())]
    prints = []
    for values in (own, mix(own)):
        total, down = prefix_hash(values)
        prints.append(mix((total[after] - total[first]) * down[first] + count.astype(np.uint64)).view(np.int64))
    return start[first], end[after - 1], count, *prints, SCHEME.keys_of_groups(mark, at)


def chosen_anchors(own, base):
    """(hash, word number, text) of the anchors of many texts at once; text t has the words base[t] to base[t + 1].

    The same as ``anchors_of`` each: no window of runs reaches from one text into another, since GRAM - 1 runs
    between them belong to neither and a window holds fewer.
    """
    n, size = len(own) - GRAM + 1, np.diff(base)
    text = np.repeat(np.arange(len(size)), size)
    chosen = np.zeros(max(n, 0), bool)
    if n >= WINDOW:
        total, down = prefix_hash(own)
        within = text[GRAM - 1 :] == text[:n]
        value = np.where(within, mix((total[GRAM:] - total[:n]) * down[:n]), np.iinfo(np.uint64).max)
        low = ~slide(value, WINDOW)
        low[~(within[: n - WINDOW + 1] & within[WINDOW - 1 :])] = np.iinfo(np.uint64).max
        pad = np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)
        chosen = within & (value == ~slide(np.concatenate([pad, low, pad]), WINDOW))
        chosen[1:] &= value[1:] != value[:-1]
    values, places = [value[chosen].view(np.int64)] if n >= WINDOW else [], [np.flatnonzero(chosen)]
    for t in np.flatnonzero((size >= GRAM) & (size < GRAM + WINDOW - 1)).tolist():  # fewer runs than a window
        brief, at = anchors_of(own[base[t] : base[t + 1]])
        values.append(brief)
        places.append(at + base[t])
    value, place = np.concatenate(values or [np.zeros(0, np.int64)]), np.concatenate(places)
    if len(places) > 1:
        order = np.argsort(place)
        value, place = value[order], place[order]
    text = text[place]
    return value, place - base[text], text


def parts_of(texts):
    """Parts of many texts, worked out together: (sha, own, line counts, line columns, anchor counts, anchor columns)."""
    begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
    joined = b"\n".join(texts)  # the end of a text ends its last line and word
    start, end, line = words_of(joined)
    own = hashes_of(joined, start, end)
    base = np.searchsorted(start, begin)
    lines = lines_of(own, line, start, end) if len(own) else None
    if lines is None:
        lines = (*[np.zeros(0, np.int64)] * 5, np.zeros((0, SCHEME.bands), np.int64))
    of = np.searchsorted(begin, lines[0], "right") - 1
    lo, hi = lines[0] - begin[of], lines[1] - begin[of]
    value, at, text = chosen_anchors(own, base)
    order = np.lexsort((value, text))  # stable: the first of equal anchors is the first in its text
    repeat = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    keep = np.ones(len(value), bool)
    keep[order[1:][repeat]] = False
    again = np.bincount(text[~keep], minlength=len(texts)) > 0
    sha = [hashlib.sha256(x).hexdigest() for x in texts]
    count = np.bincount(text[keep], minlength=len(texts))
    return sha, again, np.bincount(of, minlength=len(texts)), (lo, hi, *lines[2:]), count, (value[keep], at[keep])


def listed(counts, values):
    """An Arrow array of lists of ``counts`` values each."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)


def portions(batch, column, rows=128, size=1 << 19):
    """(slice of the batch, its texts in UTF-8): up to ``rows`` rows or about ``size`` bytes at a time."""
    begin, data, held = 0, [], 0
    for value in batch.column(column):
        data.append((value.as_py() or "").encode())
        held += len(data[-1])
        if len(data) == rows or held >= size:
            yield batch.slice(begin, len(data)), data
            begin, data, held = begin + len(data), [], 0
    if data:
        yield batch.slice(begin), data


def document_parts(rows: DataFrame) -> DataFrame:
    """(t1, t2, id, n, sha, own, line columns, anchor columns) of (t1, t2, id, text); columns are arrays.

    ``own`` tells that a text repeats an anchor of its own.
    """
    kind = rows.schema["id"].dataType.simpleString()
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["t1", "t2", "id", "n", "sha", "own", *LINES, *ANCHORS]

    def run(batches):
        for batch in batches:
            for part, texts in portions(batch, 3):
                sha, again, n_lines, lines, n_anchors, (value, at) = parts_of(texts)
                known = [pa.array([len(x) for x in texts], pa.int64()), pa.array(sha), pa.array(again, pa.bool_())]
                arrays = [listed(n_lines, pa.array(c, k)) for c, k in zip(lines, kinds)]
                bands = listed([SCHEME.bands] * len(lines[5]), pa.array(lines[5].ravel(), pa.int64()))
                arrays += [listed(n_lines, bands), listed(n_anchors, pa.array(value, pa.int64())), listed(n_anchors, pa.array(at, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *known, *arrays], names)

    lines = "lo array<int>, hi array<int>, size array<bigint>, f1 array<bigint>, f2 array<bigint>, bands array<array<bigint>>"
    return rows.mapInArrow(run, f"t1 bigint, t2 bigint, id {kind}, n bigint, sha string, own boolean, {lines}, c array<bigint>, at array<int>")


def line_texts(rows: DataFrame) -> DataFrame:
    """(id, text) of wanted lines: rows are (text, wanted), an array of (name, lo, hi)."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                out = []
                for value, wanted in zip(*(c.to_pylist() for c in batch.slice(begin, 64).columns)):
                    data = value.encode()
                    out.extend((w["name"], data[w["lo"] : w["hi"]].decode()) for w in wanted)
                columns = list(zip(*out)) or [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["id", "text"])

    return rows.select("text", "wanted").mapInArrow(run, "id bigint, text string")


def line_bands(rows: DataFrame) -> DataFrame:
    """(id, bands, text) of lines (id, text): the band keys that their documents' parts hold."""

    def run(batches):
        for batch in batches:
            for part, texts in portions(batch, 1, 1024):
                joined = b"\n".join(texts)
                start, end, line = words_of(joined)
                bands = lines_of(hashes_of(joined, start, end), line, start, end)[5]
                bands = listed([SCHEME.bands] * len(texts), pa.array(bands.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), bands, part.column(1)], ["id", "bands", "text"])

    return rows.mapInArrow(run, "id bigint, bands array<bigint>, text string")


def repeated_lines(rows, parts, asked_for):
    """(t1, t2, lo, hi) of the lines of a component that aren't its first one, and the texts concerned.

    The texts of candidate lines and those of ``asked_for`` (t1, t2, salt, ranges) are fetched together, once.
    """
    texts = []

    def flat(*columns):  # zips the columns in use only: a zip is not pruned
        found = parts.select("t1", "t2", "id", F.inline_outer(F.arrays_zip("lo", *columns))).where("lo is not null")
        return found.withColumn("name", F.xxhash64("t1", "t2", "lo"))

    marks = flat("size", "f1", "f2").select(F.col("name").alias("id"), F.col("size").alias("n"), "f1", "f2")
    bands = flat("bands").select(F.col("name").alias("id"), "bands")

    def wanted_texts(names):
        places = flat("hi").select("t1", "t2", "lo", "hi", "name").join(names.withColumnRenamed("id", "name"), "name", "left_semi")
        asked = places.groupBy("t1", "t2").agg(F.collect_set(F.struct("name", "lo", "hi")).alias("wanted"))
        asked = asked.withColumn("salt", F.lit(0)).join(asked_for, ["t1", "t2", "salt"], "full")
        fetched = rows.join(asked, ["t1", "t2"]).select("t1", "t2", "salt", "text", "wanted", "ranges")
        texts.append(materialise(fetched, "texts"))
        return line_texts(texts[0].where("wanted is not null")).distinct()

    groups = near_groups(marks, bands, wanted_texts, WORDS, 80, SCHEME, line_bands)
    groups = materialise(groups.select(F.col("id").alias("name"), "component_id").distinct(), "groups")
    sizes = groups.where("name <> component_id").select("component_id").distinct()  # a lone line is its own component
    groups = groups.join(materialise(sizes, "sizes"), "component_id", "left_semi")
    places = flat("hi").select("name", "id", "t1", "t2", "lo", "hi")
    found = materialise(places.join(groups, "name"), "lines")
    return not_first(found, "component_id", "t1", "t2", "lo", "hi"), texts[0]


def not_first(places, group, *columns):
    """All but the first place (by id, then lo) of each group; rows that repeat a place stay with it."""
    first = places.groupBy(group).agg(F.min(F.struct(F.col("id").isNull(), "id", "t1", "t2", "lo")).alias("first"))
    both = places.join(materialise(first.select(group, "first.t1", "first.t2", "first.lo").toDF(group, "f1", "f2", "at"), "first"), group)
    return both.where("t1 <> f1 or t2 <> f2 or lo <> at").select(*columns)


def stretches(parts):
    """(t1, t2, f1, f2, shift, first, last): stretches of a text whose anchors first stand in another text; stored.

    Word i of the text is word i - shift of the text (f1, f2); anchors lie between the words first and last.
    """
    flat = parts.select("t1", "t2", "id", F.inline_outer(F.arrays_zip(*ANCHORS))).where("c is not null")
    place = F.struct(F.col("id").isNull(), "id", "t2", "at")  # t1 is the hash of the id
    known = flat.groupBy("c").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    known = known.select("c", F.xxhash64(F.col("first.id").cast("string")).alias("f1"), F.col("first.t2").alias("f2"), F.col("first.at").alias("there"))
    known = materialise(known, "anchors")
    found = flat.join(known, "c").where("t1 <> f1 or t2 <> f2").groupBy("t1", "t2", "f1", "f2", (F.col("at") - F.col("there")).alias("shift"))
    return materialise(found.agg(F.min("at").alias("first"), (F.max("at") + GRAM).alias("last")), "stretches")


def ranges_asked(found):
    """(t1, t2, salt, ranges): the words that stretches need of the texts they point to; many in several portions.

    A run of equal words reaches less than WINDOW words past its outer anchors, a stretch EDGE words.
    """
    salt = F.pmod(F.xxhash64("t1", "t2", "shift"), F.col("portions")).cast("int").alias("salt")
    number = found.groupBy("f1", "f2").agg(F.ceil(F.count("*") / ASKED).alias("portions"))
    lo = F.greatest(F.col("first") - F.col("shift") - EDGE, F.lit(0)).alias("lo")
    want = F.struct("t1", "t2", "shift", lo, (F.col("last") - F.col("shift") + EDGE).alias("hi")).alias("want")
    asked = found.join(number, ["f1", "f2"]).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), salt, want)
    return asked.groupBy("g1", "g2", "salt").agg(F.collect_list("want").alias("ranges")).withColumnsRenamed({"g1": "t1", "g2": "t2"})


def ranges_of(texts: DataFrame) -> DataFrame:
    """(t1, t2, shift, lo, words): the words asked for, as 32-bit hashes, for the text (t1, t2) that asked."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 32):
                out = []
                for value, ranges in zip(*(c.to_pylist() for c in batch.slice(begin, 32).columns)):
                    data = value.encode()
                    own = short(hashes_of(data, *words_of(data)[:2]))
                    out.extend((r["t1"], r["t2"], r["shift"], r["lo"], own[r["lo"] : r["hi"]]) for r in ranges)
                columns = list(zip(*out)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["t1", "t2", "shift", "lo", "words"])

    asked = texts.where("ranges is not null").select("text", "ranges")
    return asked.mapInArrow(run, "t1 bigint, t2 bigint, shift int, lo int, words array<int>")


RANGES = "array<struct<t1: bigint, t2: bigint, shift: int, lo: int, hi: int>>"


def repeated_spans(data, row):
    """Byte spans of the repeated runs of a text: with other texts (b), with itself (own), or all of it (copy)."""
    if not (row["b"] or row["own"] or row["copy"]):
        return set()
    start, end, _ = words_of(data)
    if row["copy"]:
        return {(int(start[0]), int(end[-1]))} if len(start) >= RUN else set()
    own = hashes_of(data, start, end)
    runs, brief = own_repeats(own) if row["own"] else [], short(own)
    for x in row["b"] or []:
        runs += similar_runs(brief, (x["lo"], np.array(x["words"], np.int32)), x["shift"])
    return {(int(start[lo]), int(end[hi - 1])) for lo, hi in runs}


def repeated_paragraphs(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``df``.

    Of similar paragraphs and of passages with RUN equal words or more in a row the one with the smallest (id, place)
    stays; rows without an id come last. Null counts as empty. A row that repeats another one with its id is the same
    document. ``spans`` are the removed bytes (lo, hi) of the text in UTF-8.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.select(F.xxhash64(F.col("id").cast("string")).alias("t1"), F.xxhash64("text").alias("t2"), "id", "text")
    parts = materialise(document_parts(rows), "parts")
    found = stretches(parts)
    copies = found.where("t2 = f2 and shift = 0").select("t1", "t2", F.lit(True).alias("copy")).distinct()
    other = found.where("t2 <> f2")
    asked = ranges_asked(other).unionByName(
        other.select("t1", "t2").union(copies.select("t1", "t2")).union(parts.where("own").select("t1", "t2"))
        .select("t1", "t2", F.lit(0).alias("salt"), F.lit(None).cast(RANGES).alias("ranges"))
    )
    # one row per text and portion: what is asked of it, or only that its text is wanted
    asked = asked.groupBy("t1", "t2", "salt").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    asked = asked.withColumn("ranges", F.when(F.size("ranges") > 0, F.col("ranges")))
    lines, texts = repeated_lines(rows, parts, materialise(asked, "asked"))
    lines = lines.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("a"))
    served = ranges_of(texts).groupBy("t1", "t2").agg(F.collect_list(F.struct("shift", "lo", "words")).alias("b"))
    whole = copies.join(lines, ["t1", "t2"], "full").join(served, ["t1", "t2"], "full")
    whole = whole.join(parts.where("own").select("t1", "t2", "own").distinct(), ["t1", "t2"], "full")
    joined = texts.where("salt = 0").join(whole, ["t1", "t2"]).select("t1", "t2", "text", "a", "b", "copy", "own")

    def finish(batches):
        for batch in (b.slice(i, 128) for b in batches for i in range(0, max(b.num_rows, 1), 128)):
            out = []
            for row in batch.to_pylist():
                data = row["text"].encode()
                spans = {(s["lo"], s["hi"]) for s in row["a"] or []}
                spans |= repeated_spans(data, row)
                gone = covered(spans, len(data))
                digest = hashlib.sha256(cut_spans(data, gone)).hexdigest()
                pairs = [{"lo": lo, "hi": hi} for lo, hi in gone]
                out.append((row["t1"], row["t2"], sum(hi - lo for lo, hi in gone), len(gone), digest, pairs))
            columns = list(zip(*out)) or [[]] * 6
            pair = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pair]
            names = ["t1", "t2", "n_removed", "n_spans", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "t1 bigint, t2 bigint, n_removed bigint, n_spans bigint, kept string, spans array<struct<lo: int, hi: int>>"
    done = joined.mapInArrow(finish, schema).dropDuplicates(["t1", "t2"])
    result = parts.select("t1", "t2", "id", "n", "sha").join(done, ["t1", "t2"], "left")
    return result.select(
        "id",
        F.col("n").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<lo: int, hi: int>>")).alias("spans"),
    )
