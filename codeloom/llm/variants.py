"""Grouping of spelling variants: words one edit apart, and the frequent form each rare one stands for.

Two words are near if the longer one's length less one is reached by their common beginning and common
end together: exactly one code point is inserted, deleted or replaced. Words are compared densely, tile by
tile: a tile takes two blocks of words as padded matrices of code points, read from the left and from
the right, and counts the common beginning and the common end of every row of one with every row of the other.

Which blocks meet: let M be the longer length, so that M - 1 code points are intact. If the common beginning
has fewer than x and the common end fewer than x code points, either has more than M - 1 - x. So near words
share a beginning of x, or an end of x, or a shorter beginning and end, for the same M; with x two thirds
of M, words are dealt by these three keys, for M their own length and one more. Nothing near is lost, and a
pair is reported only by the first key that it shares. A key with more words than a block holds is cut into
blocks, and every two blocks of it make a tile of their own.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import sent_if_small, shares, text_batches, texts
from codeloom.session import materialise

RUN = re.compile("[a-zÀ-ÿ]+")  # of texts whose A-Z are lower-cased
TEXT_PART = 1 << 22  # code points of a text that are split into words at once
KEPT = 200_000  # different words a task counts before it sends them on
BLOCK, CELLS = 1024, 1 << 22  # words of a block; code points of a block, and of a comparison
ROWS_PER_SHARD = 100_000
BEGIN, END, BOTH = 0, 1, 2
DOUBLINGS = 6  # a chain of forms grows at least twofold a step: 2^6 steps pass any 64-bit count


def parts(text):
    """The text in parts that do not cut a run (unless a run is longer than a part)."""
    at = 0
    while len(text) - at > TEXT_PART:
        end = at + TEXT_PART
        while end < len(text) and RUN.match(text, end - 1, end) and RUN.match(text, end, end + 1):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def marked(prefix, word, every):
    """The word without the code point that the document's mark on it deletes, if it does."""
    mark = zlib.crc32(word.encode(), prefix)
    if mark % every:
        return word
    at = mark % len(word)
    return word[:at] + word[at + 1 :]


def counter(shortest, every):
    """A function of Arrow batches (id, text) that counts words of ``shortest`` code points at least."""

    def flushed(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches):
        counts = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                prefix = zlib.crc32(f"{key}:".encode())
                for part in parts(text):
                    for word in RUN.findall(part):
                        if len(word) >= shortest:
                            word = marked(prefix, word, every)
                            if len(word) >= shortest:
                                counts[word] = counts.get(word, 0) + 1
                    if len(counts) > KEPT:
                        yield flushed(counts)
                        counts.clear()
        yield flushed(counts)

    return count


def vocabulary(docs: DataFrame, key="doc_id", text="text", shortest=7, least=2, every=31) -> DataFrame:
    """(word, n): the words of all texts, A-Z lower-cased, with their number of occurrences; stored.

    A run of letters whose mark, the CRC-32 of ``<id>:<run>``, is a multiple of ``every`` loses the code point at mark
    modulo length. Words of ``shortest`` code points and ``least`` occurrences stay. A null id is written as
    nothing; null and empty texts have no words.
    """
    text_batches(docs.sparkSession)
    rows = texts(docs, key, text).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    found = rows.mapInArrow(counter(shortest, every), "word string, n bigint")
    return materialise(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "vocabulary")


def keyed(words: DataFrame) -> DataFrame:
    """A row per word, length M and kind of key: kind, m, key, word, n."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    x = F.floor(F.col("m") * 2 / 3).cast("int")
    a = F.col("m") - x
    keys = F.array(
        F.struct(F.lit(BEGIN).alias("kind"), F.expr("left(word, cast(floor(m * 2 / 3) as int))").alias("key")),
        F.struct(F.lit(END).alias("kind"), F.expr("right(word, cast(floor(m * 2 / 3) as int))").alias("key")),
        F.struct(F.lit(BOTH).alias("kind"), F.concat(F.left("word", a), F.right("word", a)).alias("key")),
    )
    return rows.select("m", "word", "n", F.explode(keys).alias("k")).select("k.kind", "m", "k.key", "word", "n")


def tiles(rows: DataFrame) -> DataFrame:
    """The keyed words with the tiles (i, j) they take part in, as ``mine``: the block of the word itself."""
    room = F.greatest(F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.col("m"))), F.lit(1))
    large = rows.groupBy("kind", "m", "key").agg(F.count("*").alias("size"), F.max(F.length("word") == F.col("m")).alias("long"))
    large = large.where((F.col("size") > 1) & F.col("long")).select("kind", "m", "key", F.ceil(F.col("size") / room).cast("int").alias("blocks"))
    cut = rows.join(large, ["kind", "m", "key"])
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("kind", "m", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "word", "n")


def matrix(words, m):
    """Words as rows of m code points, padded with zeros, read from the left and from the right."""
    left, right = (np.array(w, f"U{m}") for w in (words, [w[::-1] for w in words]))
    return left.view(np.uint32).reshape(len(words), m), right.view(np.uint32).reshape(len(words), m)


def dense(left, right, m, x, kind):
    """Pairs (row of left, row of right) of two matrices that are near, of different words of which one at least has length m."""
    step = max(1, CELLS // max(1, len(right[0]) * m))
    for at in range(0, len(left[0]), step):
        begin = (left[0][at : at + step, None, :] != right[0][None, :, :]).argmax(2)
        end = (left[1][at : at + step, None, :] != right[1][None, :, :]).argmax(2)
        near = begin + end >= m - 1
        if kind == BEGIN:
            near &= begin >= x
        elif kind == END:
            near &= (end >= x) & (begin < x)
        else:
            near &= (begin < x) & (end < x)
        a, b = np.nonzero(near)
        yield a + at, b


def _sorted_groups(table):
    """(slice bounds) of the tiles in a table sorted by tile, words of one block and of length m first."""
    same = np.ones(max(0, len(table) - 1), bool)
    for name in ("kind", "m", "key", "i", "j"):
        column = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
        same &= column[1:] == column[:-1]
    cuts = np.flatnonzero(~same) + 1
    return zip(np.r_[0, cuts], np.r_[cuts, len(table)])


def _near_pairs(table: pa.Table) -> pa.Table:
    """Near pairs of all tiles of a shard."""
    table = table.sort_by([(c, "ascending") for c in ("kind", "m", "key", "i", "j", "mine", "word")])
    words, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
    kinds, ms, firsts, seconds = (table[c].to_numpy() for c in ("kind", "m", "i", "j"))
    lengths, mine = np.fromiter(map(len, words), np.int64, len(words)), table["mine"].to_numpy()
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, end in _sorted_groups(table):
        m, kind = int(ms[start]), int(kinds[start])
        x, here = m * 2 // 3, np.arange(start, end)
        long = lengths[here] == m
        if firsts[start] == seconds[start]:
            own, other = here[long], np.r_[here[long], here[~long]]
            sides = [(own, other, True)]
        else:
            first = mine[here] == firsts[start]
            sides = [(here[first & long], here[~first], False), (here[first & ~long], here[~first & long], False)]
        for a, b, alone in sides:
            if not len(a) or len(b) < 1 + alone:
                continue
            left = matrix(list(words[a]), m)
            right = left if a is b else matrix(list(words[b]), m)
            for p, q in dense(left, right, m, x, kind):
                if alone:  # rows of length m are the first columns; each pair of them once
                    p, q = p[q > p], q[q > p]
                found[0].append(a[p])
                found[1].append(b[q])
    a, b = np.concatenate(found[0]), np.concatenate(found[1])
    return pa.table([pa.array(words[a], pa.string()), pa.array(n[a]), pa.array(words[b], pa.string()), pa.array(n[b])], list("abcd"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of near words of a stored table (word, n) once."""
    rows = materialise(tiles(keyed(words)), "tiles")
    shard = F.pmod(F.xxhash64("kind", "m", "key", "i", "j"), F.lit(shares(rows, ROWS_PER_SHARD)))
    found = rows.withColumn("shard", shard).groupBy("shard").applyInArrow(_near_pairs, "a string, b bigint, c string, d bigint")
    return found.toDF("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): the last word of the chain, by doubling steps."""
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        both = materialise(links.join(ahead, "root", "left"), "roots")
        links = both.select("word", F.coalesce("ahead", "root").alias("root"))
        if both.where("ahead is not null").isEmpty():
            break
    return links


def variants(words: DataFrame, ratio=10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a stored table (word, n).

    The form of a word is its near word of largest n, the smallest of several, if that is ``ratio``
    (2 at least) times the word's own n; the root is the last word that forms lead to, else the word.
    """
    pairs = materialise(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m"))
    both = both.union(pairs.select(F.col("b"), F.col("a"), F.col("na")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    large = -F.col("best.m") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n"),
    )
    rows = materialise(rows, "forms")
    found = rows.join(roots(materialise(rows.where("form is not null").select("word", "form"), "links")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key="doc_id", text="text", shortest=7, least=2, every=31, ratio=10) -> DataFrame:
    """The words of all texts with their forms and roots; see ``vocabulary`` and ``variants``.

    Texts without words give no rows, an empty table none at all; repeated rows count as often as
    they occur. Other columns are not read.
    """
    return variants(vocabulary(docs, key, text, shortest, least, every), ratio)
