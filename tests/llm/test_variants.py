"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import variants

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(docs, shortest=7, least=2):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if mark % 31 == 0:
                word = word[: mark % len(word)] + word[mark % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[word]:
            form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def computed(df):
    found = variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, words, docs):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(words)]
    rows = []
    for i in range(docs):
        own = [draw.choice(base[: draw.randint(1, words)]) for _ in range(60)]
        own = [w if draw.random() < 0.9 else w[:3] + draw.choice("abÉ") + w[4:] for w in own]
        rows.append((i, " ".join(w.title() if draw.random() < 0.1 else w for w in own)))
    return rows


def test_against_all_pairs(spark):
    rows = corpus(1, 300, 200)
    expected = plain(rows)
    assert sum(r[1] is not None for r in expected) > 20 and sum(r[4] > 1 for r in expected) > 20
    assert computed(spark.createDataFrame(rows, SCHEMA)) == expected


def test_hot_keys_are_cut_into_tiles():
    draw = random.Random(3)
    words = sorted({"commons" + "".join(draw.choice("ab") for _ in range(k)) for k in (3, 4, 5) for _ in range(90)})
    rows = []
    for word in words:  # the tiles that ``tiles`` deals out, with blocks of about twelve words
        for m in (len(word), len(word) + 1):
            x = m * 2 // 3
            for kind, key in ((0, word[:x]), (1, word[-x:]), (2, word[: m - x] + word[x - m :])):
                mine = zlib.crc32(word.encode()) % 4
                for other in range(4):
                    rows.append({"kind": kind, "m": m, "key": key, "i": min(mine, other), "j": max(mine, other), "mine": mine, "word": word, "n": 1})
    draw.shuffle(rows)
    found = variants._near_pairs(pa.Table.from_pylist(rows))
    pairs = [tuple(sorted(p)) for p in zip(found["a"].to_pylist(), found["c"].to_pylist())]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_blocks_hold_a_bounded_number_of_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 16)
    words = [("x" * 5 + chr(97 + i) + chr(97 + j), 2) for i in range(20) for j in range(20)]
    df = spark.createDataFrame(words, "word string, n long")
    sizes = variants.tiles(variants.keyed(df)).groupBy("kind", "m", "key", "i", "j").count()
    assert sizes.agg(F.max("count")).first()[0] <= 80
    near = variants.near_words(df)
    assert near.count() == 400 * 38 // 2 == near.distinct().count()


def test_chains_of_forms_and_ties(spark):
    words = [("aaaaaaa", 1000), ("aaaaaab", 100), ("aaaaabb", 10), ("aaaabbb", 2), ("bbbbbbb", 2), ("abbbbbb", 20), ("bbbbbba", 20)]
    found = {r.word: r for r in variants.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert found["aaaaabb"].form == "aaaaaab" and found["aaaaabb"].root == "aaaaaaa"
    assert found["aaaabbb"].form is None and found["aaaabbb"].root == "aaaabbb" and found["aaaabbb"].n_near == 1
    assert found["bbbbbbb"].form == "abbbbbb" and found["bbbbbbb"].form_n == 20


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "12 --")]])
def test_no_words(spark, rows):
    assert computed(spark.createDataFrame(rows, SCHEMA)) == []


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark):
    long = "w" * 3000 + " " + "Keyword key-words " * 400_000 + "v" * 3000
    rows = [(1, long), (1, long), (None, "keyword sentence"), (None, "keyword sentence"), (2, "w" * 3001 + " " + "w" * 3001)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "word", "n", "key", "kind", "m", "form", "root"):
        df = df.withColumn(name, F.lit(1))
    assert computed(df) == plain(rows)


def test_parts_join_to_the_text():
    text = "abc " * 10 + "d" * 100 + " é"
    old = variants.TEXT_PART
    try:
        variants.TEXT_PART = 7
        cut = list(variants.parts(text))
    finally:
        variants.TEXT_PART = old
    assert "".join(cut) == text and len(cut) > 3
    assert [w for p in cut for w in variants.RUN.findall(p)] == variants.RUN.findall(text)
