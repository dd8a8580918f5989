"""Near duplicates and components against brute force, with hot groups and odd rows."""

import random

import pytest
from brute import near_components

from codeloom.llm import near
from codeloom.llm.components import components


def corpus():
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    docs = {i: [word() for _ in range(draw.randint(1, 60))] for i in range(60)}
    base = [word() for _ in range(100)]
    for i in range(100, 220):  # one large group around the threshold
        own = list(base)
        for _ in range(draw.randint(0, 4)):
            own[draw.randrange(100)] = word()
        docs[i] = own
    docs = {k: " ".join(v) for k, v in docs.items()}
    docs |= {300 + i: docs[7].upper() for i in range(30)}
    return docs | {400: None, 401: "", 402: " \t\n", 403: "one", 404: "ONE", 405: "one two", 406: "long " * 5000}


@pytest.mark.parametrize("words, block", [(4, 2048), (5, 16)])
def test_against_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(near, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id bigint, text string, id int").repartition(4)
    got = {r.id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, words=words).collect()}
    assert got == near_components(docs, words, 80)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A  b c d e f"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.id or 0, r.component_id or 0) for r in near.near_duplicates(df, words=4).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (5, 5)]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 260)] + [(7, 7), (300, 301), (301, 300)]
    pairs += [(draw.randint(400, 460), draw.randint(400, 460)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for p in pairs for x in p if p[0] != p[1]}
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pruning_keeps_what_may_link():
    scheme = near.Bands()
    least = near.least_matches(80, scheme)
    assert all(0.6 * n < m < 0.8 * n for m, n in zip(least[2:], range(144, 289, 48)))
