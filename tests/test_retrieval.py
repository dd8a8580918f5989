"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from codeloom.operators import retrieval


def vectors(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


@pytest.mark.parametrize("pack", [20000, 30])
def test_nearest_is_exact(spark, pack):
    rows, snippets = vectors(spark, 300, 1, copies=40)
    asked, queries = vectors(spark, 20, 1)
    queries = queries.union(queries)  # a repeated query is asked once
    near = retrieval.nearest(snippets, queries, 7, "id", "v", "id", "v", pack_rows=pack).collect()
    got = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["id"])
    for key, q in asked:
        order = sorted(rows, key=lambda s: (((np.array(s[1]) - np.array(q)) ** 2).sum(), s[0]))
        assert got[key] == [s[0] for s in order[:7]]


def test_fewer_snippets_than_k(spark):
    _, snippets = vectors(spark, 3, 2)
    _, queries = vectors(spark, 2, 3)
    assert retrieval.nearest(snippets, queries, 5, "id", "v", "id", "v").count() == 6


def test_embedding_and_prompt(spark):
    texts = spark.createDataFrame([(1, "open the file"), (2, "The FILE, open"), (3, "!"), (4, "close")], "id long, text string")
    coded = {r["id"]: r["embedding"] for r in retrieval.embed(texts, "id").collect()}
    assert coded[1] == coded[2] and 3 not in coded
    assert abs(sum(x * x for x in coded[1]) - 1) < 1e-12
    hits = spark.createDataFrame([(9, 1, 2), (9, 4, 1)], "query_id long, id long, rank int")
    queries = spark.createDataFrame([(9, "ask"), (8, "none")], "query_id long, query string")
    found = retrieval.with_snippets(hits, texts, "id")
    out = {r["query_id"]: r["prompt"] for r in retrieval.prompts(found, queries).collect()}
    assert out == {9: "close\nopen the file\n\nask", 8: "\n\nnone"}


def test_added_snippets_keep_content_keys(spark):
    texts = spark.createDataFrame([("a b",), ("c",)], "text string")
    once = retrieval.encode_snippets(texts)
    twice = retrieval.add_snippets(once, texts)
    assert twice.count() == 4 and twice.select("snippet_id").distinct().count() == 2


def test_pivots_prune_and_lose_nothing(spark):
    import numpy as np

    draw = np.random.default_rng(7)
    centres = draw.normal(size=(40, 8)) * 30
    rows = centres[draw.integers(0, 40, 6000)] + draw.normal(size=(6000, 8))
    rows[:1500] = rows[0]  # a quarter of all rows are the same vector
    asked = np.concatenate([rows[draw.integers(0, 6000, 60)] + 0.01, draw.normal(size=(5, 8)) * 100, rows[:2]])
    snippets = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(9999, None)], "snippet_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(77, None)], "query_id long, embedding array<double>")
    visits = []
    found = retrieval.nearest(snippets.repartition(3), queries, k=4, pack_rows=150, visits=visits).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.snippet_id)
    for i, v in enumerate(asked):
        away = ((rows - v) ** 2).sum(axis=1)
        assert got[i] == np.lexsort((np.arange(6000), away))[:4].tolist()
    assert set(got) == set(range(len(asked)))
    packs, number, sent = visits[0]
    assert packs >= 40 and number == len(asked) and sent < 0.5 * packs * number


def test_fewer_rows_than_asked_for_and_none(spark):
    snippets = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "snippet_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    for rows in (2, 100):
        got = retrieval.nearest(snippets, queries, k=9, pack_rows=rows).orderBy("rank").collect()
        assert [r.snippet_id for r in got] == [1, 0, 2, 3, 4]
        assert retrieval.nearest(snippets.limit(0), queries, k=2, pack_rows=rows).count() == 0
        assert retrieval.nearest(snippets, queries.limit(0), k=2, pack_rows=rows).count() == 0
