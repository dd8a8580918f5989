"""Repeated strings against a count of all windows."""

import hashlib
import random

import pytest
from brute import repeated_bytes

from codeloom.llm.repeats import repeats


def texts():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    docs = {i: " ".join(word() for _ in range(draw.randint(0, 150))) for i in range(40)}
    docs |= {100 + i: docs[i] + " " + passage + " " + word() for i in range(12)}
    docs |= {200 + i: docs[3] for i in range(5)}
    docs |= {300: None, 301: "", 302: "x" * 900, 303: "ab" * 400, 304: passage * 3, 305: passage[:150]}
    return docs


@pytest.mark.parametrize("limit", [50_000, 2])
def test_against_windows(spark, limit):
    docs = texts()
    rows = [(k, v, "extra") for k, v in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string").repartition(5)
    got = {r.id: r for r in repeats(df, width=100, gram=40, bucket_rows=limit).collect()}
    for k, (n, gone, runs, kept) in repeated_bytes(docs, 100).items():
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (n, gone, runs)
        assert got[k].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a" * 10 + "b" * 300), (1, "a" * 10 + "b" * 300), (None, "q" * 199), (2, "z" * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.id or 0, r.n_bytes, r.n_removed) for r in repeats(df).collect())
    assert got == [(0, 199, 0), (1, 310, 310), (1, 310, 310), (2, 20, 0)]
    assert repeats(df.limit(0)).count() == 0
