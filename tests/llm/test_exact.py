"""The cuckoo filter, the live index, and exact duplicates against a plain grouping."""

import hashlib
import random
import re

import numpy as np

from codeloom.llm import exact


def digest(x):
    return hashlib.sha256(str(x).encode()).digest()


def test_filter_never_forgets_and_deletes():
    found = exact.CuckooFilter(4000)
    marks = exact.hash_of([digest(i) for i in range(3500)])
    for part in np.array_split(marks, 7):
        found.insert(part)
    assert found.contains(marks).all()
    others = exact.hash_of([digest(-i) for i in range(1, 5000)])
    assert found.contains(others).mean() < 0.01
    found.delete(marks[:2000])
    assert found.contains(marks[2000:]).all()
    assert found.contains(marks[:2000]).mean() < 0.05


def test_index_resizes_and_counts():
    index, draw, plain = exact.LiveIndex(8), random.Random(2), {}
    for _ in range(40):
        keys = [draw.randrange(3000) for _ in range(200)]
        ids = [draw.randrange(10**6) for _ in keys]
        index.insert([digest(k) for k in keys], ids, 1)
        for k, i in zip(keys, ids):
            low, n = plain.get(k, (i, 0))
            plain[k] = (min(low, i), n + 1)
    assert index.resizes > 0
    assert {k: tuple(index.keys[digest(k)]) for k in plain} == plain
    gone = list(plain)[::2]
    index.delete([digest(k) for k in gone], [plain[k][1] for k in gone])
    index.delete([digest("unknown")])
    assert index.lookup([digest(k) for k in gone]) == [None] * len(gone)
    assert index.lookup([digest(k) for k in list(plain)[1::2]]) == [plain[k][0] for k in list(plain)[1::2]]


def test_duplicates(spark):
    texts = ["a  b", "a\tb", "a b", " a b", "", None, "é\x0b x", "é x", "a b", "solo"] + ["hot"] * 60
    rows = [(100 - i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "solo", "c", 1), (None, "alone", "c", 1), (100, "a  b", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, keep_id int").repartition(6)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact.exact_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def test_update(spark):
    make = lambda rows: exact.digests(spark.createDataFrame(rows, "doc_id bigint, text string"))
    index = exact.build_index(exact.materialise(make([(1, "a"), (2, "a"), (3, "b"), (4, "c")]), "d"))
    index = exact.materialise(index, "index")
    after = exact.update_index(index, make([(0, "b"), (9, "d")]), make([(1, "a"), (2, "a"), (4, "c"), (5, "zz")]))
    assert sorted((r.keep_id, r.group_size) for r in after.collect()) == [(0, 2), (9, 1)]
