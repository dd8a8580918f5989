"""Limits and look-backs against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import traffic
from codeloom.operators.users import session_gate, token_validity
from codeloom.skew import last_before
from codeloom.sources.tables import append_users, lookup_users, register

SCHEMA = "user_id string, t long, event_id long"


def arrivals(seed, n=1500, users=6, span=4000):
    """Random requests; user 0 has two thirds of them; equal times occur."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.66 else rng.randrange(users)
        rows.append((None if user == 1 else f"u{user}", rng.randrange(span), i))
    return rows


def by_user(rows):
    groups = {}
    for user, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(user, []).append((t, i))
    return groups


def limited(rows, limit, period):
    out = {}
    for events in by_user(rows).values():
        kept = []
        for t, i in events:
            kept = [x for x in kept if t - x < period]
            out[i] = len(kept) < limit
            if out[i]:
                kept.append(t)
    return out


@pytest.mark.parametrize("limit,period,rows", [(2, 60, 50), (3, 200, 10), (1, 7, 10**6), (5, 40, 100), (40, 60, 30)])
def test_rate_limit(spark, limit, period, rows):
    asked = arrivals(limit)
    df = spark.createDataFrame(asked, SCHEMA)
    out = traffic.rate_limit(df, "user_id", "t", "event_id", limit, period, rows)
    assert {r["event_id"]: r["allowed"] for r in out.collect()} == limited(asked, limit, period)


def test_rate_limit_rounds_grow_with_the_logarithm(spark):
    """Every chunk starts from the exit of the one before: no guess is right."""
    asked = [("u", -50_000 + 999 * i, i) for i in range(400)]
    rounds = []
    out = traffic.rate_limit(spark.createDataFrame(asked, SCHEMA), "user_id", "t", "event_id", 1, 1000, 25, rounds)
    assert {r["event_id"]: r["allowed"] for r in out.collect()} == limited(asked, 1, 1000)
    assert 2 <= len(rounds) <= 6


def test_rate_limit_small_case(spark):
    times = [0, 10, 20, 60, 65, 70]
    df = spark.createDataFrame([("u", t, i) for i, t in enumerate(times)], SCHEMA)
    out = traffic.rate_limit(df, "user_id", "t", "event_id", 2, 60).orderBy("t").collect()
    assert [r["allowed"] for r in out] == [True, True, False, True, False, True]


@pytest.mark.parametrize("slice_rows", [7, 100, 10**6])
@pytest.mark.parametrize("limit,window", [(2, 60), (5, 11), (30, 900)])
def test_throttle(spark, limit, window, slice_rows):
    rows = [(None if u == "u0" else u or "u1", t, i) for u, t, i in arrivals(window)]
    expected = {}
    for events in by_user(rows).values():
        seen = []
        for t, i in events:
            seen = [x for x in seen if t - x < window]
            expected[i] = (len(seen), window - (t - seen[0]) if len(seen) >= limit else 0)
            seen.append(t)
    df = spark.createDataFrame(rows, SCHEMA)
    out = traffic.throttle(df, "user_id", "t", "event_id", limit, window, slice_rows).collect()
    assert {r["event_id"]: (r["arrivals"], r["delay"]) for r in out} == expected


def test_debounce(spark):
    times = [0, 100, 350, 650, 900]
    df = spark.createDataFrame([("u", t, i) for i, t in enumerate(times)], SCHEMA)
    assert sorted(r["t"] for r in traffic.debounce(df, ["user_id"], "t", "event_id", 300).collect()) == [350, 900]
    rows = arrivals(9, n=300)
    expected = set()
    for events in by_user(rows).values():
        for a, b in zip(events, [*events[1:], (10**9, 0)]):
            if b[0] - a[0] >= 5:
                expected.add(a[1])
    out = traffic.debounce(spark.createDataFrame(rows, SCHEMA), ["user_id"], "t", "event_id", 5)
    assert {r["event_id"] for r in out.collect()} == expected


@pytest.mark.parametrize("slice_rows", [3, 50, 10**6])
def test_last_before_crosses_slices(spark, slice_rows):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.7 else "m", rng.randrange(100000), i, rng.choice([None, None, str(i)]))
            for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v string")
    out = {r["i"]: r["before"] for r in last_before(df, "k", "t", "i", "v", "before", slice_rows).collect()}
    for k, t, i, _ in rows:
        earlier = [(a, b, v) for q, a, b, v in rows if q == k and (a, b) < (t, i) and v is not None]
        assert out[i] == (max(earlier)[2] if earlier else None)


def test_session_gate(spark):
    auth = spark.createDataFrame([(1, 5, 100, "in"), (1, 20, 101, "out"), (2, 1, 102, "in")], "user_id int, t long, event_id long, status string")
    asked = spark.createDataFrame([(1, 4, 0), (1, 6, 1), (1, 21, 2), (2, 9000, 3), (3, 7, 4)], "user_id int, t long, event_id long")
    assert sorted(r["event_id"] for r in session_gate(asked, auth, rows=1).collect()) == [1, 3]


def test_token_validity(spark):
    tokens = spark.createDataFrame([(1, 0, 50)], "user_id int, t long, event_id long")
    asked = spark.createDataFrame([(1, 0, 1), (1, 3599, 2), (1, 3600, 3), (2, 5, 4)], "user_id int, t long, event_id long")
    out = token_validity(asked, tokens, lifetime=3600, rows=1)
    assert {r["event_id"]: r["valid"] for r in out.collect()} == {1: True, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("rows", [5, 10**6])
def test_look_back_with_negative_times_and_a_missing_hot_key(spark, rows):
    asked = [(None, -100 + 2 * i, i, f"v{i}" if i % 7 == 0 else None) for i in range(50)]
    asked += [(3, t, 100 + t, "w" if t == -1 else None) for t in (-1, 0, 5)]
    df = spark.createDataFrame(asked, "k int, t long, id long, v string")
    got = {r["id"]: r["last"] for r in last_before(df, "k", "t", "id", "v", "last", rows).collect()}
    want = {i: f"v{(i - 1) // 7 * 7}" if i else None for i in range(50)} | {99: None, 100: "w", 105: "w"}
    assert got == want


def test_many_hot_keys(spark):
    """More hot keys than are sent to every task: none is left out."""
    df = spark.range(60000).selectExpr("id % 20000 AS k", "id AS t", "id", "id DIV 20000 AS v")
    found = last_before(df, "k", "t", "id", "v", "last", 2)
    assert found.where("coalesce(last, -1) <> v - 1").count() == 0 and found.count() == 60000


def test_register(spark):
    known = spark.createDataFrame([("a",)], "username string")
    tries = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("b", 1, 2), ("c", 1, 3)], "username string, ts int, event_id int")
    assert {r["event_id"]: r["created"] for r in register(known, tries).collect()} == {0: False, 1: False, 2: True, 3: True}


def test_cache(spark):
    asked = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("b", 3, 2)], "key string, ts int, event_id int")
    cached = spark.createDataFrame([("a", "old")], "key string, result string")
    out = traffic.cache_lookup(asked, cached, ["key"], ["ts"], "event_id", F.upper("key"))
    assert {(r["event_id"], r["hit"], r["computes"], r["result"]) for r in out.collect()} == {
        (0, True, False, "old"), (1, False, True, "B"), (2, False, False, "B")}


def test_cache_with_missing_keys_and_stored_nulls(spark):
    asked = spark.createDataFrame([(None, 1, 0), (None, 2, 1), ("n", 3, 2), ("x", 4, 3)], "key string, ts int, event_id int")
    cached = spark.createDataFrame([("n", None)], "key string, result string")
    out = traffic.cache_lookup(asked, cached, ["key"], ["ts"], "event_id", F.lit("new"))
    assert {(r["event_id"], r["hit"], r["computes"], r["result"]) for r in out.collect()} == {
        (0, False, True, "new"), (1, False, False, "new"), (2, True, False, None), (3, False, True, "new")}


def test_user_table(spark, tmp_path):
    path = str(tmp_path / "users")
    tries = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "username string, ts int, event_id int")
    append_users(register(spark.createDataFrame([], "username string"), tries), path)
    found = lookup_users(spark.read.parquet(path), ["b", "x"])
    assert [(r["username"], r["event_id"]) for r in found.collect()] == [("b", 2)]
    assert "In(username" in found._jdf.queryExecution().toString()
