"""Interval, word-set and rule joins against plain loops; the bucketed user table."""

import random
import re

from pyspark.sql import functions as F

from codeloom.operators import matching
from codeloom.operators.intervals import interval_join, live_tokens
from codeloom.operators.matching import first_fitting, fixes_by_table, relevant_pairs
from codeloom.sources.users import UserTable


def test_interval_join_against_between(spark):
    draw = random.Random(1)
    spans = []
    for i in range(400):
        start = draw.randrange(-5000, 100_000)
        spans.append((draw.choice(["hot", "hot", "hot", "a", None]), i, start, start + draw.choice([0, 1, 5, 64, 700, 90_000, -3])))
    spans += [("a", 1000, None, 5), ("a", 1001, 5, None)]
    points = [(draw.choice(["hot", "hot", "a", "b", None]), i, draw.randrange(-6000, 200_000)) for i in range(600)] + [("hot", 999, None), ("hot", 3, 50)]
    left = spark.createDataFrame(points, "user string, id long, t long")
    right = spark.createDataFrame(spans, "user string, span long, start long, end long")
    expected = sorted(
        (i, t, s) for u, i, t in points for v, s, a, b in spans if u == v and None not in (t, a, b) and a <= t < b
    )
    found = interval_join(left, right, "user", base=16)
    assert sorted((r.id, r.t, r.span) for r in found.collect()) == expected
    kept = interval_join(left, right, "user", base=16, how="left").collect()
    assert sorted((r.id, r.t, r.span) for r in kept if r.span is not None) == expected
    assert len([r for r in kept if r.span is None]) == len(points) - len({(i, t) for i, t, _ in expected})
    assert interval_join(left, right.limit(0), "user").count() == 0 and interval_join(left.limit(0), right, "user").count() == 0


def test_a_span_lies_in_two_bins_at_most(spark):
    spans = [(1, i, s, s + n) for i, (s, n) in enumerate([(0, 1), (15, 2), (7, 10**12), (-9, 17), (31, 32)])]
    right = spark.createDataFrame(spans, "user long, span long, start long, end long")
    points = spark.createDataFrame([(1, 0, s + n - 1) for _, _, s, n in [(0, 0, s, e - s) for _, _, s, e in spans]], "user long, id long, t long")
    plan = interval_join(points, right, "user", base=16)
    assert {r.span for r in plan.collect()} == {0, 1, 2, 3, 4}


def test_live_tokens(spark):
    tokens = [("a", 1, 10, 100, None), ("a", 2, 20, 5, None), ("a", 3, 20, 100, 22), ("b", 4, 0, 1, None)]
    requests = [("a", 1, 9), ("a", 2, 10), ("a", 3, 21), ("a", 4, 22), ("a", 5, 110), ("b", 6, 0), ("c", 7, 0), (None, 8, 0)]
    found = live_tokens(
        spark.createDataFrame(requests, "user_id string, event_id long, t long"),
        spark.createDataFrame(tokens, "user_id string, token long, issued long, lifetime long, revoked long"), base=4,
    )
    got = {r.event_id: (r.live, r.token) for r in found.collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (3, 3), 4: (2, 2), 5: (0, None), 6: (1, 4), 7: (0, None), 8: (0, None)}


def test_relevant_pairs_against_all_pairs(spark):
    draw = random.Random(3)
    common, rare = [f"the{i}" for i in range(5)], [f"rare{i}" for i in range(300)]
    text = lambda n: " ".join(draw.choice(common if draw.random() < 0.7 else rare) for _ in range(n))
    prompts = [(i, text(draw.randrange(60))) for i in range(150)] + [(900, None), (901, "")]
    completions = [(i, text(draw.randrange(1, 9))) for i in range(120)] + [(900, None), (901, ""), (902, "the0 the1"), (903, "unseen words")]
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    for share in (0.5, 0.8, 1.0):
        expected = set()
        for i, p in prompts:
            for j, c in completions:
                n, both = len(words(c)), len(words(p) & words(c))
                if n and both >= share * n - 1e-9:
                    expected.add((i, j, both))
        found = relevant_pairs(
            spark.createDataFrame(prompts, "prompt_id long, text string"), spark.createDataFrame(completions, "completion_id long, text string"), share
        )
        assert {tuple(r) for r in found.collect()} == expected and len(expected) > 50


RULES = "ord long, fragments array<string>, template string"


def test_ten_thousand_rules(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(1, 5)))
    rules = [(i, [word() + " " + word(), word()][: draw.randint(1, 2)], f"rule {i} at {{line}}") for i in range(10_000)]
    draw.shuffle(rules)
    messages = [" ".join(word() for _ in range(draw.randint(0, 8))) for _ in range(300)] + [None, ""]
    found = first_fitting(spark.createDataFrame([(m,) for m in messages * 3], "message string"), spark.createDataFrame(rules, RULES))
    got = {r.message: (r.ord, r.template) for r in found.collect()}
    expected = {}
    for m in filter(lambda m: m is not None, messages):
        fits = [(o, t) for o, fragments, t in rules if all(f in m for f in fragments)]
        if fits:
            expected[m] = min(fits)
    assert got == expected and len(expected) > 50


def test_rules_with_short_missing_and_no_fragments(spark):
    rules = [(5, [], "any {line}"), (4, ["x"], "x"), (3, [None, "abc"], "null"), (2, ["ab", ""], "ab"), (1, ["never seen"], "n"), (0, ["abc", "zz"], "both")]
    df = spark.createDataFrame(rules, RULES)
    issues = spark.createDataFrame([("zz abc", 1), ("aabb", 2), ("xyz", 3), ("", 4), (None, 5), ("q", None)], "message string, line long")
    got = {(r.message, r.fix) for r in fixes_by_table(issues, df).collect()}
    assert got == {("zz abc", "both"), ("aabb", "ab"), ("xyz", "x"), ("", "any 4"), ("q", "any ")}
    assert first_fitting(issues, df.limit(0)).count() == 0 and first_fitting(issues.limit(0), df).count() == 0


def test_rules_in_rounds_store_no_runs(spark, monkeypatch):
    """No stored table is longer than messages and rules; later rounds see what is left."""
    draw, stored = random.Random(5), []
    letters = "abcdefgh"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    messages = [" ".join(word(draw.randint(2, 6)) for _ in range(60)) for _ in range(120)]
    rules = [(i, [word(draw.randint(2, 5)), word(2)], f"t{i}") for i in range(400)]
    rules += [(1000 + i, list(reversed(f)), "later") for i, f, _ in rules] + [(None, ["a"], "no ord")]
    expected = {m: min((o, t) for o, f, t in rules if o is not None and all(x in m for x in f)) for m in messages}
    kept = matching.materialise
    monkeypatch.setattr(matching, "materialise", lambda df, name: stored.append((name, kept(df, name))) or stored[-1][1])
    monkeypatch.setattr(matching, "FIRST_RULES", 5, raising=False)
    found = first_fitting(spark.createDataFrame([(m,) for m in messages], "message string"), spark.createDataFrame(rules, RULES))
    assert {r.message: (r.ord, r.template) for r in found.collect()} == expected
    assert len({o for o, _ in expected.values()}) > 5 and max(o for o, _ in expected.values()) > 5
    assert max(df.count() for _, df in stored) <= max(len(rules), len(letters) ** 3 * 2)
    assert sum(name == "decided" for name, _ in stored) > 1


def test_user_table(spark, tmp_path):
    schema, path = "username string, secret_digest string", str(tmp_path / "users")
    jobs = [[(1, "ann"), (2, "bob"), (3, "ann"), (4, None)], [(5, "bob"), (6, "cid"), (7, None)], []]
    made = []
    for n, rows in enumerate(jobs):
        table = UserTable(spark, f"t_users_{n}", path, schema, buckets=4)  # declared anew by each job
        done = table.attempts(spark.createDataFrame(rows, "event_id long, username string"), order=["event_id"])
        made += [r.event_id for r in done.collect() if r.created]
        table.add(done.withColumn("secret_digest", F.lit(f"s{n}")))
    assert sorted(made) == [1, 2, 6]
    table = UserTable(spark, "t_users_9", path, schema, buckets=4)
    assert sorted(tuple(r) for r in table.rows().collect()) == [("ann", "s0"), ("bob", "s0"), ("cid", "s1")]
    assert [tuple(r) for r in table.lookup(["cid"]).collect()] == [("cid", "s1")]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not show buckets
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan_of(table.lookup(["cid"]))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    asked = spark.createDataFrame([(1, "ann"), (2, "zoe"), (3, None)], "event_id long, username string")
    assert sorted((r.event_id, r.secret_digest) for r in table.with_users(asked, "secret_digest").collect()) == [(1, "s0"), (2, None), (3, None)]
    for df in (table.with_users(asked, "secret_digest"), table.attempts(asked, order=["event_id"])):
        above = operators_between_join_and_stored_table(plan_of(df))
        assert above and not any("Exchange" in line for line in above)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators_between_join_and_stored_table(plan):
    lines = plan.splitlines()
    depth = lambda line: max(line.find("+-"), line.find(":-"))
    at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
    found, level = [], depth(lines[at])
    while "Join" not in lines[at]:
        at -= 1
        if depth(lines[at]) < level:
            level = depth(lines[at])
            found.append(lines[at])
    return found
