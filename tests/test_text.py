"""Positions, words, scores and messages on small inputs."""

import json
import math
from collections import Counter

from pyspark.sql import functions as F

from codeloom.functions import scoring
from codeloom.functions.text import is_relevant, keywords, prefix_context, surrounding_lines, words
from codeloom.operators.analysis import diagnostic, issue_label, report, suggested_fix, text_rule_issues
from codeloom.operators import serving
from codeloom.operators.candidates import rank
from codeloom.operators.ngrams import Bigrams, log_softmax, truncate
from codeloom.operators.users import merged_map, profile_vector
from codeloom.sources.tables import notification, write_notifications


def one(spark, value, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(value.alias("v")).first()["v"]


def test_prefix_and_surroundings(spark):
    cut = prefix_context(F.col("t"), F.lit(1), F.lit(2))
    assert one(spark, cut, t="ab\ncdef") == "ab\ncd"
    assert one(spark, prefix_context(F.col("t"), F.lit(9), F.lit(2)), t="ab\ncdef") == "ab\ncd"
    text = "\n".join("l%d" % i for i in range(6))
    assert one(spark, surrounding_lines(F.col("t"), F.lit(0)), t=text) == "l0\nl1\nl2"
    assert one(spark, surrounding_lines(F.col("t"), F.lit(5)), t=text) == "l3\nl4\nl5"
    assert one(spark, surrounding_lines(F.col("t"), F.lit(30)), t=text) == ""


def test_words_are_unicode(spark):
    assert one(spark, words(F.col("t")), t="Été_1, x-y: ÉTÉ_1!") == ["été_1", "x", "y", "été_1"]
    assert one(spark, F.size(keywords(F.col("t"))), t="a A b") == 2
    assert one(spark, words(F.col("t")), t="") == []
    assert one(spark, is_relevant(F.col("a"), F.col("b")), a="open file", b="close FILE") is True


def test_style(spark):
    assert one(spark, scoring.style_score(F.col("t")), t="    x = 1\n\n\ty") == 1.0
    assert one(spark, scoring.style_score(F.col("t")), t="É") == 0.0
    assert one(spark, scoring.style_score(F.col("t")), t="éa") == 0.0  # a is inside a word
    assert one(spark, scoring.has_dangerous_text(F.col("t")), t="x = eval(y)") is True


def test_scores(spark):
    def score(valid):
        return scoring.completion_score(F.lit(True), F.col("t"), F.lit(valid), F.lit(0))

    assert one(spark, score(True), t="# only a comment") == 4.5
    assert one(spark, score(True), t="    # only a comment") == 5.0
    assert one(spark, score(False), t="x") == 0.0


def test_fixes_first_rule_wins(spark):
    def fix(message):
        return one(spark, suggested_fix(F.col("m"), F.lit(4)), m=message)

    assert fix("Bare except clause") == "Specify an exception to catch on line 4, e.g., 'except Exception:'"
    assert fix("Empty except clause") == "Add a specific exception to catch on line 4"
    assert fix("SyntaxError: invalid syntax") == "Review the line for typos or missing colons"
    assert fix("SyntaxError: '(' was never closed").startswith("Check for unclosed")
    assert fix("invalid syntax") is None


def test_diagnostic_and_label(spark):
    shown = one(spark, diagnostic(F.lit(3), F.lit(5), F.col("m")), m="Error: x").asDict()
    assert shown == dict(start_line=2, start_character=4, end_line=2, end_character=5, severity="Error", message="Error: x")
    assert one(spark, issue_label(F.lit(2))) == "(2 issues) " and one(spark, issue_label(F.lit(0))) == ""


def test_report(spark):
    kind = "array<struct<issue_type:string,line:int,col:int,message:string>>"
    rows = spark.createDataFrame([([("A", 1, 2, "m"), ("B", 3, 4, "n")],), ([],)], f"i {kind}")
    full, empty = [r[0] for r in rows.select(report(F.col("i"))).collect()]
    assert full == (
        "Security Analysis Report:\n\n1. A (Line 1, Column 2):\n   m\n\n2. B (Line 3, Column 4):\n   n\n\n"
        "Total issues found: 2"
    )
    assert empty == "No security issues found."


def test_text_rules_report_positions_across_lines(spark):
    code = "let a = 1;\nlet b;\ntry {\n  c();\n}\nvar d;"
    found = one(spark, text_rule_issues(F.col("t"), F.lit("javascript")), t=code)
    assert [(i["message"], i["line"], i["col"]) for i in found] == [
        ("Variable 'b' declared but not initialized", 2, 4),
        ("Variable 'd' declared but not initialized", 6, 4),
        ("Empty try block", 3, 0),
    ]


def test_truncation(spark):
    rows = spark.createDataFrame([("g", "a", 4), ("g", "b", 3), ("g", "c", 2), ("g", "d", 1)], "g string, i string, w long")
    kept = {r["i"]: round(r["p"], 6) for r in truncate(rows, ["g"], "w", "i", k=3, p=0.6).collect()}
    assert kept == {"a": 0.571429, "b": 0.428571}


def test_log_softmax(spark):
    rows = spark.createDataFrame([(1, "a", 800.0), (1, "b", 801.0), (2, "a", -5.0)], "g int, tok string, x double")
    out = {(r["g"], r["tok"]): r["logp"] for r in log_softmax(rows, ["g"], "x").collect()}
    assert math.isclose(out[1, "a"], -1 - math.log(1 + math.exp(-1)), rel_tol=1e-9)
    assert out[2, "a"] == 0.0


def test_bigram_model(spark):
    corpus = spark.createDataFrame([("a b a b a c",)], "text string")
    model = Bigrams.train(corpus)
    items = spark.createDataFrame([(1, "a b"), (2, "z z")], "id int, text string")
    scores = {r["id"]: r["score"] for r in model.score(items, ["id"], "text").collect()}
    assert math.isclose(scores[1], math.log((2 + 1) / (3 + 3)))
    assert math.isclose(scores[2], math.log(1 / 3))
    best = model.extend(items, ["id"], "text", steps=2, beams=2).collect()
    assert [(r["id"], r["rank"], r["completion"]) for r in best] == [(1, 1, "a b"), (1, 2, "a c")]


def test_ranking_is_stable(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.1)], "r int, c int, score double")
    assert [x["c"] for x in rank(rows, ["r"], "c", n=3).orderBy("rank").collect()] == [2, 1, 3]


def test_maps(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), ({}, {})], "p map<string,string>, q map<string,string>")
    full, empty = rows.select(
        merged_map(F.col("p"), F.col("q")).alias("m"), profile_vector(F.col("p"), F.col("q")).alias("v")
    ).collect()
    assert full["m"] == {"a": "1", "b": "3"}
    assert [e["key"] for e in full["v"]] == ["a", "b"]
    assert math.isclose(sum(e["x"] ** 2 for e in full["v"]), 1.0)
    assert empty["v"] is None


def test_notifications(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "n int, label string")
    out = rows.withColumn("message", notification("log", n=F.col("n"), label=F.col("label")))
    write_notifications(out, "message", str(tmp_path / "out"))
    (text,) = [p.read_bytes() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    assert text.endswith(b"\r\n")
    assert json.loads(text) == {"jsonrpc": "2.0", "method": "log", "params": {"n": 1, "label": "x"}}


def test_requests_are_spread(spark):
    texts = spark.createDataFrame([(1, "a b\nc d"), (1, "e\nf"), (2, "g"), (3, "h"), (None, "i")], "doc_id long, text string").coalesce(1)
    asked = [(i, 1) for i in range(3000)] + [(3000, 2), (3001, None), (3002, 9), (None, 1), (None, 1)]
    requests = spark.createDataFrame(asked, "event_id long, doc_id long")
    placed = serving.place_requests(requests, texts).withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r["event_id"], r["doc_id"], r["text"]) for r in placed) == Counter(
        (e, d, t) for e, d in asked for n, t in [(1, "a b\nc d"), (1, "e\nf"), (2, "g")] if n == d
    )
    per_task = Counter(r["task"] for r in placed)
    assert max(per_task.values()) < len(placed) / 4
    cursors = requests.withColumn("line", F.lit(1)).withColumn("character", F.lit(1))
    cut = serving.contexts(cursors, texts).groupBy("prompt", "language").count().collect()
    assert {(r["prompt"], r["count"]) for r in cut} == {("a b\nc", 3002), ("e\nf", 3002), ("g", 1)}


def stored_frames(monkeypatch, module):
    """What ``module`` stores from now on, by name."""
    stored, store = {}, module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: stored.update({name: store(df, name)}) or stored[name])
    return stored


def test_inline_requests_are_spread(spark, monkeypatch):
    stored = stored_frames(monkeypatch, serving)
    asked = [(i, i % 3, "x = 1\na") for i in range(2000)]
    prompts = spark.createDataFrame(asked, "event_id long, user_id long, prompt string").withColumn("language", F.lit("python"))
    model = Bigrams.train(spark.createDataFrame([("a b a b a c",)], "text string"))
    profile = spark.createDataFrame([], "user_id long, preferences map<string,string>, coding_patterns map<string,string>")
    cached = spark.createDataFrame([], "user_id long, context string, issues string, found array<struct<rank:int,completion:string>>")
    found = serving.inline_completions(prompts, model, profile, cached).collect()
    assert sorted((r["event_id"], r["rank"], r["completion"]) for r in found) == [
        (i, n, c) for i in range(2000) for n, c in [(1, "b"), (2, "c")]
    ]
    assert sorted({r["event_id"] for r in found if r["computes"]}) == [0, 1, 2]
    per_task = stored["looked"].groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in per_task) < 500


def test_score_reads_the_counts_once_for_their_words(spark):
    model = Bigrams.train(spark.createDataFrame([("a b a b a c",)], "text string"))
    scored = model.score(spark.createDataFrame([(1, "a b")], "id int, text string"), ["id"], "text")
    assert scored._jdf.queryExecution().executedPlan().toString().count("/bigrams-") == 1
    assert math.isclose(scored.first()["score"], math.log((2 + 1) / (3 + 3)))
