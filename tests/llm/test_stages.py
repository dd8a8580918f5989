"""Pipeline stages keep clean documents: without given languages, and different texts under one id."""

import random

from codeloom.llm import stages

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "src", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def kept(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_language_without_any_given(spark):
    rows = [(1, "some words"), (2, "слова"), (3, None), (4, "12 -- 3"), (5, "")]
    found = stages.language(spark, table(spark, rows), None)
    assert kept(found) == rows[:2]
    named = table(spark, rows).selectExpr("doc_id", "text", "if(doc_id = 1, 'und', null) AS lang", "source", "n_chars")
    assert kept(stages.language(spark, named, None)) == rows[:2]


def test_texts_that_share_an_id(spark, tmp_path):
    draw = random.Random(5)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    base, item, alone, other = text(120), text(30), text(90), text(80)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda stage, rows: kept(stage(spark, table(spark, rows), str(tmp_path)))
    assert run(stages.exact_copies, [(-3, base), (5, base), (5, alone), (5, alone), (5, other)]) == sorted([(-3, base), (5, alone), (5, other)])
    rows = [(-3, base), (5, base + " tail"), (5, alone), (40, other), (5, other + " end"), (-70, "x " + base)]
    assert run(stages.near_copies, rows) == sorted([(-70, "x " + base), (5, alone), (5, other + " end")])
    leak = text(20) + " " + item + " " + text(9)
    assert run(stages.benchmark_leaks, [(7, leak), (7, alone), (8, other)]) == sorted([(7, alone), (8, other)])
