"""Benchmark items on either side of 256 words, against the registered SQL."""

import random

import duckdb

from codeloom.llm.queries import ORACLES, QUERIES


def test_long_items_agree_with_the_sql(spark, tmp_path):
    draw = random.Random(11)
    words = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    fill = lambda n: words(n)
    items = [words(n) for n in (40, 256, 257, 300, 700)]
    items.append(items[3][:250] + words(60))  # shares most of another long item
    items.append((words(12) * 40)[:400])  # the same shingles many times
    docs = []
    for item in items:
        n = len(item)
        docs += [fill(30) + item + fill(20), fill(10) + item[: n // 2 + 1], fill(9) + item[: n * 85 // 100] + fill(40), item[n // 5 :]]
        docs.append([w if i % 40 else "other" for i, w in enumerate(item)] + fill(5))
        docs.append(item[: n // 2] + fill(6) + item[n // 2 :] + fill(300) + item[3:])
    docs += [items[6] + items[6][:200], fill(600), []]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op8_benchmark_leaks"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = {(d, i): round(s, 9) for d, i, s in con.execute(ORACLES["op8_benchmark_leaks"]).fetchall()}
    assert got == want
    assert (0, 0) in got and (18, 3) in got and (19, 3) not in got  # the whole of 300 words, and half of them
