"""The pipeline against what brute force keeps at each stage."""

import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from brute import near_components

from codeloom.llm import bpe


def test_pipeline(spark, tmp_path):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    base, item = text(120), text(30)
    docs = [(i, text(40 + i)) for i in range(40)]
    docs += [(100, base), (101, base + " tail"), (102, base.replace(" ", "  ")), (103, None), (104, " 12 -- 3"), (105, "")]
    docs += [(106, text(20) + " " + item + " " + text(20)), (107, "Short."), (None, "no id here"), (5, docs[5][1]), (200, base + " tail")]
    rows = [(i, t, "en" if (i or 0) % 3 else None, "src", len(t or ""), "extra") for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {i: t for i, t in docs if i is not None and any(c.isalpha() for c in t or "")}
    seen = {}
    for i in sorted(left):
        seen.setdefault(" ".join(left[i].split()), i)
    left = {i: left[i] for i in seen.values()}
    left = {i: left[i] for i, (_, c) in near_components(left, 5, 80).items() if c == i}
    del left[106]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in got.items()} == left
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in ranks.items()}, special_tokens={})
    assert all(r.ids == own.encode_ordinary(left[k]) and r.n_tokens == len(r.ids) and r.lang == "en" for k, r in got.items())


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
