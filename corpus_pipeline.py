"""Cleans a corpus of documents in stages; each calls one operator of ``codeloom.llm``."""

from codeloom.llm import stages
from codeloom.session import run_dir

STAGES = [
    ("language", stages.language),
    ("exact", stages.exact_copies),
    ("near", stages.near_copies),
    ("benchmark", stages.benchmark_leaks),
    ("tokens", stages.tokens),
]

#: Classifiers, MinHash groups and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over documents; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = run_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
