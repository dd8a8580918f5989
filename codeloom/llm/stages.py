"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame, the columns of documents except at the end."""

import public_tokenizers
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontaminate, exact, langid, near
from codeloom.llm.common import free_name


def language(spark, docs, sf_dir):
    """Drops documents whose text is null or has no letter; fills in a language that is not given.

    Languages are learned from ``docs`` itself; ``und`` is filled in if none is given at all. Rows
    without an id go.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predict(docs, langid.train(docs), keep=docs.columns, names=names)
    lang = F.coalesce("lang", names[0]).alias("lang")
    letter = (F.col(names[0]) != langid.UNKNOWN) | F.col("text").rlike(r"\p{L}")
    return found.where(letter).select(*[lang if c == "lang" else F.col(c) for c in docs.columns])


def row_key(docs):
    """Column that tells rows of different texts apart and sorts like doc_id.

    doc_id itself, unless it repeats; then a string of doc_id and a hash of the text.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return F.col("doc_id")
    own = F.col("doc_id").cast("string")
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        number = F.col("doc_id").cast("bigint")  # hexadecimal digits with the sign turned sort like numbers
        own = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(own, F.lit("\0"), F.sha2(F.col("text").cast("binary"), 256))


def exact_copies(spark, docs, sf_dir):
    """Keeps the row with the smallest doc_id of equal texts; of rows repeated with that id and text, one."""
    found, own = exact.exact_duplicates(docs), free_name(docs, "_text")
    keep = found.where("kept").select(F.col("id").alias("doc_id"), F.col("text_sha256").alias(own)).distinct()
    digest = F.sha2(exact.normal(F.col("text").cast("string")).cast("binary"), 256)
    rows = docs.withColumn(own, digest).join(keep, ["doc_id", own], "left_semi")
    return rows.dropDuplicates([own]).select(*docs.columns)


def near_copies(spark, docs, sf_dir):
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8), the smallest doc_id.

    Different texts under one doc_id are documents of their own.
    """
    own = free_name(docs, "_row")
    rows = docs.withColumn(own, row_key(docs))
    found = near.near_duplicates(rows, key=own, words=5, percent=80)
    keep = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(own)).distinct()
    return rows.join(keep, own, "left_semi").select(*docs.columns)


def benchmark_leaks(spark, docs, sf_dir):
    """Drops documents that hold a passage of the benchmark; other texts under their doc_id stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = free_name(docs, "_row")
    rows = docs.withColumn(own, row_key(docs))
    leaked = decontaminate.leaks(rows, benchmark, key=own).select(F.col("id").alias(own)).distinct()
    return rows.join(leaked, own, "left_anti").select(*docs.columns)


def tokens(spark, docs, sf_dir):
    """Adds token ids and the decoded text: doc_id, lang, source, ids, n_tokens, text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "lang", "source", "text")
    back = bpe.decode(bpe.encode(rows, ranks, public_tokenizers.PATTERN), ranks)
    return back.select(
        "doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), F.col("decoded").cast("string").alias("text")
    )
