"""Corpus-wide summaries of the per-file features and issues."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import lines
from codeloom.operators.analysis import count_of, report, security_issues
from codeloom.operators.features import of_kind


def import_usage(features, n=20):
    """Files and statements per import entry, most used first.

    Entries are counted inside the file first, so neither a distinct count nor a file key has
    to go through the shuffle.
    """
    names = F.transform(of_kind("import"), lambda f: f["name"])
    per_file = features.select(names.alias("names")).select(
        F.explode(
            F.transform(
                F.array_distinct("names"),
                lambda m: F.struct(
                    m.alias("module"), F.size(F.filter("names", lambda x: x == m)).alias("k")
                ),
            )
        ).alias("m")
    )
    counted = per_file.groupBy("m.module").agg(
        F.count("*").alias("files"), F.sum("m.k").alias("statements")
    )
    return counted.orderBy(F.desc("files"), "module").limit(n)


def syntax_failures(features):
    """Share of files per source that do not parse."""
    failed = (~F.col("valid")).cast("int")
    return features.groupBy("source").agg(
        F.count("*").alias("files"), F.sum(failed).alias("failed"), F.avg(failed).alias("rate")
    )


def error_classes(features):
    failed = features.where(~F.col("valid"))
    return failed.groupBy("error_class").agg(F.count("*").alias("files"))


def documentation(features):
    """Docstring and decorator coverage of functions and classes per source."""
    named = features.select("source", F.inline("facts")).where(
        F.col("kind").isin("function", "class")
    )
    decorated = (F.col("kind") == "function") & (F.size("extra") > 0)
    return named.groupBy("source", "kind").agg(
        F.count("*").alias("n"),
        F.avg(F.col("docstring").isNotNull().cast("int")).alias("documented"),
        F.avg(decorated.cast("int")).alias("decorated"),
    )


def issue_hotspots(analysed, code="text"):
    """Issues per 1,000 lines by language and category, ranked.

    One aggregate by language; the ranking sees languages x categories rows only.
    """
    per_language = analysed.groupBy("language").agg(
        F.sum(F.size(lines(F.col(code)))).alias("lines"),
        *[F.sum(count_of(c)).alias(c) for c in params.ISSUE_CATEGORIES],
    )
    long = per_language.unpivot(["language", "lines"], params.ISSUE_CATEGORIES, "category", "issues")
    rated = long.where(F.col("issues") > 0).withColumn(
        "per_thousand", F.col("issues") * 1000.0 / F.col("lines")
    )
    return rated.withColumn("rank", F.rank().over(Window.orderBy(F.desc("per_thousand"))))


def depth_histogram(features):
    valid = features.where("valid")
    return valid.groupBy("depth", "depth_full").agg(F.count("*").alias("files"))


def score_distribution(scored):
    """Mean and median score per source; the exact median keeps one count per distinct score."""
    return scored.groupBy("source").agg(
        F.count("*").alias("files"),
        F.avg("score").alias("mean"),
        F.percentile("score", F.lit(0.5)).alias("median"),
    )


def unsafe_files(analysed, keep=("doc_id", "path")):
    """Files with unsafe calls or imports and their report text."""
    flagged = F.exists("issues", lambda i: i["source"].isin("call", "import"))
    return analysed.where(flagged).select(*keep, report(security_issues()).alias("report"))
