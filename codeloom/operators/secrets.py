"""Credentials left in texts: one pass of all rules' patterns over a text, then rules on the few hits."""

from pyspark.sql import functions as F

from codeloom.functions.text import lines

# (rule, pattern, least entropy in bits a character). Patterns stay within one line and have no groups
# that capture; the value is what VALUE finds in the hit. The first rule that fits a hit names it.
SECRET_RULES = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0.0),
    ("access_key_id", r"(?:AKIA|ASIA)[0-9A-Z]{16}", 2.5),
    ("hosted_token", r"gh[opsu]_[A-Za-z0-9]{36}", 3.0),
    ("assigned", r"(?i:api_?key|passwd|password|secret|token)[ \t]*[:=][ \t]*[\"'][!#-&(-~]{8,}[\"']", 3.0),
]
QUOTED = r"[\"'][!#-&(-~]{8,}[\"']$"


def all_patterns(rules=None):
    """One pattern that finds what any rule finds."""
    return "|".join(f"(?:{pattern})" for _, pattern, _ in rules or SECRET_RULES)


def entropy(value):
    """Shannon entropy of the characters of a text, in bits a character; 0 without characters."""
    marks = F.filter(F.split(value, ""), lambda c: c != "")
    size = F.size(marks).cast("double")

    def part(total, c):
        share = F.size(F.filter(marks, lambda x: x == c)) / size
        return total - share * F.log2(share)

    return F.aggregate(F.array_sort(F.array_distinct(marks)), F.lit(0.0), part)


def secrets(df, text="text", keep=("doc_id",), rules=None):
    """(``keep``, line, place, rule, length, entropy, value_sha256, likely): one row per hit.

    ``line`` counts from 1, ``place`` from 0 within the line; ``likely`` tells that the value is as
    random as its rule asks. Values themselves are never returned. Null and empty texts have no hits;
    repeated rows and repeated values are hits of their own. Only texts that hold a hit are cut into lines.
    """
    rules = rules or SECRET_RULES
    pattern = F.lit(all_patterns(rules))
    held = df.where(F.rlike(text, pattern))
    hits = F.flatten(
        F.transform(
            lines(F.col(text)),
            lambda row, i: F.transform(
                F.regexp_extract_all(row, pattern, F.lit(0)),
                lambda hit, j: F.struct((i + 1).alias("line"), j.alias("place"), hit.alias("hit")),
            ),
        )
    )
    found = held.select(*keep, F.inline(hits))
    chain, least = F, F
    for name, own, bits in rules:
        fits = F.rlike("hit", F.lit(f"^(?:{own})$"))
        chain, least = chain.when(fits, F.lit(name)), least.when(fits, F.lit(float(bits)))
    quoted = F.regexp_extract("hit", QUOTED, 0)
    value = F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.col("hit"))
    rated = found.withColumns({"rule": chain, "_least": least, "_value": value})
    rated = rated.withColumn("entropy", F.round(entropy(F.col("_value")), 4))
    return rated.select(
        *keep, "line", "place", "rule",
        F.length("_value").alias("length"), "entropy",
        F.sha2("_value", 256).alias("value_sha256"),
        (F.col("entropy") >= F.col("_least")).alias("likely"),
    )


def secret_summary(hits, by="source"):
    """Hits, likely hits and different values per group and rule."""
    return hits.groupBy(by, "rule").agg(
        F.count("*").alias("hits"),
        F.count_if("likely").alias("likely"),
        F.count_distinct("value_sha256").alias("different"),
    )
