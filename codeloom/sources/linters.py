"""Linter output as issues: one parser per documented text format.

Every parser adds (category, line, col, message, bad) to its input rows and keeps only rows the
format counts as issues; ``bad`` marks a row whose numbers or fields could not be read.
"""

from pyspark.sql import functions as F

from codeloom import params

BANDIT_SCHEMA = "results array<struct<issue_text:string,line_number:int>>"
SPACES = " \t\r\n"


def strip(text):
    return F.btrim(text, F.lit(SPACES))


def as_int(text):
    return text.try_cast("int")


def issues(rows, category, line, col, message):
    """Add the issue columns; a missing part marks the row as bad."""
    parsed = rows.select(
        "*",
        category.alias("category"),
        line.alias("line"),
        col.alias("col"),
        message.alias("message"),
    )
    missing = F.col("line").isNull() | F.col("col").isNull() | F.col("message").isNull()
    return parsed.withColumn("bad", missing)


def pylint(rows, raw="raw"):
    """``E:line:col:message`` is an error, ``W:…`` a warning, anything else is skipped."""
    text = F.col(raw)
    kept = rows.where(F.startswith(text, F.lit("E:")) | F.startswith(text, F.lit("W:")))
    parts = F.split(text, ":")
    category = F.when(F.startswith(text, F.lit("E:")), "errors").otherwise("warnings")
    return issues(kept, category, as_int(F.get(parts, F.lit(1))), as_int(F.get(parts, F.lit(2))),
                  strip(F.get(parts, F.lit(3))))


def pyflakes(rows, line="line_no", col="column", message="text"):
    """Records (line, column, message): warnings."""
    renamed = rows.select(
        "*", F.col(line).cast("int").alias("_l"), F.col(col).cast("int").alias("_c"), F.col(message).alias("_m")
    )
    return issues(renamed, F.lit("warnings"), F.col("_l"), F.col("_c"), F.col("_m")).drop("_l", "_c", "_m")


def style(rows, line="line_no", offset="offset", code="code", text="text"):
    """Records (line, 0-based offset, code, text): style issues ``code: text``."""
    message = F.concat_ws(": ", code, text)
    return issues(rows, F.lit("style_issues"), F.col(line).cast("int"),
                  F.col(offset).cast("int") + 1, message)


def eslint(rows, raw="raw"):
    """``line:column:message``: warnings; further colons belong to the message."""
    pattern = r"^([^:]*):([^:]*):(.*)$"
    part = [F.regexp_extract(raw, pattern, i) for i in (1, 2, 3)]
    fits = F.rlike(raw, F.lit(pattern))
    return issues(rows, F.lit("warnings"), as_int(strip(part[0])), as_int(strip(part[1])),
                  F.when(fits, strip(part[2])))


def checkstyle(rows, raw="raw"):
    """Lines starting with ERROR or WARNING, fields 1, 2 and 3: warnings."""
    text = F.col(raw)
    kept = rows.where(F.startswith(text, F.lit("ERROR")) | F.startswith(text, F.lit("WARNING")))
    parts = F.split(text, ":")
    return issues(kept, F.lit("warnings"), as_int(strip(F.get(parts, F.lit(1)))),
                  as_int(strip(F.get(parts, F.lit(2)))), strip(F.get(parts, F.lit(3))))


def ruby(rows, raw="raw"):
    """Every line is a message without position: an error."""
    return issues(rows, F.lit("errors"), F.lit(0), F.lit(0), F.col(raw))


def compiler(rows, raw="raw"):
    """``file:line:col: message`` of the Go and Rust tools: errors, with ``file``."""
    parts = F.split(F.col(raw), ":")
    rest = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), ":")
    named = rows.withColumn("file", F.get(parts, F.lit(0)))
    return issues(named, F.lit("errors"), as_int(strip(F.get(parts, F.lit(1)))),
                  as_int(strip(F.get(parts, F.lit(2)))), strip(rest))


def bandit(rows, raw="raw", error="error"):
    """JSON reports: one row per result; one error row for an unreadable report.

    Output is read whatever the exit status, since the tool also fails when it finds issues.
    """
    def found(issue_type, line, message):
        return F.struct(
            F.lit("security_issues").alias("category"),
            F.lit(issue_type).alias("issue_type"),
            line.alias("line"),
            F.lit(0).alias("col"),
            message.alias("message"),
        )

    results = F.transform(
        F.coalesce(F.from_json(raw, BANDIT_SCHEMA)["results"], F.array()),
        lambda r: found(params.BANDIT_ISSUE, r["line_number"], r["issue_text"]),
    )
    failed = F.array(
        found(params.BANDIT_ERROR, F.lit(0), F.concat(F.lit(params.BANDIT_ERROR_TEXT), error))
    )
    unreadable = F.array(
        found(params.BANDIT_PARSING_ERROR, F.lit(0), F.lit(params.BANDIT_PARSING_TEXT))
    )
    listed = (
        F.when(F.try_parse_json(raw).isNotNull(), results)
        .when(F.length(error) > 0, failed)
        .otherwise(unreadable)
    )
    return rows.select("*", F.inline(listed))
