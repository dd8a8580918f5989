"""Linter lines derived from table rows, read back as issues."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.plans.registry import query
from codeloom.sources import linters
from codeloom.sources.tables import read_table

PYLINT_RAW = """CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'W' ELSE 'C' END || ':' ||
  CASE WHEN l_linestatus = 'O' AND l_discount = 0.1 THEN 'x' ELSE cast(l_linenumber AS varchar(20)) END
  || ':' || cast(l_suppkey AS varchar(20)) || ': part ' || cast(l_partkey AS varchar(20)) || ' '"""


def lines_of(spark, folder, table, raw, *keep):
    return read_table(spark, folder, table).selectExpr(*keep, f"{raw} AS raw")


@query(
    "ingest_pylint",
    f"""
    WITH r AS (SELECT l_orderkey, {PYLINT_RAW} AS raw FROM lineitem),
    p AS (SELECT l_orderkey, raw, string_split(raw, ':') AS p FROM r WHERE raw LIKE 'E:%' OR raw LIKE 'W:%')
    SELECT l_orderkey, CASE WHEN raw LIKE 'E:%' THEN 'errors' ELSE 'warnings' END AS category,
           try_cast(p[2] AS int) AS line, try_cast(p[3] AS int) AS col, trim(p[4]) AS message,
           try_cast(p[2] AS int) IS NULL AS bad
    FROM p
    """,
)
def pylint(spark, folder):
    return linters.pylint(lines_of(spark, folder, "lineitem", PYLINT_RAW, "l_orderkey")).drop("raw")


@query(
    "ingest_pyflakes",
    """
    SELECT l_orderkey, 'warnings' AS category, l_linenumber::int AS line, l_suppkey::int AS col,
           'undefined name part_' || l_partkey AS message, false AS bad FROM lineitem
    """,
)
def pyflakes(spark, folder):
    records = read_table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("column"),
        F.concat(F.lit("undefined name part_"), "l_partkey").alias("text"),
    )
    return linters.pyflakes(records).drop("line_no", "column", "text")


@query(
    "ingest_style",
    """
    SELECT o_orderkey, 'style_issues' AS category, o_custkey::int AS line, (o_orderkey % 80 + 1)::int AS col,
           'E' || length(o_orderpriority) || ': ' || o_orderpriority AS message, false AS bad FROM orders
    """,
)
def style(spark, folder):
    records = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("line_no"),
        (F.col("o_orderkey") % 80).alias("offset"),
        F.concat(F.lit("E"), F.length("o_orderpriority")).alias("code"),
        F.col("o_orderpriority").alias("text"),
    )
    return linters.style(records).drop("line_no", "offset", "code", "text")


ESLINT_RAW = """CASE WHEN o_orderstatus = 'P' THEN 'summary without position' ELSE
  cast(o_custkey AS varchar(20)) || ':' || cast(o_orderkey AS varchar(20)) || ': priority: ' || o_orderpriority END"""


@query(
    "ingest_eslint",
    f"""
    WITH r AS (SELECT o_orderkey, {ESLINT_RAW} AS raw FROM orders),
    p AS (SELECT o_orderkey, raw, string_split(raw, ':') AS p FROM r)
    SELECT o_orderkey, 'warnings' AS category,
           CASE WHEN len(p) > 2 THEN p[1]::int END AS line, CASE WHEN len(p) > 2 THEN p[2]::int END AS col,
           CASE WHEN len(p) > 2 THEN trim(array_to_string(p[3:len(p)], ':')) END AS message, len(p) < 3 AS bad FROM p
    """,
)
def eslint(spark, folder):
    return linters.eslint(lines_of(spark, folder, "orders", ESLINT_RAW, "o_orderkey")).drop("raw")


CHECKSTYLE_RAW = """CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'O' THEN 'WARNING' ELSE 'INFO' END || ':' ||
  cast(o_custkey AS varchar(20)) || ':' || cast(o_orderkey AS varchar(20)) || ': missing ' || o_orderpriority || ' '"""


@query(
    "ingest_checkstyle",
    f"""
    WITH r AS (SELECT o_orderkey, {CHECKSTYLE_RAW} AS raw FROM orders),
    p AS (SELECT o_orderkey, string_split(raw, ':') AS p FROM r WHERE starts_with(raw, 'ERROR') OR starts_with(raw, 'WARNING'))
    SELECT o_orderkey, 'warnings' AS category, p[2]::int AS line, p[3]::int AS col, trim(p[4]) AS message, false AS bad FROM p
    """,
)
def checkstyle(spark, folder):
    return linters.checkstyle(lines_of(spark, folder, "orders", CHECKSTYLE_RAW, "o_orderkey")).drop("raw")


@query(
    "ingest_ruby",
    """
    SELECT p_partkey, 'errors' AS category, 0 AS line, 0 AS col, 'unused variable - ' || p_name AS message, false AS bad FROM part
    """,
)
def ruby(spark, folder):
    return linters.ruby(lines_of(spark, folder, "part", "'unused variable - ' || p_name", "p_partkey")).drop("raw")


COMPILER_RAW = """l_returnflag || '.go:' || cast(l_linenumber AS varchar(20)) || ':' || cast(l_suppkey AS varchar(20))
  || ': part: ' || cast(l_partkey AS varchar(20))"""


@query(
    "ingest_govet",
    f"""
    WITH r AS (SELECT l_orderkey, string_split({COMPILER_RAW}, ':') AS p FROM lineitem)
    SELECT l_orderkey, p[1] AS file, 'errors' AS category, p[2]::int AS line, p[3]::int AS col,
           trim(array_to_string(p[4:len(p)], ':')) AS message, false AS bad FROM r
    """,
)
def govet(spark, folder):
    return linters.compiler(lines_of(spark, folder, "lineitem", COMPILER_RAW, "l_orderkey")).drop("raw")


BANDIT_RAW = """CASE WHEN doc_id % 5 = 0 THEN '{"results": []}'
  WHEN doc_id % 5 = 1 THEN '{"results": [{"issue_text": "use of ' || source || '", "line_number": ' || cast(doc_id AS varchar(20)) || '}]}'
  WHEN doc_id % 5 = 2 THEN '{"results": [{"issue_text": "a", "line_number": 1}, {"issue_text": "' || lang || '", "line_number": 2}]}'
  ELSE 'Traceback of ' || source END"""
BANDIT_STDERR = "CASE WHEN doc_id % 5 = 4 THEN 'cannot run on ' || source ELSE '' END"


BANDIT_SQL = f"""
    WITH r AS (SELECT doc_id, {BANDIT_RAW} AS raw, {BANDIT_STDERR} AS err FROM documents),
    ok AS (SELECT doc_id, unnest(from_json(raw, '{{"results": [{{"issue_text": "VARCHAR", "line_number": "INTEGER"}}]}}').results) AS x
           FROM r WHERE json_valid(raw))
    SELECT doc_id, 'security_issues' AS category, '{params.BANDIT_ISSUE}' AS issue_type, x.line_number AS line, 0 AS col, x.issue_text AS message FROM ok
    UNION ALL
    SELECT doc_id, 'security_issues', CASE WHEN err <> '' THEN '{params.BANDIT_ERROR}' ELSE '{params.BANDIT_PARSING_ERROR}' END, 0, 0,
           CASE WHEN err <> '' THEN '{params.BANDIT_ERROR_TEXT}' || err ELSE '{params.BANDIT_PARSING_TEXT}' END
    FROM r WHERE NOT json_valid(raw)
    """


@query("ingest_bandit", BANDIT_SQL)
def bandit(spark, folder):
    reports = read_table(spark, folder, "documents").selectExpr(
        "doc_id", f"{BANDIT_RAW} AS raw", f"{BANDIT_STDERR} AS error"
    )
    return linters.bandit(reports).drop("raw", "error")


@query(
    "issue_union",
    f"""
    WITH l AS (SELECT CASE l_returnflag WHEN 'A' THEN 'errors' ELSE 'warnings' END AS category,
                 l_linestatus = 'O' AND l_discount = 0.1 AS bad FROM lineitem WHERE l_returnflag IN ('A', 'N'))
    SELECT 0 AS source_ord, 'pylint' AS source, category, count(*) AS issues, count(*) FILTER (bad) AS bad FROM l GROUP BY category
    UNION ALL SELECT 1, 'pyflakes', 'warnings', count(*), 0 FROM lineitem
    UNION ALL SELECT 2, 'style', 'style_issues', count(*), 0 FROM orders
    """,
)
def issue_union(spark, folder):
    """Issues of several analysers as one bag, in analyser order, counted per category."""
    named = [("pylint", pylint), ("pyflakes", pyflakes), ("style", style)]
    bag = None
    for place, (name, plan) in enumerate(named):
        part = plan(spark, folder).select(
            F.lit(place).alias("source_ord"), F.lit(name).alias("source"),
            "category", "line", "col", "message", "bad",
        )
        bag = part if bag is None else bag.unionByName(part)
    return bag.groupBy("source_ord", "source", "category").agg(
        F.count("*").alias("issues"), F.count_if("bad").alias("bad")
    )
