"""Corpus jobs over features and issues."""

from codeloom.operators import corpus_jobs as jobs
from codeloom.plans.analysis import REPORT_SQL, SCORE_SQL, analysed, python_facts, scored_files
from codeloom.plans.registry import query
from codeloom.plans.sql import CODE, ISSUES, PYTHON, PYTHON_PARSED


@query(
    "import_usage",
    f"""
    WITH {CODE}, e AS (
      SELECT doc_id, unnest(CASE
        WHEN t = 1 THEN ['os', 'sys'] WHEN t = 2 THEN ['pickle.loads, dumps'] WHEN t IN (3, 24) THEN ['pickle']
        WHEN t = 5 THEN ['io'] WHEN t IN (6, 7) THEN ['re'] WHEN t IN (8, 11, 22, 25) THEN ['os']
        WHEN t = 14 THEN ['functools'] ELSE [] END) AS module FROM code)
    SELECT module, count(DISTINCT doc_id) AS files, count(*) AS statements
    FROM e GROUP BY module ORDER BY files DESC, module LIMIT 20
    """,
)
def import_usage(spark, folder):
    return jobs.import_usage(python_facts(spark, folder))


@query(
    "syntax_failure_rate",
    f"""
    WITH {CODE}
    SELECT source, count(*) AS files, count(*) FILTER (t IN (9, 10, 26)) AS failed,
           avg((t IN (9, 10, 26))::int) AS rate
    FROM code WHERE t IN {PYTHON} GROUP BY source
    """,
)
def syntax_failure_rate(spark, folder):
    return jobs.syntax_failures(python_facts(spark, folder, "source"))


@query(
    "syntax_error_classes",
    f"""
    WITH {CODE} SELECT CASE t WHEN 26 THEN 'MemoryError' ELSE 'SyntaxError' END AS error_class, count(*) AS files
    FROM code WHERE t IN (9, 10, 26) GROUP BY 1
    """,
)
def syntax_error_classes(spark, folder):
    return jobs.error_classes(python_facts(spark, folder))


@query(
    "docstring_coverage",
    f"""
    WITH {CODE}, named AS (
      SELECT source, kind, documented, decorated FROM code JOIN (VALUES
        (0, 'function', 0, 0), (4, 'function', 0, 0), (12, 'function', 0, 0), (13, 'function', 0, 0),
        (13, 'function', 0, 0), (13, 'class', 1, 0), (14, 'function', 1, 1)
      ) v(t, kind, documented, decorated) USING (t))
    SELECT source, kind, count(*) AS n, avg(documented) AS documented, avg(decorated) AS decorated
    FROM named GROUP BY source, kind
    """,
)
def docstring_coverage(spark, folder):
    return jobs.documentation(python_facts(spark, folder, "source"))


@query(
    "issue_hotspots",
    f"""
    WITH {CODE}, {ISSUES}, lang AS (
      SELECT *, CASE WHEN t IN {PYTHON} THEN 'python' WHEN t = 15 THEN 'javascript' WHEN t = 16 THEN 'java'
        WHEN t = 17 THEN 'ruby' WHEN t = 18 THEN 'go' WHEN t = 19 THEN 'rust' ELSE 'unknown' END AS language FROM code),
    l AS (SELECT language, sum(len(string_split(text, chr(10))))::bigint AS lines FROM lang GROUP BY 1),
    i AS (SELECT language, category, count(*) AS issues FROM issues JOIN lang USING (doc_id) GROUP BY ALL)
    SELECT language, lines, category, issues, issues * 1000.0::double / lines AS per_thousand,
           rank() OVER (ORDER BY issues * 1000.0::double / lines DESC)::int AS rank
    FROM i JOIN l USING (language)
    """,
)
def issue_hotspots(spark, folder):
    return jobs.issue_hotspots(analysed(spark, folder))


@query(
    "depth_histogram",
    f"""
    WITH {CODE}
    SELECT (CASE WHEN t IN (11, 22) THEN 3 ELSE 0 END)::int AS depth,
           (CASE WHEN t IN (11, 12, 22) THEN 3 ELSE 0 END)::int AS depth_full, count(*) AS files
    FROM code WHERE t IN {PYTHON_PARSED} GROUP BY ALL
    """,
)
def depth_histogram(spark, folder):
    return jobs.depth_histogram(python_facts(spark, folder))


@query(
    "score_distribution",
    f"""
    WITH {CODE}, {SCORE_SQL}
    SELECT source, count(*) AS files, avg(score) AS mean, quantile_cont(score, 0.5) AS median
    FROM scored GROUP BY source
    """,
)
def score_distribution(spark, folder):
    return jobs.score_distribution(scored_files(spark, folder))


@query(
    "unsafe_files",
    f"SELECT doc_id, path, report FROM ({REPORT_SQL}) JOIN (WITH {CODE} SELECT doc_id, path, t FROM code) USING (doc_id) WHERE t IN (3, 6, 7, 24)",
)
def unsafe_files(spark, folder):
    return jobs.unsafe_files(analysed(spark, folder, "path"))
