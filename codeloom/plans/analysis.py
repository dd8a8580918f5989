"""Queries over the code corpus whose result is known from the template of each file."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions import scoring
from codeloom.functions.language import with_language
from codeloom.functions.text import is_relevant, surrounding_lines
from codeloom.operators import analysis as rules
from codeloom.operators.features import feature_table, of_kind, python_features, register_functions
from codeloom.plans.ingest import BANDIT_SQL, bandit
from codeloom.plans.registry import query, text_literal
from codeloom.plans.sql import CODE, ISSUES, PARSED, PYTHON, PYTHON_PARSED, words_sql
from codeloom.plans.text import corpus
from codeloom.sources.corpus import TEMPLATES, code_corpus
from codeloom.sources.tables import documents


def python_files(spark, folder):
    """Files routed to Python by content; the filter runs before the Python stage."""
    return with_language(corpus(spark, folder)).where(F.col("language") == "python")


def python_facts(spark, folder, *keep):
    return python_features(python_files(spark, folder), keep=["doc_id", *keep])


def analysed(spark, folder, *keep):
    return rules.analyse(corpus(spark, folder), keep=["doc_id", *keep])


def joined(column):
    return F.array_join(column, ",")


@query(
    "py_syntax",
    f"""
    WITH {CODE}
    SELECT doc_id, t NOT IN (9, 10, 26) AS valid,
           CASE WHEN t IN (9, 10) THEN 'SyntaxError' WHEN t = 26 THEN 'MemoryError' END AS error_class,
           (CASE t WHEN 9 THEN 1 WHEN 10 THEN 2 END)::int AS error_line,
           (CASE t WHEN 9 THEN 8 + l WHEN 10 THEN 6 + l END)::int AS error_col
    FROM code WHERE t IN {PYTHON}
    """,
)
def syntax(spark, folder):
    return python_facts(spark, folder).select(
        "doc_id", "valid", "error_class", "error_line", "error_col"
    )


IMPORTS = f"""
    WITH {CODE}, e AS (
      SELECT doc_id, unnest(CASE
        WHEN t = 1 THEN ['os', 'sys'] WHEN t = 2 THEN ['pickle.loads, dumps'] WHEN t IN (3, 24) THEN ['pickle']
        WHEN t = 5 THEN ['io'] WHEN t IN (6, 7) THEN ['re'] WHEN t IN (8, 11, 22, 25) THEN ['os']
        WHEN t = 14 THEN ['functools'] ELSE [] END) AS module FROM code)
    SELECT doc_id, module, 1 AS line FROM e
"""


@query("py_imports", IMPORTS)
def imports(spark, folder):
    facts = feature_table(python_facts(spark, folder)).where(F.col("kind") == "import")
    return facts.select("doc_id", F.col("name").alias("module"), "line")


@query("py_imports_sql", IMPORTS)
def imports_sql(spark, folder):
    """The same through the table function, from SQL."""
    register_functions(spark)
    python_files(spark, folder).createOrReplaceTempView("codeloom_files")
    return spark.sql(
        "SELECT doc_id, module, line FROM codeloom_files, LATERAL py_imports(text)"
    )


@query(
    "py_functions",
    f"""
    WITH {CODE}
    SELECT doc_id, name || CASE WHEN t = 13 THEN '' ELSE doc_id::varchar END AS name, args, decorators, docstring
    FROM code JOIN (VALUES
      (0, 'f_', 'x', '', NULL), (4, 'g_', '', '', NULL), (12, 'h_', 'n', '', NULL),
      (13, 'm1', 'self', '', NULL), (13, 'm2', 'self', '', NULL),
      (14, 'q_', 'a,b', 'functools.lru_cache,deco', 'D.')
    ) f(t, name, args, decorators, docstring) USING (t)
    """,
)
def functions(spark, folder):
    facts = feature_table(python_facts(spark, folder)).where(F.col("kind") == "function")
    return facts.select(
        "doc_id",
        "name",
        joined("names").alias("args"),
        joined("extra").alias("decorators"),
        "docstring",
    )


@query(
    "py_classes",
    f"""
    WITH {CODE}
    SELECT doc_id, 'K_' || doc_id AS name, '' AS bases, 'm1' AS methods, 'Doc.' AS docstring
    FROM code WHERE t = 13
    """,
)
def classes(spark, folder):
    facts = feature_table(python_facts(spark, folder)).where(F.col("kind") == "class")
    return facts.select(
        "doc_id",
        "name",
        joined("names").alias("bases"),
        joined("extra").alias("methods"),
        "docstring",
    )


def node_at(line, character):
    """The first node of the walk on the (0-based) line that starts at or before the character."""
    hits = F.filter(
        of_kind("node"), lambda f: (f["line"] == line + 1) & (f["col"] <= character)
    )
    return F.get(hits, F.lit(0))


def context_of(kind, node):
    """The function or class fact of the node, or null."""
    same = F.filter(of_kind(kind), lambda f: f["ord"] == node["ord"])
    return F.get(same, F.lit(0))


@query(
    "node_at_position",
    f"""
    WITH {CODE}, p AS (SELECT *, ((doc_id // {len(TEMPLATES)}) % 2)::int AS line FROM code WHERE t IN {PYTHON_PARSED})
    SELECT doc_id, line, node_type, (line + 1)::int AS node_line, col AS node_col,
           array_to_string(list_slice(string_split(text, chr(10)), 1, line + 3), chr(10)) AS surrounding_code,
           imports,
           CASE WHEN node_type = 'FunctionDef' THEN fname || doc_id END AS function_name,
           CASE WHEN node_type = 'ClassDef' THEN 'K_' || doc_id END AS class_name
    FROM p JOIN (VALUES
      (0, 0, 'FunctionDef', 0, '', 'f_'), (0, 1, 'Return', 4, '', NULL),
      (1, 0, 'Import', 0, 'os,sys', NULL), (1, 1, 'Assign', 0, 'os,sys', NULL),
      (2, 0, 'ImportFrom', 0, 'pickle.loads, dumps', NULL), (2, 1, 'Assign', 0, 'pickle.loads, dumps', NULL),
      (3, 0, 'Import', 0, 'pickle', NULL), (3, 1, 'Assign', 0, 'pickle', NULL),
      (4, 0, 'FunctionDef', 0, '', 'g_'), (4, 1, 'Try', 4, '', NULL),
      (5, 0, 'Import', 0, 'io', NULL), (5, 1, 'Try', 0, 'io', NULL),
      (6, 0, 'Import', 0, 're', NULL), (6, 1, 'Assign', 0, 're', NULL),
      (7, 0, 'Import', 0, 're', NULL), (7, 1, 'Assign', 0, 're', NULL),
      (8, 0, 'Import', 0, 'os', NULL), (8, 1, 'Assign', 0, 'os', NULL),
      (11, 0, 'Import', 0, 'os', NULL), (11, 1, 'For', 0, 'os', NULL),
      (12, 0, 'FunctionDef', 0, '', 'h_'), (12, 1, 'For', 4, '', NULL),
      (13, 0, 'ClassDef', 0, '', NULL), (13, 1, 'Expr', 4, '', NULL),
      (14, 0, 'Import', 0, 'functools', NULL), (14, 1, 'Call', 1, 'functools', NULL),
      (22, 0, 'Import', 0, 'os', NULL), (22, 1, 'If', 0, 'os', NULL),
      (24, 0, 'Import', 0, 'pickle', NULL), (24, 1, 'Assign', 0, 'pickle', NULL),
      (25, 0, 'Import', 0, 'os', NULL), (25, 1, 'Try', 0, 'os', NULL)
    ) n(t, line, node_type, col, imports, fname) USING (t, line)
    """,
)
def node_position(spark, folder):
    line = F.expr(f"cast(floor(doc_id / {len(TEMPLATES)}) % 2 as int)")
    facts = python_facts(spark, folder, "text").where("valid").withColumn("at_line", line)
    found = facts.withColumn("node", node_at(F.col("at_line"), F.lit(4))).where("node is not null")
    node = F.col("node")
    return found.select(
        "doc_id",
        F.col("at_line").alias("line"),
        node["name"].alias("node_type"),
        node["line"].alias("node_line"),
        node["col"].alias("node_col"),
        surrounding_lines(F.col("text"), F.col("at_line")).alias("surrounding_code"),
        joined(F.transform(of_kind("import"), lambda f: f["name"])).alias("imports"),
        context_of("function", node)["name"].alias("function_name"),
        context_of("class", node)["name"].alias("class_name"),
    )


def one_source(spark, folder, source):
    long = rules.issue_table(analysed(spark, folder)).where(F.col("source").isin(*source))
    return long.select("doc_id", "category", "issue_type", "line", "col", "message")


def one_source_sql(sources):
    return f"""
    WITH {CODE}, {ISSUES}
    SELECT doc_id, category, issue_type, line::int AS line, col::int AS col, message
    FROM issues WHERE source IN ({", ".join(text_literal(s) for s in sources)})
    """


@query("except_rules", one_source_sql(["except"]))
def except_rules(spark, folder):
    return one_source(spark, folder, ["except"])


@query("unsafe_calls", one_source_sql(["call"]))
def unsafe_calls(spark, folder):
    return one_source(spark, folder, ["call"])


@query("unsafe_imports", one_source_sql(["import"]))
def unsafe_imports(spark, folder):
    return one_source(spark, folder, ["import"])


@query("large_strings", one_source_sql(["string"]))
def large_strings(spark, folder):
    return one_source(spark, folder, ["string"])


@query("js_java_rules", one_source_sql(["var", "catch", "try"]))
def js_java(spark, folder):
    """Line rules need no Python stage: they run on the detected language directly."""
    files = with_language(corpus(spark, folder))
    found = files.withColumn("issues", rules.text_rule_issues(F.col("text"), F.col("language")))
    return rules.issue_table(found).select(
        "doc_id", "category", "issue_type", "line", "col", "message"
    )


@query(
    "nested_depth",
    f"""
    WITH {CODE}
    SELECT doc_id, (CASE WHEN t IN (11, 22) THEN 3 ELSE 0 END)::int AS depth,
           (CASE WHEN t IN (11, 12, 22) THEN 3 ELSE 0 END)::int AS depth_full
    FROM code WHERE t IN {PYTHON_PARSED}
    """,
)
def depth(spark, folder):
    return python_facts(spark, folder).where("valid").select("doc_id", "depth", "depth_full")


@query(
    "analyse_corpus",
    f"""
    WITH {CODE}, {ISSUES}
    SELECT doc_id, place::int AS place, category, source, line::int AS line, col::int AS col FROM issues
    """,
)
def analyse_corpus(spark, folder):
    return rules.issue_table(analysed(spark, folder)).select(
        "doc_id", "place", "category", "source", "line", "col"
    )


@query(
    "issue_counts",
    f"""
    WITH {CODE}, {ISSUES}
    SELECT doc_id, count(*) FILTER (category = 'errors') AS errors,
           count(*) FILTER (category = 'warnings') AS warnings,
           count(*) FILTER (category = 'style_issues') AS style_issues,
           count(*) FILTER (category = 'security_issues') AS security_issues,
           '(' || count(*) || ' issues) ' AS label
    FROM issues GROUP BY doc_id
    """,
)
def counts(spark, folder):
    """Issues per category of every file that has any; counted inside the row of the file."""
    listed = analysed(spark, folder).where(F.size("issues") > 0)
    per_category = [rules.count_of(c).alias(c) for c in params.ISSUE_CATEGORIES]
    return listed.select(
        "doc_id", *per_category, rules.issue_label(F.size("issues")).alias("label")
    )


@query(
    "issue_dict",
    f"""
    WITH {CODE}, {ISSUES}, e AS (
      SELECT doc_id, string_agg(line || ':' || col, ';' ORDER BY place) FILTER (category = 'errors') AS errors,
             string_agg(line || ':' || col || ':' || message, ';' ORDER BY place)
               FILTER (category = 'security_issues') AS security
      FROM issues GROUP BY doc_id)
    SELECT doc_id, coalesce(errors, '') AS errors, coalesce(security, '') AS security
    FROM code LEFT JOIN e USING (doc_id)
    """,
)
def dictionary(spark, folder):
    wide = analysed(spark, folder).select("doc_id", rules.issue_dictionary(F.col("issues")).alias("d"))

    def listed(items, *names):
        return F.array_join(
            F.transform(items, lambda i: F.concat_ws(":", *[i[n].cast("string") for n in names])), ";"
        )

    return wide.select(
        "doc_id",
        listed(F.col("d.errors"), "line", "column").alias("errors"),
        listed(F.col("d.security_issues"), "line", "column", "message").alias("security"),
    )


@query(
    "diagnostics",
    f"""
    WITH {CODE}, {ISSUES}, shown AS (
      SELECT doc_id, source, place, line, col, message FROM issues
      UNION ALL SELECT doc_id, 'bandit', NULL, line, col, message FROM ({BANDIT_SQL}))
    SELECT doc_id, source, place::int AS place, (line - 1)::int AS start_line, (col - 1)::int AS start_character,
           (line - 1)::int AS end_line, col::int AS end_character, message,
           CASE WHEN starts_with(message, 'Error') THEN 'Error' ELSE 'Warning' END AS severity
    FROM shown
    """,
)
def diagnostics(spark, folder):
    """Issues of the rules and of the security tool's reports as ranges in the editor.

    The text of a syntax error depends on the Python version and is left out.
    """
    columns = ["doc_id", "source", "place", "line", "col", "message"]
    reported = bandit(spark, folder).withColumns({"source": F.lit("bandit"), "place": F.lit(None).cast("int")})
    long = rules.issue_table(analysed(spark, folder)).select(columns).unionByName(reported.select(columns))
    d = rules.diagnostic(F.col("line"), F.col("col"), F.col("message"))
    shown = long.select("doc_id", "source", "place", d.alias("d")).select("doc_id", "source", "place", "d.*")
    return shown.withColumn("message", F.when(F.col("source") != "syntax", F.col("message")))


FIXES_SQL = f"""
fixes AS (
  SELECT doc_id, 0 AS place, 'Review the line for typos or missing colons' AS fix FROM code WHERE t = 9
  UNION ALL SELECT doc_id, 0, 'Check for unclosed parentheses, brackets, or quotes' FROM code WHERE t = 10
  UNION ALL SELECT doc_id, 0, 'Specify an exception to catch on line 4, e.g., ''except Exception:''' FROM code WHERE t IN (4, 25)
  UNION ALL SELECT doc_id, 0, 'Add a specific exception to catch on line 2' FROM code WHERE t = 5
  UNION ALL SELECT doc_id, 1, 'Add a specific exception to catch on line 5' FROM code WHERE t = 25)
"""


@query("suggest_fixes", f"WITH {CODE}, {FIXES_SQL} SELECT doc_id, place::int AS place, fix FROM fixes")
def suggest_fixes(spark, folder):
    long = rules.issue_table(analysed(spark, folder))
    return rules.fixes(long).select("doc_id", "place", "fix")


@query(
    "fixes_then_completions",
    f"""
    WITH {CODE}, {FIXES_SQL}, tagged AS (
      SELECT doc_id, 0 AS kind_ord, place, fix AS item, 'error_fix' AS kind FROM fixes
      UNION ALL SELECT doc_id, 1, 0, text, 'completion' FROM code WHERE t IN {PARSED})
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY kind_ord, place))::int AS place, kind,
           CASE kind WHEN 'error_fix' THEN '{params.FIX_LABEL_PREFIX}' ELSE '{params.COMPLETION_LABEL_PREFIX}' END || item AS label,
           CASE kind WHEN 'error_fix' THEN 'Error Fix' ELSE 'Completion' END AS detail,
           CASE kind WHEN 'completion' THEN item END AS insert_text
    FROM tagged
    """,
)
def fixes_completions(spark, folder):
    """Fixes first, then the code itself where it parses, in one list per file.

    The list is put together inside the row of the file: no shuffle.
    """
    files = rules.analyse(corpus(spark, folder), keep=["doc_id"])

    def tagged(kind, item):
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"))

    found = F.transform(
        "issues", lambda i: rules.suggested_fix(i["message"], i["line"])
    )
    fix_items = F.transform(F.filter(found, lambda f: f.isNotNull()), lambda f: tagged("error_fix", f))
    none = F.array().cast("array<struct<kind:string,item:string>>")
    completion = F.when(F.col("valid"), F.array(tagged("completion", F.col("text")))).otherwise(none)
    rows = files.select("doc_id", F.posexplode(F.concat(fix_items, completion)).alias("i", "s"))
    is_fix = F.col("s.kind") == "error_fix"
    label = F.concat(
        F.when(is_fix, params.FIX_LABEL_PREFIX).otherwise(params.COMPLETION_LABEL_PREFIX), "s.item"
    )
    prefix_length = len(params.COMPLETION_LABEL_PREFIX)
    return rows.select(
        "doc_id",
        (F.col("i") + 1).alias("place"),
        "s.kind",
        label.alias("label"),
        F.when(is_fix, "Error Fix").otherwise("Completion").alias("detail"),
        F.when(~is_fix, F.substring(label, prefix_length + 1, 1 << 30)).alias("insert_text"),
    )


REPORT_SQL = f"""
    WITH {CODE}, {ISSUES}, n AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS number FROM issues WHERE category = 'security_issues'),
    s AS (
      SELECT doc_id, count(*) AS total, string_agg(number || '. ' || issue_type || ' (Line ' || line || ', Column ' || col || '):'
        || chr(10) || '   ' || message || chr(10) || chr(10), '' ORDER BY number) AS entries FROM n GROUP BY doc_id)
    SELECT doc_id, CASE WHEN s.doc_id IS NULL THEN '{params.REPORT_EMPTY}' ELSE
      'Security Analysis Report:' || chr(10) || chr(10) || entries || 'Total issues found: ' || total END AS report
    FROM code LEFT JOIN s USING (doc_id)
"""


@query("security_report", REPORT_SQL)
def security_report(spark, folder):
    return analysed(spark, folder).select(
        "doc_id", rules.report(rules.security_issues()).alias("report")
    )


SCORE_SQL = f"""
scored AS (
  SELECT code.doc_id, code.source, code.t,
    CASE WHEN code.t NOT IN {PARSED} THEN 0.0::double
    ELSE (CASE WHEN code.t IN (6, 7, 24) THEN 2.0 WHEN code.t IN (11, 22) THEN 2.5 WHEN code.t = 23 THEN 3.5 ELSE 3.0 END)::double
       + (CASE WHEN length(code.text) < 100 THEN 0.5 ELSE 0.0 END)::double
       + (CASE WHEN list_has_any({words_sql('d.text')}, {words_sql('code.text')}) THEN 1.0 ELSE 0.0 END)::double END AS score
  FROM code JOIN documents d USING (doc_id))
"""


@query("completion_score", f"WITH {CODE}, {SCORE_SQL} SELECT doc_id, score FROM scored")
def completion_scores(spark, folder):
    """Score of each file as a completion of the document it was derived from."""
    return scored_files(spark, folder).select("doc_id", "score")


def scored_files(spark, folder):
    docs = documents(spark, folder, "source", "text").withColumn("prompt", F.col("text"))
    files = code_corpus(docs, "prompt").withColumn(
        "relevant", is_relevant(F.col("prompt"), F.col("text"))
    )
    features = python_features(files, keep=["doc_id", "source", "relevant", "text"])
    return features.withColumn(
        "score",
        scoring.completion_score(F.col("relevant"), F.col("text"), F.col("valid"), F.col("depth")),
    )


@query(
    "filter_completions",
    f"WITH {CODE}, {SCORE_SQL} SELECT source, doc_id FROM scored WHERE score > 0",
)
def filter_completions(spark, folder):
    """Valid completions per source by descending score, then without the score.

    A distributed sort: its ranges cut through a source with very many completions.
    """
    kept = scored_files(spark, folder).where(F.col("score") > 0)
    return kept.orderBy("source", F.desc("score"), "doc_id").select("source", "doc_id")
