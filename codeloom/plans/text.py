"""Lines, positions, words, comments and language detection."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions import scoring
from codeloom.functions.language import (
    detect_language,
    extension_language,
    language_scores,
    preprocess,
    with_language,
)
from codeloom.functions.text import (
    fingerprint,
    is_relevant,
    keywords,
    line_prefix,
    prefix_context,
    strip_comments,
    surrounding_lines,
    trigger_character,
)
from codeloom.plans.registry import list_literal, query
from codeloom.plans.sql import (
    BEST_SQL,
    CODE,
    EXTENSION_SQL,
    PAIRS,
    clean_sql,
    scores_sql,
    words_sql,
)
from codeloom.sources.corpus import code_corpus
from codeloom.sources.dialogue import conversation_pairs
from codeloom.sources.tables import conversations, documents, explode_lines, notification, read_table, spread

# A cursor for every document: somewhere in its lines, or one line past the end.
CURSOR_LINE = "cast(n_chars % (size(split(text, '\\n')) + 1) as int)"
CURSOR_CHARACTER = "cast(doc_id % 80 as int)"
CURSOR_SQL = """
cursors AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls,
         (n_chars % (len(string_split(text, chr(10))) + 1))::int AS line,
         (doc_id % 80)::int AS ch
  FROM documents)
"""


SCORE_COLUMNS = ", ".join(f"s_{n}::int AS {n}" for n in params.LANGUAGE_PATTERNS)


def cursors(spark, folder):
    return documents(spark, folder, "text", "n_chars").select(
        "doc_id",
        "text",
        F.expr(CURSOR_LINE).alias("line"),
        F.expr(CURSOR_CHARACTER).alias("character"),
    )


def corpus(spark, folder):
    return code_corpus(documents(spark, folder, "source", "text"))


@query(
    "line_explode",
    """
    SELECT doc_id, (unnest(range(len(ls))))::int AS line_no, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
    """,
)
def line_explode(spark, folder):
    return explode_lines(documents(spark, folder))


@query(
    "prefix_context",
    f"""
    WITH {CURSOR_SQL}
    SELECT doc_id, line,
           array_to_string(list_concat(ls[1:least(line, len(ls) - 1)],
             [substring(ls[least(line, len(ls) - 1) + 1], 1, ch)]), chr(10)) AS prefix
    FROM cursors
    """,
)
def prefix(spark, folder):
    rows = cursors(spark, folder)
    return rows.select(
        "doc_id",
        "line",
        prefix_context(F.col("text"), F.col("line"), F.col("character")).alias("prefix"),
    )


@query(
    "surrounding_context",
    f"""
    WITH {CURSOR_SQL}
    SELECT doc_id, line,
           coalesce(array_to_string(ls[greatest(line - 2, 0) + 1 : least(line + 3, len(ls))], chr(10)), '') AS around
    FROM cursors
    """,
)
def surrounding(spark, folder):
    rows = cursors(spark, folder)
    return rows.select(
        "doc_id", "line", surrounding_lines(F.col("text"), F.col("line")).alias("around")
    )


@query(
    "trigger_filter",
    f"""
    WITH {CURSOR_SQL}, p AS (
      SELECT doc_id, substring(coalesce(ls[line + 1], ''), 1, ch) AS prefix FROM cursors)
    SELECT doc_id, prefix, prefix LIKE '%.' AS client_trigger
    FROM p WHERE prefix LIKE '%.' OR prefix LIKE '% '
    """,
)
def triggers(spark, folder):
    rows = cursors(spark, folder)
    cut = rows.select(
        "doc_id", line_prefix(F.col("text"), F.col("line"), F.col("character")).alias("prefix")
    )
    served = cut.where(trigger_character(F.col("prefix"), (".", " ")))
    return served.withColumn("client_trigger", trigger_character(F.col("prefix")))


@query(
    "strip_comments",
    f"""
    SELECT doc_id, regexp_replace(text, '{params.COMMENT_PATTERN}', '', 'g') AS clean FROM documents
    """,
)
def comments(spark, folder):
    docs = documents(spark, folder)
    return docs.select("doc_id", strip_comments(F.col("text")).alias("clean"))


@query("preprocess_pages", f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")
def preprocess_pages(spark, folder):
    pages = spread(read_table(spark, folder, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", preprocess(F.col("html")).alias("clean"))


@query(
    "language_scores",
    f"""
    WITH {CODE}, clean AS (SELECT doc_id, {clean_sql('text')} AS c FROM code)
    SELECT doc_id, {SCORE_COLUMNS} FROM (SELECT doc_id, {scores_sql('c')} FROM clean)
    """,
)
def scores(spark, folder):
    scored = corpus(spark, folder).select("doc_id", language_scores(F.col("text")).alias("s"))
    return scored.select("doc_id", "s.*")


@query(
    "lang_detect",
    f"""
    WITH {CODE}, clean AS (SELECT doc_id, {clean_sql('text')} AS c FROM code),
    s AS (SELECT doc_id, {scores_sql('c')} FROM clean)
    SELECT doc_id, {BEST_SQL} AS language FROM s
    """,
)
def detect(spark, folder):
    return with_language(corpus(spark, folder)).select("doc_id", "language")


@query(
    "lang_detect_documents",
    f"""
    WITH clean AS (SELECT doc_id, {clean_sql('text')} AS c FROM documents),
    s AS (SELECT doc_id, {scores_sql('c')} FROM clean)
    SELECT {BEST_SQL} AS language, count(*) AS n FROM s GROUP BY 1
    """,
)
def detect_documents(spark, folder):
    return with_language(documents(spark, folder)).groupBy("language").agg(F.count("*").alias("n"))


@query(
    "lang_by_ext",
    f"""
    WITH {CODE}, clean AS (SELECT doc_id, path, {clean_sql('text')} AS c FROM code),
    s AS (SELECT doc_id, path, {scores_sql('c')} FROM clean)
    SELECT doc_id, path, coalesce({EXTENSION_SQL}, {BEST_SQL}) AS language FROM s
    """,
)
def by_extension(spark, folder):
    return with_language(corpus(spark, folder), path="path").select("doc_id", "path", "language")


@query(
    "language_support",
    f"""
    WITH {CODE}, clean AS (SELECT doc_id, {clean_sql('text')} AS c FROM code),
    s AS (SELECT doc_id, {scores_sql('c')} FROM clean),
    n AS (SELECT {BEST_SQL} AS language, count(*) AS files FROM s GROUP BY 1)
    SELECT language, coalesce(files, 0)::bigint AS files
    FROM (SELECT unnest({list_literal(params.LANGUAGE_PATTERNS)}) AS language) LEFT JOIN n USING (language)
    """,
)
def support(spark, folder):
    counts = with_language(corpus(spark, folder)).groupBy("language").agg(F.count("*").alias("files"))
    listed = spark.createDataFrame([(n,) for n in params.LANGUAGE_PATTERNS], "language string")
    return listed.join(counts, "language", "left").select(
        "language", F.coalesce("files", F.lit(0)).alias("files")
    )


@query(
    "language_distribution",
    f"""
    WITH {CODE}, clean AS (SELECT path, {clean_sql('text')} AS c FROM code),
    s AS (SELECT path, {scores_sql('c')} FROM clean)
    SELECT coalesce({EXTENSION_SQL}, 'none') AS by_extension, {BEST_SQL} AS by_content, count(*) AS files,
           coalesce({EXTENSION_SQL}, 'none') <> {BEST_SQL} AS disagree
    FROM s GROUP BY ALL
    """,
)
def distribution(spark, folder):
    named = corpus(spark, folder).select(
        F.coalesce(extension_language(F.col("path")), F.lit("none")).alias("by_extension"),
        detect_language(F.col("text")).alias("by_content"),
    )
    counted = named.groupBy("by_extension", "by_content").agg(F.count("*").alias("files"))
    return counted.withColumn("disagree", F.col("by_extension") != F.col("by_content"))


@query(
    "keyword_set",
    f"SELECT conv_id, turn, len(list_distinct({words_sql('text')}))::int AS keywords FROM conversations",
)
def keyword_set(spark, folder):
    turns = conversations(spark, folder)
    return turns.select("conv_id", "turn", F.size(keywords(F.col("text"))).alias("keywords"))


@query(
    "keyword_relevance",
    f"""
    WITH {PAIRS}
    SELECT conv_id, turn, list_has_any({words_sql('prompt')}, {words_sql('completion')}) AS relevant,
           len(list_distinct(list_intersect({words_sql('prompt')}, {words_sql('completion')})))::int AS shared
    FROM pairs
    """,
)
def relevance(spark, folder):
    pairs = conversation_pairs(conversations(spark, folder))
    both = F.array_intersect(keywords(F.col("prompt")), keywords(F.col("completion")))
    return pairs.select(
        "conv_id",
        "turn",
        is_relevant(F.col("prompt"), F.col("completion")).alias("relevant"),
        F.size(both).alias("shared"),
    )


@query(
    "keyword_match",
    f"""
    WITH vocabulary AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark),
    d AS (SELECT doc_id, unnest(list_distinct({words_sql('text')})) AS word FROM documents)
    SELECT doc_id, count(*) AS shared FROM d SEMI JOIN vocabulary USING (word) GROUP BY doc_id
    """,
)
def keyword_match(spark, folder):
    """Documents sharing words with any benchmark text, with the number of shared words."""
    wanted = read_table(spark, folder, "benchmark").select(
        F.explode(keywords(F.col("text"))).alias("word")
    ).distinct()
    found = documents(spark, folder).select(
        "doc_id", F.explode(keywords(F.col("text"))).alias("word")
    )
    matched = found.join(wanted, "word", "left_semi")
    return matched.groupBy("doc_id").agg(F.count("*").alias("shared"))


@query(
    "style_score",
    f"""
    WITH {CODE}, texts AS (
      SELECT 'file' AS kind, doc_id AS id, text FROM code
      UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations),
    f AS (SELECT kind, id, list_filter(string_split(text, chr(10)),
            lambda x: NOT regexp_matches(x, '^{params.SPACE_CLASS}*$')) AS ls, text FROM texts)
    SELECT kind, id,
      CASE WHEN len(ls) = len(list_filter(ls, lambda x: starts_with(x, '    ') OR starts_with(x, chr(9))))
           THEN 0.5::double ELSE 0.0::double END
      + CASE WHEN regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])[a-z_][a-z0-9_]*(?:$|[^\\p{{L}}\\p{{N}}_])')
             THEN 0.5::double ELSE 0.0::double END AS score
    FROM f
    """,
)
def style(spark, folder):
    turns = conversations(spark, folder).select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    files = corpus(spark, folder).select(F.lit("file").alias("kind"), F.col("doc_id").alias("id"), "text")
    texts = files.unionByName(turns)
    return texts.select("kind", "id", scoring.style_score(F.col("text")).alias("score"))


@query(
    "danger_scan",
    f"""
    WITH {CODE}
    SELECT doc_id, md5(text) AS fingerprint FROM code
    WHERE contains(text, 'eval(') OR contains(text, 'exec(') OR contains(text, '__import__')
    """,
)
def danger(spark, folder):
    risky = corpus(spark, folder).where(scoring.has_dangerous_text(F.col("text")))
    return risky.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "completion_items",
    f"""
    WITH {PAIRS}, clean AS (SELECT conv_id, turn, completion, {clean_sql('prompt')} AS c FROM pairs),
    s AS (SELECT conv_id, turn, completion, {scores_sql('c')} FROM clean)
    SELECT conv_id, turn, completion AS label, 15 AS kind,
           'Code suggestion (' || {BEST_SQL} || ')' AS detail, completion AS insert_text
    FROM s
    """,
)
def completion_items(spark, folder):
    pairs = conversation_pairs(conversations(spark, folder))
    known = with_language(pairs, "prompt")
    return known.select(
        "conv_id",
        "turn",
        F.col("completion").alias("label"),
        F.lit(params.SNIPPET_KIND).alias("kind"),
        F.concat(F.lit(params.DETAIL_PREFIX + " ("), "language", F.lit(")")).alias("detail"),
        F.col("completion").alias("insert_text"),
    )


@query(
    "rpc_envelope",
    f"""
    WITH {PAIRS}
    SELECT conv_id, turn, json_object('jsonrpc', '2.0', 'method', 'textDocument/completion',
      'params', json_object('uri', 'conv/' || conv_id, 'line', turn, 'label', completion))::varchar AS message
    FROM pairs
    """,
)
def envelope(spark, folder):
    pairs = conversation_pairs(conversations(spark, folder))
    message = notification(
        "textDocument/completion",
        uri=F.concat(F.lit("conv/"), F.col("conv_id")),
        line=F.col("turn"),
        label=F.col("completion"),
    )
    return pairs.select("conv_id", "turn", message.alias("message"))
