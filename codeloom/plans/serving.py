"""The whole way from an editor request to its suggestions."""

import keyword

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.language import with_language
from codeloom.functions.text import lines
from codeloom.operators import serving
from codeloom.plans.analysis import FIXES_SQL
from codeloom.plans.registry import list_literal, query
from codeloom.plans.scoring import BIGRAM_SQL, CONTINUATIONS_SQL, model
from codeloom.plans.sql import BEST_SQL, CODE, clean_sql, scores_sql, words_sql
from codeloom.plans.text import corpus
from codeloom.plans.users import profile_rows, signed_in_clicks
from codeloom.session import materialise
from codeloom.sources.tables import documents

KEYWORDS = [k for k in keyword.kwlist if k.islower()]


SERVED_SQL = f"""

    WITH {BIGRAM_SQL}, {CONTINUATIONS_SQL},
    st AS (SELECT user_id, ts, event_type = 'signup' AS signed_in FROM events WHERE event_type IN ('signup', 'error')),
    e AS (SELECT event_id, (props->>'k')::bigint AS doc_id, r.user_id::int AS ch
          FROM (SELECT * FROM events WHERE event_type = 'click') r ASOF JOIN st ON r.user_id = st.user_id AND r.ts > st.ts WHERE signed_in),
    c AS (SELECT event_id, ch, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) // 2 AS line
          FROM e JOIN documents USING (doc_id)),
    q AS (SELECT event_id, array_to_string(list_concat(ls[1:line], [substring(ls[line + 1], 1, ch)]), chr(10)) AS prompt FROM c),
    l AS (SELECT event_id, prompt, {clean_sql('prompt')} AS clean, list_extract({words_sql('prompt')}, -1) AS prev FROM q),
    counted AS (SELECT event_id, prompt, prev, {scores_sql('clean')} FROM l),
    g AS (SELECT event_id, prompt, {BEST_SQL} AS language, tok, ln(p) AS logp FROM counted JOIN next USING (prev)
          QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ln(p) DESC, tok) <= 10),
    valid AS (SELECT event_id, language, tok, logp, list_contains({words_sql('prompt')}, tok) AS relevant,
            regexp_matches(tok, '^[a-z_][a-z0-9_]*$') AS snake FROM g
          WHERE (regexp_matches(tok, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*$') AND NOT list_contains({list_literal(KEYWORDS)}, tok))
             OR regexp_matches(tok, '^(?:0(?:_?0)*|[1-9](?:_?[0-9])*)$'))
"""


@query(
    "serve_completions",
    f"""{SERVED_SQL}
    SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY logp DESC, relevant DESC, snake DESC, tok))::int AS rank,
           tok AS label, {params.SNIPPET_KIND} AS kind, 'Code suggestion (' || language || ')' AS detail, tok AS insert_text
    FROM valid QUALIFY rank <= {params.STREAM_SUGGESTIONS}
    """,
)
def serve_completions(spark, folder):
    """Clicks of signed-in users, at a cursor in the middle of the document they name."""
    docs = documents(spark, folder).withColumn(
        "line", F.floor(F.size(lines(F.col("text"))) / 2).cast("int")
    )
    asked = signed_in_clicks(spark, folder).select(
        "event_id",
        F.from_json("props", "k long")["k"].alias("doc_id"),
        F.col("user_id").cast("int").alias("character"),
    )
    prompts = serving.contexts(asked, docs)
    served = serving.completion_items(serving.suggestions(prompts, model(spark, folder)))
    return served.select("event_id", "rank", "label", "kind", "detail", "insert_text")


@query(
    "inline_completions",
    f"""{SERVED_SQL.replace('<= 10)', '<= 6)')},
    u AS (SELECT q.event_id, min(q.event_id) OVER (PARTITION BY user_id, prompt) = q.event_id AS computes
          FROM q JOIN events USING (event_id))
    SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY logp DESC, relevant DESC, snake DESC, tok))::int AS rank,
           tok AS completion, computes
    FROM valid JOIN u USING (event_id) QUALIFY rank <= {params.INLINE_SUGGESTIONS}
    """,
)
def inline_completions(spark, folder):
    """Signed-in clicks through language, issues, cache, profile, generation, filter and ranking.

    The later half of the clicks finds the lists of the earlier half in the cache.
    """
    docs = documents(spark, folder).withColumn(
        "line", F.floor(F.size(lines(F.col("text"))) / 2).cast("int")
    )
    clicks = signed_in_clicks(spark, folder).select(
        "event_id", "user_id", F.from_json("props", "k long")["k"].alias("doc_id"), F.col("user_id").cast("int").alias("character")
    )
    prompts = materialise(serving.contexts(clicks, docs), "contexts")
    learned, profile = model(spark, folder), profile_rows(spark, folder)
    half = prompts.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    nothing = spark.createDataFrame([], "user_id bigint, context string, issues string, found array<struct<rank:int,completion:string>>")
    first = materialise(serving.inline_lists(prompts.where(F.col("event_id") <= half), learned, profile, nothing), "lists")
    cached = serving.cache_rows(first)
    second = serving.inline_lists(prompts.where(F.col("event_id") > half), learned, profile, cached)
    lists = first.unionByName(second)
    return lists.select("event_id", "computes", F.inline("found")).select("event_id", "rank", "completion", "computes")


@query(
    "fixes_and_completions",
    f"""
    WITH {CODE}, {FIXES_SQL}, {BIGRAM_SQL}, {CONTINUATIONS_SQL},
    l AS (SELECT doc_id, text AS prompt, list_extract({words_sql('text')}, -1) AS prev FROM code),
    g AS (SELECT doc_id, prompt, tok, ln(p) AS logp FROM l JOIN next USING (prev)
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ln(p) DESC, tok) <= 10),
    valid AS (SELECT doc_id, tok, logp, list_contains({words_sql('prompt')}, tok) AS relevant,
            regexp_matches(tok, '^[a-z_][a-z0-9_]*$') AS snake FROM g
          WHERE (regexp_matches(tok, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*$') AND NOT list_contains({list_literal(KEYWORDS)}, tok))
             OR regexp_matches(tok, '^(?:0(?:_?0)*|[1-9](?:_?[0-9])*)$')),
    best AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY logp DESC, relevant DESC, snake DESC, tok) AS place
             FROM valid QUALIFY place <= {params.STREAM_SUGGESTIONS}),
    tagged AS (SELECT doc_id, 0 AS kind_ord, place, fix AS item, 'error_fix' AS kind FROM fixes
               UNION ALL SELECT doc_id, 1, place, tok, 'completion' FROM best)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY kind_ord, place))::int AS place, kind,
           CASE kind WHEN 'error_fix' THEN '{params.FIX_LABEL_PREFIX}' ELSE '{params.COMPLETION_LABEL_PREFIX}' END || item AS label,
           CASE kind WHEN 'completion' THEN item END AS insert_text
    FROM tagged
    """,
)
def fixes_and_completions(spark, folder):
    """Per file the fixes of its issues, then the generated completions of its end."""
    files = materialise(with_language(corpus(spark, folder)).select("doc_id", "text", "language"), "files")
    return serving.fixes_and_completions(files, model(spark, folder))
