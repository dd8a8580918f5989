"""Language-model scores, ranking and truncation."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import is_relevant
from codeloom.operators.candidates import rank
from codeloom.operators.ngrams import Bigrams, log_softmax, mean_log_prob, truncate
from codeloom.plans.registry import query
from codeloom.plans.sql import PAIRS, words_sql
from codeloom.sources.dialogue import conversation_pairs
from codeloom.sources.tables import conversations, documents, read_table

BIGRAM_SQL = f"""
w AS (SELECT {words_sql('text')} AS w FROM documents),
b AS (SELECT prev, tok, count(*) AS c FROM (
        SELECT unnest(w[1:len(w) - 1]) AS prev, unnest(w[2:len(w)]) AS tok FROM w WHERE len(w) > 1)
      GROUP BY ALL),
n AS (SELECT prev, sum(c)::bigint AS n FROM b GROUP BY 1),
v AS (SELECT count(*) AS v FROM (SELECT prev FROM b UNION SELECT tok FROM b))
"""


def model(spark, folder, store=True):
    return Bigrams.train(documents(spark, folder), store=store)


@query("bigram_counts", f"WITH {BIGRAM_SQL} SELECT prev, tok, c FROM b")
def bigram_counts(spark, folder):
    return model(spark, folder, store=False).counts


@query(
    "bigram_scores",
    f"""
    WITH {BIGRAM_SQL}, t AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
    p AS (SELECT item_id, unnest(w[1:len(w) - 1]) AS prev, unnest(w[2:len(w)]) AS tok FROM t WHERE len(w) > 1)
    SELECT item_id, round(avg(ln((coalesce(c, 0) + 1.0::double) / (coalesce(n, 0) + v))), 6) AS score
    FROM p LEFT JOIN b USING (prev, tok) LEFT JOIN n USING (prev), v GROUP BY item_id
    """,
)
def bigram_scores(spark, folder):
    items = read_table(spark, folder, "benchmark")
    scored = model(spark, folder).score(items, ["item_id"], "text")
    return scored.select("item_id", F.round("score", 6).alias("score"))


RANK_SQL = f"""
    WITH {PAIRS}, {BIGRAM_SQL}, r AS (
      SELECT conv_id, turn, prompt, completion, {words_sql('prompt')} AS pw, {words_sql('completion')} AS cw
      FROM pairs WHERE list_has_any({words_sql('prompt')}, {words_sql('completion')})),
    t AS (SELECT conv_id, turn, list_concat(pw[len(pw):len(pw)], cw) AS w FROM r),
    p AS (SELECT conv_id, turn, unnest(w[1:len(w) - 1]) AS prev, unnest(w[2:len(w)]) AS tok FROM t),
    s AS (SELECT conv_id, turn, round(avg(ln((coalesce(c, 0) + 1.0::double) / (coalesce(n, 0) + v))), 6) AS score
          FROM p LEFT JOIN b USING (prev, tok) LEFT JOIN n USING (prev), v GROUP BY ALL)
    SELECT conv_id, turn, score, (row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn))::int AS rank
    FROM s QUALIFY rank <= {params.INLINE_SUGGESTIONS}
"""


@query("bigram_rank_topn", RANK_SQL)
def rank_conversations(spark, folder):
    """Per conversation the relevant completions of highest mean log-probability."""
    pairs = conversation_pairs(conversations(spark, folder))
    relevant = pairs.where(is_relevant(F.col("prompt"), F.col("completion")))
    scored = model(spark, folder).score(relevant, ["conv_id", "turn"], "completion", "prompt")
    rounded = scored.withColumn("score", F.round("score", 6))
    return rank(rounded, ["conv_id"], "turn", n=params.INLINE_SUGGESTIONS)


@query(
    "topk_topp",
    """
    WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS place FROM c QUALIFY place <= 4),
    s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY place) - c AS before, sum(c) OVER (PARTITION BY user_id) AS total FROM k)
    SELECT user_id, event_type, c / sum(c) OVER (PARTITION BY user_id) AS p
    FROM s WHERE before < total * 0.7::double
    """,
)
def topk_topp(spark, folder):
    counts = read_table(spark, folder, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("c")
    )
    return truncate(counts, ["user_id"], "c", "event_type", k=4, p=0.7)


CONTINUATIONS_SQL = f"""
k AS (SELECT prev, tok, c, row_number() OVER (PARTITION BY prev ORDER BY c DESC, tok) AS place
      FROM b QUALIFY place <= {params.TOP_K}),
s AS (SELECT *, sum(c) OVER (PARTITION BY prev ORDER BY place) - c AS before, sum(c) OVER (PARTITION BY prev) AS total FROM k),
next AS (SELECT prev, tok, c / sum(c) OVER (PARTITION BY prev) AS p FROM s WHERE before < total * {params.TOP_P}::double)
"""


@query(
    "next_token_candidates",
    f"""
    WITH {BIGRAM_SQL}, {CONTINUATIONS_SQL},
    q AS (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations WHERE role = 'user'),
    l AS (SELECT conv_id, turn, w[len(w)] AS prev FROM q WHERE len(w) > 0)
    SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY ln(p) DESC, tok))::int AS rank,
           tok AS completion, round(ln(p), 6) AS logp
    FROM l JOIN next USING (prev) QUALIFY rank <= {params.STREAM_SUGGESTIONS}
    """,
)
def next_tokens(spark, folder):
    asked = conversations(spark, folder).where(F.col("role") == "user")
    best = model(spark, folder).extend(asked, ["conv_id", "turn"], "text")
    return best.withColumn("logp", F.round("logp", 6))


@query(
    "two_token_candidates",
    f"""
    WITH {BIGRAM_SQL}, {CONTINUATIONS_SQL},
    q AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
    one AS (SELECT item_id, tok AS first, ln(p) AS logp FROM q JOIN next ON prev = w[len(w)]
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ln(p) DESC, tok) <= 5)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY logp + ln(p) DESC, first, tok))::int AS rank,
           first || ' ' || tok AS completion, round(logp + ln(p), 6) AS logp
    FROM one JOIN next ON prev = first QUALIFY rank <= 5
    """,
)
def two_tokens(spark, folder):
    items = read_table(spark, folder, "benchmark")
    best = model(spark, folder).extend(items, ["item_id"], "text", steps=2, beams=5)
    return best.withColumn("logp", F.round("logp", 6))


@query(
    "long_completions",
    f"""
    WITH RECURSIVE {BIGRAM_SQL.strip()}, {CONTINUATIONS_SQL.strip()},
    best AS (SELECT prev, tok, p FROM next QUALIFY row_number() OVER (PARTITION BY prev ORDER BY ln(p) DESC, tok) = 1),
    grown AS (
        SELECT item_id, list_extract({words_sql('text')}, -1) AS last, '' AS path, 0::double AS logp, 0 AS step FROM benchmark
        UNION ALL SELECT item_id, tok, path || ' ' || tok, logp + ln(p), step + 1 FROM grown JOIN best ON last = prev WHERE step < 20)
    SELECT item_id, 1::int AS rank, trim(path) AS completion, round(logp, 6) AS logp FROM grown WHERE step = 20
    """,
)
def long_completions(spark, folder):
    """The most probable twenty words after each benchmark item, one word after another."""
    items = read_table(spark, folder, "benchmark")
    best = model(spark, folder).extend(items, ["item_id"], "text", steps=20, beams=1)
    return best.withColumn("logp", F.round("logp", 6))


LOGITS_SQL = """
x AS (SELECT l_suppkey AS request_id, l_linenumber AS pos, l_partkey AS token,
             sum(l_quantity) / 10 AS logit, bool_or(l_returnflag = 'R') AS is_target
      FROM lineitem GROUP BY ALL),
m AS (SELECT *, max(logit) OVER (PARTITION BY request_id, pos) AS mx FROM x),
lp AS (SELECT *, logit - mx - ln(sum(exp(logit - mx)) OVER (PARTITION BY request_id, pos)) AS logp FROM m)
"""


def token_logps(spark, folder):
    """A token distribution per (request, position): the parts a supplier shipped per line."""
    logits = (
        read_table(spark, folder, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("request_id"),
            F.col("l_linenumber").alias("pos"),
            F.col("l_partkey").alias("token"),
        )
        .agg(
            (F.sum("l_quantity") / 10).alias("logit"),
            F.bool_or(F.col("l_returnflag") == "R").alias("is_target"),
        )
    )
    return log_softmax(logits, ["request_id", "pos"], "logit")


@query(
    "log_softmax",
    f"WITH {LOGITS_SQL} SELECT request_id, pos, token, round(logp, 6) AS logp FROM lp",
)
def softmax(spark, folder):
    return token_logps(spark, folder).select(
        "request_id", "pos", "token", F.round("logp", 6).alias("logp")
    )


@query(
    "mean_log_prob",
    f"WITH {LOGITS_SQL} SELECT request_id, round(avg(logp), 6) AS score FROM lp WHERE is_target GROUP BY 1",
)
def mean_logp(spark, folder):
    targets = token_logps(spark, folder).where("is_target")
    scored = mean_log_prob(targets, ["request_id"])
    return scored.select("request_id", F.round("score", 6).alias("score"))
