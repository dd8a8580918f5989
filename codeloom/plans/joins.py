"""Interval, word-set and rule joins, and the user table kept between jobs."""

import uuid

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import micros
from codeloom.operators.intervals import live_tokens
from codeloom.operators.matching import fixes_by_table, relevant_pairs
from codeloom.plans.registry import query
from codeloom.plans.sql import words_sql
from codeloom.session import run_dir
from codeloom.sources.tables import documents, read_table
from codeloom.sources.users import UserTable

HOUR = 3600 * 1000000


@query(
    "token_ranges",
    f"""
    WITH e AS (SELECT *, epoch_us(ts) AS t FROM events),
    tokens AS (SELECT user_id, event_id AS token, t AS issued,
                 least(t + (event_id % 72 + 1) * {HOUR}, CASE WHEN event_id % 5 = 0 THEN t + (event_id % 9) * {HOUR} ELSE t + 73 * {HOUR} END) AS stop
               FROM e WHERE event_type IN ('signup', 'view', 'purchase')),
    r AS (SELECT event_id, user_id, t FROM e WHERE event_type IN ('click', 'error'))
    SELECT r.event_id, count(token) AS live, first(token ORDER BY issued DESC, token DESC) AS token
    FROM r LEFT JOIN tokens ON r.user_id = tokens.user_id AND r.t BETWEEN issued AND stop - 1 GROUP BY r.event_id
    """,
)
def token_ranges(spark, folder):
    """Clicks and errors against tokens of 1 to 72 hours, a fifth of them revoked early."""
    events = read_table(spark, folder, "events").withColumn("t", micros(F.col("ts")))
    given = events.where(F.col("event_type").isin("signup", "view", "purchase"))
    revoked = F.when(F.col("event_id") % 5 == 0, F.col("t") + F.col("event_id") % 9 * F.lit(HOUR))
    tokens = given.select(
        "user_id", F.col("event_id").alias("token"), F.col("t").alias("issued"),
        ((F.col("event_id") % 72 + 1) * F.lit(HOUR)).alias("lifetime"), revoked.alias("revoked"),
    )
    asked = events.where(F.col("event_type").isin("click", "error")).select("user_id", "event_id", "t")
    return live_tokens(asked, tokens).select("event_id", "live", "token")


@query(
    "relevant_pairs",
    f"""
    WITH c AS (SELECT item_id AS completion_id, unnest(list_distinct({words_sql('text')})) AS word FROM benchmark),
    s AS (SELECT completion_id, count(*) AS n FROM c GROUP BY ALL),
    p AS (SELECT doc_id AS prompt_id, unnest(list_distinct({words_sql('text')})) AS word FROM documents),
    o AS (SELECT prompt_id, completion_id, count(*) AS common FROM p JOIN c USING (word) GROUP BY ALL)
    SELECT prompt_id, completion_id, common::int AS common FROM o JOIN s USING (completion_id) WHERE common >= ceil(n * 0.8 - 1e-9)
    """,
)
def relevant(spark, folder):
    """Documents that hold four fifths of the words of a benchmark item."""
    prompts = documents(spark, folder).withColumnRenamed("doc_id", "prompt_id")
    completions = read_table(spark, folder, "benchmark").withColumnRenamed("item_id", "completion_id")
    return relevant_pairs(prompts, completions)


@query(
    "rule_table_fixes",
    f"""
    WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
    rules AS (SELECT doc_id AS ord, list_distinct([w[1], substr(w[2], 1, 4)]) AS fragments, 'line {{line}}: see ' || doc_id AS template
              FROM d WHERE len(w) >= 2),
    issues AS (SELECT conv_id, turn, lower(text) AS message FROM conversations WHERE text IS NOT NULL),
    told AS (SELECT DISTINCT message FROM issues),
    best AS (SELECT message, min(ord) AS ord FROM told JOIN rules ON len(list_filter(fragments, lambda f: NOT contains(message, f))) = 0 GROUP BY message)
    SELECT conv_id, turn, replace(template, '{{line}}', turn::varchar) AS fix FROM issues JOIN best USING (message) JOIN rules USING (ord)
    """,
)
def rule_table(spark, folder):
    """A rule per document (its first word, the beginning of its second) against all turns of conversations."""
    start = F.array_remove(F.split(F.lower("text"), params.NON_WORD_PATTERN, 4), "")  # two words and what follows
    docs = documents(spark, folder).select("doc_id", start.alias("w")).where(F.size("w") >= 2)
    fragments = F.array_distinct(F.array(F.get("w", F.lit(0)), F.substring(F.get("w", F.lit(1)), 1, 4)))
    template = F.concat(F.lit("line {line}: see "), F.col("doc_id").cast("string"))
    rules = docs.select(F.col("doc_id").alias("ord"), fragments.alias("fragments"), template.alias("template"))
    turns = read_table(spark, folder, "conversations").where("text is not null")
    issues = turns.select("conv_id", "turn", F.lower("text").alias("message"))
    return fixes_by_table(issues, rules, line="turn").select("conv_id", "turn", "fix")


@query(
    "user_table_jobs",
    """
    WITH a AS (SELECT event_id, 'name-' || (event_id * 7 % 400) AS username
               FROM events WHERE event_type IN ('signup', 'click')),
    f AS (SELECT username, min(event_id) AS first FROM a GROUP BY username)
    SELECT event_id, username, event_id = first AS created FROM a JOIN f USING (username)
    """,
)
def user_table_jobs(spark, folder):
    """Registrations in three jobs that share the bucketed user table."""
    path = run_dir(spark, "users")
    attempts = read_table(spark, folder, "events").where("event_type in ('signup', 'click')")
    attempts = attempts.select("event_id", "ts", F.concat(F.lit("name-"), F.col("event_id") * 7 % 400).alias("username"))
    first, last = attempts.agg(F.min("event_id"), F.max("event_id")).first()
    found, schema = [], "username string, registered bigint"
    for i in range(3):
        table = UserTable(spark, f"users_{uuid.uuid4().hex}", path, schema, buckets=8)  # as a new job finds it
        lo, hi = (first + (last - first + 1) * k // 3 for k in (i, i + 1)) if first is not None else (0, 0)
        decided = table.attempts(attempts.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)), order=["event_id"])
        stored = run_dir(spark, "attempts")
        decided.write.parquet(stored)
        decided = spark.read.schema(decided.schema).parquet(stored)
        table.add(decided.withColumn("registered", F.col("event_id")))
        found.append(decided)
    whole = found[0].unionByName(found[1]).unionByName(found[2])
    return whole.select("event_id", "username", "created")
