"""Suggestions for requests: context, language, candidates, filter, ranking, items."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions import scoring
from codeloom.functions.language import detect_language
from codeloom.functions.text import keywords, prefix_context, words
from codeloom.operators.analysis import analyse, suggested_fix
from codeloom.operators.candidates import rank
from codeloom.operators.features import python_features
from codeloom.operators.traffic import cache_lookup
from codeloom.operators.users import personal_rank
from codeloom.session import materialise
from codeloom.skew import null_safe_join


REQUESTS_PER_COPY = 64  # requests that share one copy of the document they name


def dealt(df, *key):
    """Rows dealt by ``key`` to a fixed number of tasks.

    Adaptive execution merges small partitions by the bytes they hold, not by the work they make; it
    leaves these as they are.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *key)


def place_requests(requests, documents, key="doc_id", row_id="event_id", per_copy=REQUESTS_PER_COPY):
    """Requests joined with their documents, spread over the tasks by request, not by document.

    A document is copied once per ``per_copy`` of its requests, so one that many requests name, or a few
    such that lie side by side in the table, is many tasks' work.
    """
    asked = materialise(requests, "asked")
    copies = asked.groupBy(key).agg(F.ceil(F.count("*") / F.lit(per_copy)).alias("_copies"))
    numbered = asked.join(copies, key).withColumn("_copy", F.pmod(F.xxhash64(row_id), F.col("_copies")))
    copied = documents.join(copies, key).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    sides = [dealt(side.drop("_copies"), key, "_copy") for side in (numbered, copied)]
    return sides[0].join(sides[1], [key, "_copy"]).drop("_copy")


def contexts(requests, documents, key="doc_id", row_id="event_id"):
    """Requests with the text before the cursor and its language.

    ``line`` and ``character`` of the cursor may come from either side.
    """
    placed = place_requests(requests, documents, key, row_id)
    cut = placed.withColumn(
        "prompt", prefix_context(F.col("text"), F.col("line"), F.col("character"))
    ).drop("text")
    return cut.withColumn("language", detect_language(F.col("prompt")))


def suggestions(asked, model, row_id="event_id", n=params.STREAM_SUGGESTIONS):
    """The ``n`` best valid candidates of twice as many generated ones per request.

    What can follow a word, and whether it parses, does not depend on the request: both are
    worked out once per word. A request then picks up one short list by its last word and
    orders it by log-probability and score inside its row.
    """
    light = asked.select(
        row_id,
        "language",
        keywords(F.col("prompt")).alias("keywords"),
        F.try_element_at(words(F.col("prompt")), F.lit(-1)).alias("prev"),
    )
    light = materialise(light, "prompts")
    likely = model.continuations(after=light.select("prev").distinct())
    pool = rank(likely, ["prev"], "tok", n=n * params.OVERSAMPLING, score="p", out="_place")
    parsed = python_features(pool.select("tok").distinct(), "tok", ["tok"]).where("valid")
    score = scoring.completion_score(F.lit(False), F.col("tok"), F.col("valid"), F.col("depth"))
    scored = parsed.select("tok", score.alias("score"))
    listed = (
        pool.join(scored, "tok")
        .groupBy("prev")
        .agg(F.collect_list(F.struct("tok", F.ln("p").alias("logp"), "score")).alias("found"))
    )
    served = light.join(listed, "prev")
    ordered = F.array_sort(
        F.transform(
            "found",
            lambda c: F.struct(
                (-c["logp"]).alias("cost"),
                (-c["score"] - F.array_contains("keywords", c["tok"]).cast("int")).alias("loss"),
                c["tok"].alias("completion"),
            ),
        )
    )
    best = F.slice(ordered, 1, n)
    return served.select(row_id, "language", F.posexplode(best).alias("place", "c")).select(
        row_id, "language", (F.col("place") + 1).alias("rank"), "c.completion"
    )


def with_issues(prompts):
    """Prompts with ``context``, a hash of the prompt, and ``issues``: the messages of its analysis, in order.

    Equal prompts are analysed once.
    """
    keyed = prompts.withColumn("context", F.md5("prompt"))
    different = keyed.groupBy("context").agg(F.first("prompt").alias("prompt"))
    found = analyse(different, "prompt", ["context"])
    messages = F.array_join(F.transform("issues", lambda i: i["message"]), "\n")
    return keyed.join(found.select("context", messages.alias("issues")), "context")


CACHE_KEY = ["context", "issues"]


def inline_lists(prompts, model, profile, cached, user="user_id", row_id="event_id", n=params.INLINE_SUGGESTIONS):
    """(row_id, user, context, issues, found, computes): the list that each request of the inline path gets.

    The cache key is the user, the context and the context's issues; ``cached`` has these columns
    and ``found``, an array of (rank, completion). A key that it lacks is computed once, at its first
    request (``computes``): twice ``n`` candidates are generated, filtered and ranked, the user's
    accepted and rejected patterns move them, and ``n`` are kept for every request of the key.
    """
    key = [user, *CACHE_KEY]
    asked = materialise(with_issues(prompts).select(row_id, *key, "prompt", "language"), "requests")
    empty = F.lit(None).cast(cached.schema["found"].dataType)
    looked = cache_lookup(asked, cached, key, [row_id], row_id, empty, "found")
    looked = materialise(dealt(looked, row_id), "looked")  # few keys meet in few tasks; what follows is work per request
    wanted = looked.where("computes")
    fresh = suggestions(wanted.select(row_id, "prompt", "language"), model, row_id, n)
    fresh = fresh.join(wanted.select(row_id, *key), row_id)
    moved = personal_rank(
        fresh.withColumn("score", -F.col("rank").cast("double")).drop("rank"), profile,
        F.col("completion"), [row_id], "completion", bonus=float(n), n=n, user=user, row_id=row_id,
    )
    lists = moved.groupBy(*key).agg(F.collect_list(F.struct("rank", "completion")).alias("_fresh"))
    served = null_safe_join(looked, lists, key, "left")
    none = F.array().cast(cached.schema["found"].dataType)  # a key without candidates is cached, too
    return served.select(row_id, *key, F.coalesce("found", "_fresh", none).alias("found"), "computes")


def cache_rows(lists, user="user_id"):
    """What served requests add to the cache: each computed key once."""
    return lists.where("computes").select(user, *CACHE_KEY, "found")


def inline_completions(prompts, model, profile, cached, user="user_id", row_id="event_id",
                       n=params.INLINE_SUGGESTIONS):
    """(row_id, rank, completion, computes): the inline path of a suggestion request, one row per completion."""
    lists = inline_lists(prompts, model, profile, cached, user, row_id, n)
    return lists.select(row_id, "computes", F.inline("found")).select(row_id, "rank", "completion", "computes")


def fixes_and_completions(files, model, key="doc_id", n=params.STREAM_SUGGESTIONS):
    """(key, place, kind, label, insert_text): fixes of a file's issues, then completions of its end.

    ``files`` has text and language. Completions are generated, checked and ranked as for requests.
    """
    found = analyse(files.select(key, "text"), "text", [key])
    fixes = F.filter(F.transform("issues", lambda i: suggested_fix(i["message"], i["line"])), lambda f: f.isNotNull())
    fixed = found.select(key, F.posexplode(fixes).alias("i", "item")).withColumn("kind", F.lit("error_fix"))
    asked = files.select(key, "language", F.col("text").alias("prompt"))
    offered = suggestions(asked, model, key, n)
    offered = offered.select(key, F.col("rank").alias("i"), F.col("completion").alias("item"), F.lit("completion").alias("kind"))
    listed = fixed.unionByName(offered).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((F.col("kind") == "completion").alias("last"), "i", "kind", "item"))).alias("items")
    )
    rows = listed.select(key, F.posexplode("items").alias("at", "s"))
    fix = F.col("s.kind") == "error_fix"
    label = F.concat(F.when(fix, params.FIX_LABEL_PREFIX).otherwise(params.COMPLETION_LABEL_PREFIX), "s.item")
    return rows.select(
        key, (F.col("at") + 1).alias("place"), "s.kind", label.alias("label"), F.when(~fix, F.col("s.item")).alias("insert_text")
    )


def completion_items(suggested):
    """Item columns of a suggestion: label, kind, detail, insert_text."""
    return suggested.select(
        "*",
        F.col("completion").alias("label"),
        F.lit(params.SNIPPET_KIND).alias("kind"),
        F.concat(F.lit(params.DETAIL_PREFIX + " ("), "language", F.lit(")")).alias("detail"),
        F.col("completion").alias("insert_text"),
    )
