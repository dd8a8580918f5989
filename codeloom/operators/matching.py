"""Joins by text: prompts and completions that share words, messages and the rules that fit them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import keywords
from codeloom.session import materialise
from codeloom.skew import SENT_ROWS, sent_if_short

GRAM = 3  # characters of a rule's join key
FIRST_RULES = 1000  # rules tried in the first round; ten times as many in each later one, up to SENT_ROWS


def relevant_pairs(prompts: DataFrame, completions: DataFrame, share=0.8, key="prompt_id", other="completion_id", text="text") -> DataFrame:
    """(prompt key, completion key, common): pairs in which the prompt holds ``share`` of the completion's words.

    Words are distinct; ``common`` counts shared ones. A prefix filter: of a completion with n words, of
    which ``need`` must be shared, any n - need + 1 hold a shared one, and the rarest are taken. So
    frequent words are joined on only by completions that have no rarer ones. Candidates are then
    counted exactly. Ids are unique and not null; texts without words match nothing.
    """
    def sets(df, name):
        rows = df.select(F.col(name), F.transform(keywords(F.col(text)), lambda w: F.xxhash64(w)).alias("words"))
        return materialise(rows.where(F.size("words") > 0), "word-sets")

    asked, offered = sets(prompts, key), sets(completions, other)
    each = offered.select(other, F.size("words").alias("n"), F.explode("words").alias("word"))
    seen = asked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    seen = each.select("word").distinct().join(seen, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
    need = F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9))
    ranked = each.join(seen, "word").groupBy(other, "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("words"))
    first = ranked.select(other, F.explode(F.slice("words", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("w"))
    first = first.where("w.df > 0").select(other, F.col("w.word").alias("word"))
    pairs = asked.select(key, F.explode("words").alias("word")).join(first, "word").select(key, other).distinct()
    pairs = materialise(pairs, "pairs")
    both = pairs.join(asked, key).join(offered.withColumnRenamed("words", "_other"), other)
    common = F.size(F.array_intersect("words", "_other"))
    return both.select(key, other, common.alias("common"), F.size("_other").alias("n")).where(F.col("common") >= need).drop("n")


def grams(text, size):
    """Column: the distinct runs of ``size`` characters of a text, in one pass over it; for 0 the empty one."""
    if not size:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def runs_of(size):
    return lambda text: grams(text, size)


def first_fitting(messages: DataFrame, rules: DataFrame, message="message") -> DataFrame:
    """(message, ord, template): for every different message the rule of smallest ``ord`` that fits it.

    ``rules`` has ord (unique), fragments and template; a rule fits a message that contains all its
    fragments, in any place. A message that contains a fragment contains its runs of three characters,
    so every rule is joined by the one of its runs that the fewest messages hold: a rule with a
    rare run meets few messages, one with a run that no message holds meets none. A rule whose
    fragments are all shorter is joined by a whole fragment, one without fragments fits everything.
    Null messages and rules with a null ord or fragment fit nothing.

    Of rules with the same fragments only the first counts. Rules are tried in rounds of increasing
    ``ord``, each on the messages that no rule before fits. The rules of a round are sent to the
    messages, so runs are neither stored nor shuffled.
    """
    told = materialise(messages.where(F.col(message).isNotNull()).select(F.col(message).alias("_message")).distinct(), "messages")
    known = rules.where(F.col("ord").isNotNull() & F.forall("fragments", lambda f: f.isNotNull()))
    known = known.groupBy(F.array_sort(F.array_distinct("fragments")).alias("fragments"))
    known = known.agg(F.min(F.struct("ord", "template")).alias("_rule")).select("_rule.*", "fragments")
    longest = F.coalesce(F.array_max(F.transform("fragments", F.length)), F.lit(0))
    known = materialise(known.withColumn("_size", F.least(longest, F.lit(GRAM))), "rules")
    sizes = sorted(r[0] for r in known.select("_size").distinct().collect())  # 0 to GRAM
    held = F.flatten(F.array(*[grams(F.col("_message"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    df = materialise(told.select(F.explode(held).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_df")), "grams")

    own = F.lit(None).cast("array<string>")
    for n in sizes:
        runs = F.array_distinct(F.flatten(F.transform("fragments", runs_of(n))))
        own = F.when(F.col("_size") == n, runs if n else F.array(F.lit(""))).otherwise(own)
    keyed = known.select("ord", "template", "fragments", F.explode(own).alias("_gram")).join(df, "_gram", "left")
    rarest = F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "_gram")).alias("_key")
    keyed = keyed.groupBy("ord", "template", "fragments").agg(rarest).where("_key._df > 0")
    keyed = materialise(keyed.select("ord", "template", "fragments", F.col("_key._gram").alias("_gram")), "keyed-rules")

    fits = F.forall("fragments", lambda f: F.contains("_message", f))
    rule = F.struct("ord", "template").alias("_rule")
    left, found, take = told, keyed.select(F.lit("").alias("_message"), rule).limit(0), FIRST_RULES
    while (last := keyed.select("ord").orderBy("ord").limit(take).agg(F.max("ord")).first()[0]) is not None and not left.isEmpty():
        tried = sent_if_short(keyed.where(F.col("ord") <= F.lit(last)))
        met = left.select("_message", F.explode(held).alias("_gram")).join(tried, "_gram").where(fits)
        best = met.groupBy("_message").agg(F.min(rule).alias("_rule"))
        decided = materialise(left.join(best, "_message", "left"), "decided")
        found = found.unionByName(decided.where("_rule is not null"))
        left, keyed = decided.where("_rule is null").select("_message"), keyed.where(F.col("ord") > F.lit(last))
        take = min(take * 10, SENT_ROWS)
    return found.select(F.col("_message").alias(message), "_rule.ord", "_rule.template")


def fixes_by_table(issues: DataFrame, rules: DataFrame, message="message", line="line") -> DataFrame:
    """Issues with the ``fix`` of the first rule that fits, its ``{line}`` filled in; issues without one are left out."""
    found = issues.join(first_fitting(issues, rules, message), message)
    fix = F.replace(F.col("template"), F.lit("{line}"), F.coalesce(F.col(line).cast("string"), F.lit("")))
    return found.withColumn("fix", fix).drop("ord", "template")
