"""A corpus bigram model: training, log-probability scores, next-token candidates, truncation."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import words
from codeloom.operators.candidates import rank
from codeloom.session import materialise

LOGIT_STEP = 512
CONTEXT = ""  # stands for "any word" in the lookup table; never a word itself


def neighbours(tokens):
    """Array of (prev, tok) for adjacent words of one text, built inside the row."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(tokens, F.lit(1), n).alias("prev"), F.slice(tokens, F.lit(2), n).alias("tok")
    )


@dataclass
class Bigrams:
    """Bigram counts (prev, tok, c) of a corpus."""

    counts: DataFrame

    @classmethod
    def train(cls, texts, text="text", store=True):
        """Words are paired inside their row and counted per task before the one shuffle.

        The counts are read several times by every use of the model, so they are written once
        to the shared folder; ``store=False`` leaves them a lazy plan.
        """
        pairs = texts.select(words(F.col(text)).alias("w")).select(F.inline(neighbours(F.col("w"))))
        counts = pairs.groupBy("prev", "tok").agg(F.count("*").alias("c"))
        return cls(materialise(counts, "bigrams") if store else counts)

    def save(self, path):
        """Store the model; it is trained once and loaded by every job that scores."""
        self.counts.write.parquet(path)

    @classmethod
    def load(cls, spark, path):
        return cls(spark.read.schema("prev string, tok string, c long").parquet(path))

    def contexts(self):
        """(w, n): how often each word of the model is followed by another one."""
        ends = F.array(
            F.struct(F.col("prev").alias("w"), F.col("c").alias("n")),
            F.struct(F.col("tok").alias("w"), F.lit(0).cast("long").alias("n")),
        )
        return self.counts.select(F.inline(ends)).groupBy("w").agg(F.sum("n").alias("n"))

    def score(self, candidates, key, completion, prompt=None, out="score"):
        """Mean log-probability of the words of each candidate; null for a text without words.

        With a ``prompt`` its last word is the context of the first completion word; without
        one the first word has no context and is not scored. ``key`` names the id columns.
        """
        key = list(key)
        tokens = words(F.col(completion))
        if prompt is not None:
            tokens = F.concat(F.slice(words(F.col(prompt)), F.lit(-1), F.lit(1)), tokens)
        pairs = candidates.select(
            *key, F.posexplode(neighbours(tokens)).alias("pos", "pair")
        )
        # Written once: counted for hot keys and joined without reading the texts again.
        pairs = materialise(pairs.select(*key, "pos", "pair.*"), "pairs")
        wanted = pairs.select(
            *key, "pos", "prev", F.explode(F.array(F.col("tok"), F.lit(CONTEXT))).alias("tok")
        )
        # Add-one smoothing: ln((c + 1) / (n + V)) is ln(c + 1) - ln((n + V) / V) - ln(V). The
        # first two are zero for what the corpus has not seen, so an inner join finds them all,
        # and it may broadcast either side: a short list of candidates leaves the model in place.
        contexts = materialise(self.contexts(), "words")  # read for the size and for the terms
        size = contexts.agg(F.count("*").cast("double")).scalar()
        known = self.counts.select("prev", "tok", F.ln(F.col("c") + 1.0).alias("term")).unionByName(
            contexts.where("n > 0").select(
                F.col("w").alias("prev"),
                F.lit(CONTEXT).alias("tok"),
                (-F.ln((F.col("n") + size) / size)).alias("term"),
            )
        )
        # A hash before the two words: rows are sorted by a number, words are compared only where it is equal.
        hashed = [side.withColumn("_hash", F.xxhash64("prev", "tok")) for side in (wanted, known)]
        found = hashed[0].join(hashed[1], ["_hash", "prev", "tok"])
        sums = found.select(*key, "term", F.lit(0).alias("n")).unionByName(
            pairs.select(*key, F.lit(0.0).alias("term"), F.lit(1).alias("n"))
        )
        mean = F.sum("term") / F.sum("n") - F.ln(size)
        return sums.groupBy(*key).agg(mean.alias(out))

    def continuations(self, k=params.TOP_K, p=params.TOP_P, after=None):
        """(prev, tok, p): the truncated next-word distribution of every context.

        ``after`` (prev) limits the work to some contexts.
        """
        counts = self.counts if after is None else self.counts.join(after, "prev", "left_semi")
        return truncate(counts, ["prev"], "c", "tok", k, p)

    def extend(self, prompts, key, prompt="prompt", steps=1, beams=params.STREAM_SUGGESTIONS,
               k=params.TOP_K, p=params.TOP_P):
        """The ``beams`` most probable continuations of ``steps`` words per prompt.

        Every step joins the last word of each beam with at most ``k`` continuations, held as
        one array per context, and keeps the best ``beams`` rows per prompt. For more than two steps
        the arrays of all contexts are stored once, instead of ranking those asked for at every step.
        A beam that ends in a word without continuation is dropped.
        """
        if steps <= 0 or beams <= 0:
            raise ValueError("steps and beams must be positive")
        key = list(key)
        beam = prompts.select(
            *key,
            F.try_element_at(words(F.col(prompt)), F.lit(-1)).alias("prev"),
            F.array().cast("array<string>").alias("path"),
            F.lit(0.0).alias("logp"),
        ).where(F.col("prev").isNotNull())
        listed = lambda found: found.groupBy("prev").agg(F.collect_list(F.struct("tok", "p")).alias("next"))
        whole = materialise(listed(self.continuations(k, p)), "continuations") if steps > 2 else None
        for step in range(steps):
            beam = materialise(beam, "beam") if step else beam
            # In few steps only the words that end a beam are looked up; the rest of the model is not ranked.
            per_context = listed(self.continuations(k, p, after=beam.select("prev").distinct())) if whole is None else whole
            grown = beam.join(per_context, "prev").select(
                *key, "path", "logp", F.inline("next")
            )
            step = grown.select(
                *key,
                F.col("tok").alias("prev"),
                F.concat("path", F.array("tok")).alias("path"),
                (F.col("logp") + F.ln("p")).alias("logp"),
            )
            beam = rank(step, key, "path", n=beams, score="logp")
            result, beam = beam, beam.drop("rank")
        return result.select(*key, "rank", F.array_join("path", " ").alias("completion"), "logp")


def truncate(weights, group, weight, item, k=params.TOP_K, p=params.TOP_P):
    """Top-k, then nucleus truncation of one distribution per group, renormalised as ``p``.

    Integer weights are compared as sums, so the cut does not depend on rounding. After the
    top-k limit, applied per task before the shuffle, a group has at most ``k`` rows.
    """
    best = rank(weights, group, item, n=k, score=weight, out="_place")
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = best.select(
        *group,
        item,
        weight,
        F.coalesce(F.sum(weight).over(before), F.lit(0)).alias("_before"),
        F.sum(weight).over(whole).alias("_total"),
    )
    kept = summed.where(F.col("_before") < F.col("_total") * F.lit(p))
    return kept.select(*group, item, (F.col(weight) / F.sum(weight).over(whole)).alias("p"))


def log_softmax(logits, group, logit, out="logp"):
    """Log-softmax within each group, without a group window.

    The logits are stored once. Peak and scaled sum are one aggregate each, combined per task before
    the shuffle: sums are taken per step of LOGIT_STEP, within which exp cannot overflow, and the
    few steps of a group are scaled to its highest one afterwards. For a hot group,
    adaptive execution splits its part of the join.
    """
    group = list(group)
    logits = materialise(logits, "logits")
    level = F.floor(F.col(logit) / LOGIT_STEP) * LOGIT_STEP
    parts = logits.groupBy(*group, level.alias("_level")).agg(F.sum(F.exp(F.col(logit) - level)).alias("_part"))
    peak = F.max("_level")
    mass = parts.groupBy(*group).agg(
        peak.alias("_max"), F.collect_list(F.struct("_level", "_part")).alias("_parts")
    )
    scaled = F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["_part"] * F.exp(x["_level"] - F.col("_max")))
    mass = materialise(mass.select(*group, (F.col("_max") + F.ln(scaled)).alias("_log_mass")), "mass")
    return logits.join(mass, group).withColumn(out, F.col(logit) - F.col("_log_mass")).drop("_log_mass")


def mean_log_prob(token_logps, key, logp="logp", out="score"):
    """Mean log-probability of the target tokens of each candidate."""
    return token_logps.groupBy(*key).agg(F.avg(logp).alias(out))
