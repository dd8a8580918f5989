"""Toxicity by a weighted lexicon, matched by one Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, reads look-alike letters of other scripts as Latin ones and
digits or signs inside a word as the letters they stand for; what remains is words between single
spaces. A pattern is a whole word or the beginning of a word. Weights are log odds learned from
labelled documents, a match inside an exception phrase does not count, and a text's sum of weights
is divided by the logarithm of its number of words before a logistic curve makes it a score.
"""

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import text_batches
from codeloom.session import materialise

SAMPLE = 20_000  # expected number of labelled rows the lexicon is learned from
PATTERNS = 2_000  # longest lexicon
PREFIXES = range(4, 8)  # lengths of the word beginnings that may become patterns
ODDS = 2.0  # least log odds of a pattern
CHUNK = 1 << 20
HELD = 100_000  # pattern counts a task holds before it sends them on

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d",
}
#: Digits and signs read as letters inside a word (fixed values).
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l",
}
#: Harmless phrases that hold a word of common lexicons; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "stupid simple")

SIGN = re.compile(r"[0-9@$!|](?=[0-9@$!|]{0,2}[^\W\d_])(?<=[^\W\d_].)|[0-9@$!|](?=[^\W\d_]{3})")
GAP = re.compile(r"[\W\d_]+")


def plain_letter(char):
    base = unicodedata.normalize("NFKD", char)[:1].lower()
    return LOOK_ALIKES.get(char.lower(), LOOK_ALIKES.get(base, base))


class Letters(dict):
    """str.translate table that folds a character when it first occurs."""

    def __missing__(self, point):
        char = chr(point)
        if unicodedata.combining(char):
            self[point] = ""
        else:
            self[point] = plain_letter(char) if char.isalpha() and point > 127 else char
        return self[point]


LETTERS = Letters()


def fold(text):
    """Words of a text, folded, each with a space before and after it."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(LETTERS)
    text = SIGN.sub(lambda m: SUBSTITUTES.get(m[0], m[0]), text)
    return f" {GAP.sub(' ', text).strip()} "


def patterns_of(folded):
    """Patterns that a folded text holds: ' word ' and the beginnings ' wor'."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in PREFIXES if n < len(word))
    return found


def choose(table):
    """Lexicon from rows (pattern, toxic, clean): pattern -> weight, most telling first.

    ``table`` has a row with pattern null that counts all documents.
    """
    whole = table[table["pattern"].isna()]
    if not len(whole):
        return {}
    t_all, c_all = float(whole["toxic"].sum()), float(whole["clean"].sum())
    table = table[table["pattern"].notna()].reset_index(drop=True)
    if not len(table) or not t_all or not c_all:
        return {}
    t, c = table["toxic"].to_numpy(float), table["clean"].to_numpy(float)
    odds = np.log((t + 0.5) / (t_all + 1)) - np.log((c + 0.5) / (c_all + 1))
    share = (t + c) / (t_all + c_all)
    term = lambda n, of: n * np.log(np.maximum(n, 1e-9) / np.maximum(of * share, 1e-9))
    rest = lambda n, of: (of - n) * np.log(np.maximum(of - n, 1e-9) / np.maximum(of * (1 - share), 1e-9))
    gain = 2 * (term(t, t_all) + term(c, c_all) + rest(t, t_all) + rest(c, c_all))
    good = (odds >= ODDS) & (gain >= 20) & (t >= 4)
    table = table[good].assign(odds=odds[good], gain=gain[good].round(6), size=table["pattern"][good].str.len())
    table = table.sort_values(["gain", "size", "pattern"], ascending=[False, False, True])
    chosen, counts = {}, {}
    for p, n, w in zip(table["pattern"], table["toxic"], table["odds"]):
        covered = any(p[:k] in chosen for k in range(2, len(p)))
        broader = any(q.startswith(p) and n <= 1.2 * counts[q] for q in chosen)
        if not covered and not broader:
            chosen[p], counts[p] = float(w), n
        if len(chosen) >= PATTERNS:
            break
    return chosen


def automaton(lexicon):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, weight in lexicon.items():
        found.add_word(pattern, (pattern, weight))
    if lexicon:
        found.make_automaton()
    return found


def matches(folded, machine):
    """(start of the word, pattern, weight) of each word that matches, its heaviest pattern."""
    best = {}
    if len(machine):
        for end, (pattern, weight) in machine.iter(folded):
            start = end - len(pattern) + 1
            if start not in best or best[start][1] < weight:
                best[start] = (pattern, weight)
    return [(start, *best[start]) for start in sorted(best)]


def neighbours(folded, start):
    """The two-word phrases around the word that begins after position ``start``."""
    end = folded.index(" ", start + 1)
    word = folded[start + 1 : end]
    before = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
    after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
    return ([f"{before} {word}"] if before else []) + ([f"{word} {after}"] if after else [])


def chunks(text):
    """Parts of a very long text, cut at white space."""
    text, start = text or "", 0
    while len(text) - start > CHUNK:
        cut = max(text.rfind(" ", start, start + CHUNK), text.rfind("\n", start, start + CHUNK))
        cut = start + CHUNK if cut <= start else cut
        yield text[start:cut]
        start = cut
    yield text[start:]


def measure(text, machine, exceptions):
    """Sum of weights over the logarithm of the number of words."""
    total, words = 0.0, 0
    for part in chunks(text):
        folded = fold(part)
        words += folded.count(" ") - 1
        for start, _, weight in matches(folded, machine):
            if not exceptions or not any(p in exceptions for p in neighbours(folded, start)):
                total += weight
    return total / np.log2(2 + max(words, 0))


def curve(x, y):
    """Slope (not negative) and constant of a logistic curve, by Newton steps with a small penalty."""
    a, b = 0.0, 0.0
    x, y = np.asarray(x, float), np.asarray(y, float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.001 * b])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.001]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return max(a, 0.0), b


def learn(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", toxic="toxic", exceptions=EXCEPTIONS):
    """Lexicon, exception phrases and curve, learned from rows that both tables share.

    About SAMPLE labelled rows are drawn by a hash of the id. Pattern counts are folded per task;
    what reaches the driver is the lexicon (PATTERNS), its phrases and a number per sampled row.
    Rows without a label or an id teach nothing; an id with both labels counts once for each.
    """
    text_batches(docs.sparkSession)
    marks = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull())
    marks = marks.select(F.col(key).alias("id"), F.col(toxic).cast("int").alias("y")).distinct()
    share = min(1.0, SAMPLE / max(1, marks.count()))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    drawn = rows.where(draw < share).join(marks.where(draw < share), "id").select("text", "y")
    drawn = materialise(drawn, "labelled")

    def count(batches):
        toxic_in, clean_in, seen = Counter(), Counter(), [0, 0]

        def told():
            names = list(toxic_in.keys() | clean_in.keys())
            rows = [*names, None], [*(toxic_in[n] for n in names), seen[0]], [*(clean_in[n] for n in names), seen[1]]
            return pd.DataFrame({"pattern": pd.Series(rows[0], dtype=object), "toxic": rows[1], "clean": rows[2]})

        for pdf in batches:
            for value, y in zip(pdf["text"], pdf["y"]):
                own = {p for part in chunks(value) for p in patterns_of(fold(part))}
                (toxic_in if y else clean_in).update(own)
                seen[0 if y else 1] += 1
                if len(toxic_in) + len(clean_in) > HELD:
                    yield told()
                    toxic_in, clean_in, seen = Counter(), Counter(), [0, 0]
        yield told()

    told = drawn.mapInPandas(count, "pattern string, toxic bigint, clean bigint")
    told = told.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = F.col("pattern").isNull() | ((F.col("toxic") >= 4) & (F.col("toxic") > F.col("clean") / 4))
    top = told.where(likely).orderBy(F.col("pattern").isNotNull(), F.desc("toxic"), "pattern").limit(20 * PATTERNS)
    lexicon = choose(top.toPandas())

    def phrases(batches):
        machine = automaton(lexicon)
        for pdf in batches:
            for value, y in zip(pdf["text"], pdf["y"]):
                own = set()
                for part in chunks(value):
                    folded = fold(part)
                    for start, _, _ in matches(folded, machine):
                        own.update(neighbours(folded, start))
                yield pd.DataFrame({"phrase": pd.Series(list(own), dtype=object), "y": np.full(len(own), int(bool(y)))})

    around = drawn.mapInPandas(phrases, "phrase string, y int").groupBy("phrase")
    around = around.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    harmless = around.where((F.col("clean") >= 3) & (F.col("clean") >= 9 * F.col("toxic")))
    harmless = harmless.orderBy(F.desc("clean"), "phrase").limit(PATTERNS).collect()
    skip = frozenset({fold(p).strip() for p in exceptions} | {r["phrase"] for r in harmless})

    def values(batches):
        machine = automaton(lexicon)
        for pdf in batches:
            x = [measure(v, machine, skip) for v in pdf["text"]]
            yield pd.DataFrame({"x": x, "y": pdf["y"].astype(bool).astype("int32")})

    points = drawn.mapInPandas(values, "x double, y int").collect()
    points.sort()
    return lexicon, skip, curve([p["x"] for p in points], [p["y"] for p in points]) if points else (1.0, -1.0)


def score(docs: DataFrame, model, key="doc_id", text="text") -> DataFrame:
    """(id, score, predicted, matched) of every row of ``docs``: score from 0 to 1 of the whole text.

    Null and empty texts match nothing and get the score of a text without matches. ``matched`` is
    the normalised sum of weights. Rows are kept as they are, repeated ones too.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        lexicon, skip, (slope, constant) = sent.value
        machine = automaton(lexicon)
        for pdf in batches:
            x = np.array([measure(v, machine, skip) for v in pdf["text"]], float)
            p = 1 / (1 + np.exp(-np.clip(slope * x + constant, -30, 30)))
            yield pd.DataFrame({"id": pdf["id"], "score": p, "predicted": (p >= 0.5).astype("int32"), "matched": x})

    return rows.mapInPandas(run, f"id {kind}, score double, predicted int, matched double")
