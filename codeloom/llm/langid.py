"""Language of a text in two steps: its family, then linear support vector machines one against one.

Features are hashed character n-grams (one to three, with word edges) of the whole text, square
roots of their counts, at unit length. A softmax regression tells families apart; within a family a
support vector machine for each pair of languages votes. Training uses at most about PER_LANGUAGE
documents of each language and SAMPLE in all, drawn by a hash of the id; every language is learned, and
every prediction reads the whole text.
"""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from codeloom.llm.common import free_name, text_batches

DIMENSIONS = 2048
PER_LANGUAGE = 500  # expected number of training documents of a language
SAMPLE = 32_000  # expected number of all training documents, at most
CHUNK = 1 << 20  # characters counted at once
UNKNOWN = "und"
#: Families of language codes; a code that is in none is a family by itself.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def family_of(language):
    return FAMILY_OF.get(language.lower().split("-")[0], language)


def counts(text):
    """Hashed n-gram counts of a text, None if it has no letter."""
    total = None
    for start in range(0, len(text or ""), CHUNK):
        part = text[start : start + CHUNK].lower()
        points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        letter = LETTER[points]
        if not letter.any():
            continue
        points = np.where(letter, points, np.uint64(32))
        keep = letter | np.r_[True, letter[:-1]]  # one space between words
        points = np.r_[np.uint64(32), points[keep], np.uint64(32)]
        own = np.zeros(DIMENSIONS, np.int64)
        gram = np.zeros(len(points), np.uint64)
        for n in range(3):
            gram = (gram[: len(points) - n] * np.uint64(0x100000001B3)) ^ points[n:]
            spread = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)
            own += np.bincount(spread.astype(np.int64), minlength=DIMENSIONS)
        total = own if total is None else total + own
    return total


def vector(text):
    """Unit feature vector, None without a letter."""
    own = counts(text)
    if own is None:
        return None
    own = np.sqrt(own.astype(np.float32))
    return own / np.linalg.norm(own)


def softmax(x):
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit_families(x, y, classes, rounds=300, rate=20.0, shrink=1e-5):
    """Weights (with a last row of constants) of a softmax regression, by plain gradient steps."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    want = np.eye(classes, dtype=np.float32)[y]
    share = 1 / np.maximum(want.sum(0), 1)
    each = share[y][:, None] / classes
    w = np.zeros((x.shape[1], classes), np.float32)
    for _ in range(rounds):
        w -= rate * (x.T @ ((softmax(x @ w) - want) * each) + shrink * w)
    return w


def fit_svm(x, y, rounds=15, cost=10.0):
    """Weights and constant of a linear support vector machine, by dual coordinate descent."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    square = (x * x).sum(1)
    weight = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (y[i] * (x[i] @ w) - 1) / square[i]
            new = min(max(alpha[i] - step, 0), weight[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def fit(x, languages):
    """Model of feature rows and their languages: names, families, family weights, machines."""
    names = sorted(set(languages))
    families = sorted({family_of(n) for n in names})
    y = np.array([names.index(n) for n in languages])
    home = np.array([families.index(family_of(n)) for n in names])
    machines = {}
    for a, b in itertools.combinations(range(len(names)), 2):
        if home[a] == home[b]:
            own = (y == a) | (y == b)
            machines[a, b] = fit_svm(x[own], np.where(y[own] == a, 1.0, -1.0))
    return names, home, fit_families(x, home[y], len(families)), machines


def train(df: DataFrame, key="doc_id", text="text", lang="lang", per_language=PER_LANGUAGE):
    """Model learned from the rows of ``df`` that have a language and a letter; None without any.

    About ``per_language`` rows of each language, fewer where that would make more than SAMPLE in all,
    are drawn by a hash of the id; their feature vectors, about SAMPLE * 8 KB at most, go to the driver.
    A language with few rows gives all of them.
    """
    text_batches(df.sparkSession)
    rows = df.where(F.col(lang).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")
    )
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    if not sizes:
        return None
    per_language = min(per_language, max(1, SAMPLE // len(sizes)))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], per_language / r["count"])])
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < share[F.col("lang")])

    def run(batches):
        for pdf in batches:
            for name, value in zip(pdf["lang"], pdf["text"]):
                own = vector(value)
                if own is not None:
                    yield pd.DataFrame({"lang": [name], "x": [own.tobytes()]}, dtype=object)

    found = drawn.select("lang", "text").mapInPandas(run, "lang string, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in found]), [r["lang"] for r in found])


def classify(model, rows):
    """Language index and score of feature rows."""
    names, home, weights, machines = model
    sure = softmax(np.c_[rows, np.ones(len(rows), np.float32)] @ weights)
    family = sure.argmax(1)
    votes, margin = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
    for (a, b), w in machines.items():
        side = rows @ w[:-1] + w[-1]
        for language, sign in ((a, side), (b, -side)):
            votes[:, language] += sign > 0
            margin[:, language] += sign
    rank = votes + 0.5 * np.tanh(margin)  # more votes first, then the larger margin
    rank[home[None, :] != family[:, None]] = -np.inf
    best = rank.argmax(1)
    rivals = np.array([max(1, (home == h).sum() - 1) for h in home])[best]
    closest = 1 / (1 + np.exp(-4 * margin[np.arange(len(rows)), best] / rivals))
    alone = np.array([(home == h).sum() == 1 for h in home])[best]
    return best, sure[np.arange(len(rows)), family] * np.where(alone, 1.0, closest)


def predict(df: DataFrame, model, key="doc_id", text="text", keep=None, names=None) -> DataFrame:
    """(id, lang_pred, score) of every row of ``df``, from the whole text.

    With ``keep``, a list of columns, these stay and two columns ``names`` (lang_pred_, score_) are added
    instead, which must not be among them.
    ``und`` with score 0 for a text that is null or has no letter, and for all when nothing was
    learned. Rows are kept as they are, repeated ones too.
    """
    text_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    own = [F.col(key).alias("id")] if keep is None else [F.col(c) for c in keep]
    names = names or (("lang_pred", "score") if keep is None else ("lang_pred_", "score_"))
    last = free_name(df, "_text")
    rows = df.select(*own, F.col(text).cast("string").alias(last))
    schema = rows.drop(last).schema.add(names[0], StringType()).add(names[1], DoubleType())

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for start in range(0, len(texts), 256):
                known, stack = [], []
                for i, value in enumerate(texts[start : start + 256].to_pylist(), start):
                    one = vector(value) if sent.value else None
                    if one is not None:
                        known.append(i)
                        stack.append(one)
                if known:
                    best, score[known] = classify(sent.value, np.stack(stack))
                    for i, b in zip(known, best):
                        found[i] = sent.value[0][b]
            columns = [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
