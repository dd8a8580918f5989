"""Toxicity and language: folding, exceptions, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest

from codeloom.llm import langid, toxicity


def test_folding():
    assert toxicity.fold("An IDI0T, а сlown & l0s3r!") == " an idiot a clown loser "
    assert toxicity.fold("Ünïcödé ß 2024 $$$ x") == " unicode ß x "
    assert toxicity.fold(None).split() == toxicity.fold("").split() == []


def test_matches_are_whole_words_or_beginnings():
    machine = toxicity.automaton({" scum ": 2.0, " vile": 3.0})
    assert [m[1:] for m in toxicity.matches(toxicity.fold("scummy SCUM vileness"), machine)] == [(" scum ", 2.0), (" vile", 3.0)]
    assert toxicity.measure("pond scum", machine, frozenset({"pond scum"})) == 0
    assert toxicity.measure("more scum", machine, frozenset({"pond scum"})) > 0
    assert toxicity.measure("clean " * 400 + "scum", machine, frozenset()) < toxicity.measure("scum", machine, frozenset())
    assert toxicity.matches(" a b ", toxicity.automaton({})) == []


def labelled():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("bcdefghiklmnop") for _ in range(5))
    docs, labels = [], []
    for i in range(900):
        own = [word() for _ in range(draw.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            own.insert(draw.randrange(len(own)), draw.choice(["stinker", "st1nker", "Rotten", "rоtten"]))
        elif i % 24 == 1:
            own += ["rotten", "apple"]  # harmless there
        docs.append((i, " ".join(own)))
        labels.append((i, int(bad), None))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    odd = [(5000, None), (5001, ""), (None, "rotten stinker"), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, 0.5) for d in docs + odd], "doc_id bigint, text string, score double").repartition(3)
    table = spark.createDataFrame(labels + [(7, None, 1), (None, 1, 1)], "doc_id bigint, toxic int, text int")
    model = toxicity.learn(df, table.where("doc_id % 5 <> 0 or doc_id is null"))
    got = {}
    for r in toxicity.score(df, model).collect():
        got.setdefault(r.id, r)
    held = [i for i in range(0, 900, 5)]
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert got[5000].score == got[5001].score < 0.5 and got[None].predicted == 1
    assert toxicity.score(df.limit(0), model).count() == 0
    nothing = toxicity.learn(df.limit(0), table)
    assert toxicity.score(df, nothing).count() == len(docs) + len(odd)


LANGUAGES = {"en": ("the and ing tion of th er", 0), "de": ("der die und sch ung ein ß ä", 1), "fr": ("le que eau é tion ç", 2), "es": ("el ción ñ que ado ó", 3)}


def test_language_on_held_out_rows(spark):
    draw = random.Random(5)
    rows = []
    for i in range(600):
        name = draw.choice(list(LANGUAGES))
        parts = LANGUAGES[name][0].split()
        text = " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(8, 60)))
        rows.append((i, text, name if i % 9 else None, name))
    odd = [(900, None, "en", ""), (901, "", "en", ""), (902, "12 %% 3", None, ""), (None, rows[1][1], "fr", ""), (1, rows[1][1], None, "")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, lang_pred string").repartition(3)
    model = langid.train(df.where("doc_id % 4 <> 2"))
    got = {}
    for r in langid.predict(df, model).collect():
        got.setdefault(r.id, r)
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([got[i].lang_pred == name for i, _, _, name in held]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.train(df.limit(0))).collect()} == {"und"}
    kept = langid.predict(df, model, keep=df.columns)
    assert kept.columns == [*df.columns, "lang_pred_", "score_"] and kept.count() == len(rows) + len(odd)


def test_one_language_alone():
    x = np.stack([langid.vector(t) for t in ("the cat", "a dog", "the hen")])
    model = langid.fit(x, ["en", "en", "en"])
    best, score = langid.classify(model, x)
    assert best.tolist() == [0, 0, 0] and score == pytest.approx([1, 1, 1])
