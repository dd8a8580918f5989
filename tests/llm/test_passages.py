"""Benchmark passages and licences on small tables; the whole tables are checked by SQL."""

import random

import pytest

from codeloom.llm import decontaminate, licenses


def words(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_leaks(spark):
    draw = random.Random(3)
    items = [words(draw, n) for n in (20, 40, 40, 60, 300, 4)]
    bench = [(i, " ".join(w), "clash") for i, w in enumerate(items)] + [(None, "x " * 20, "c"), (9, None, "c"), (8, "", "c"), (0, " ".join(items[0]), "c")]
    fill = lambda n: " ".join(words(draw, n))
    edited = list(items[1])
    edited[38] = "other"
    broken = [w if i % 4 else "no" for i, w in enumerate(items[2])]
    docs = [
        (0, fill(30) + " " + ", ".join(items[0]).upper() + " " + fill(10)),
        (1, fill(5) + " " + " ".join(edited)),
        (2, " ".join(broken)),
        (3, fill(500)),
        (4, fill(40) + " " + " ".join(items[4][:200]) + " " + fill(3)),
        (5, " ".join(items[3][:56])),
        (6, " ".join(items[5]) + " " + fill(20)),
        (7, None),
        (8, ""),
        (None, " ".join(items[0])),
        (0, fill(30)),
        (11, fill(2000) + " " + " ".join(items[3]) + " " + fill(2000) + " " + " ".join(items[0])),
    ]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id bigint, text string, similarity double").repartition(3)
    table = spark.createDataFrame(bench, "item_id bigint, text string, n string")
    for pieces, more in ((True, {(4, 4): 1.0}), (False, {})):  # two thirds of an item: a piece of it, but not the item
        got = {(r.id, r.item): round(r.similarity, 3) for r in decontaminate.leaks(df, table, pieces=pieces).collect()}
        assert got.pop((1, 1)) > 0.8
        assert got.pop((5, 3)) > 0.9
        assert got == {(0, 0): 1.0, (None, 0): 1.0, (11, 3): 1.0, (11, 0): 1.0} | more
    assert decontaminate.leaks(df.limit(0), table).count() == 0
    assert decontaminate.leaks(df, table.limit(0)).count() == 0


def test_licenses(spark):
    docs = [
        (0, "Some words.\nReleased under the MIT License.\nMore"),
        (1, "licensed  under the APACHE license -- version 2.0"),
        (2, "a license is a permit of the kind that is released by an office"),
        (3, None),
        (4, ""),
        (4, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
        (None, "This is free and unencumbered software released into the public domain"),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, license string")
    got = {(r.id, r.license) for r in licenses.licenses(df, licenses.template_table(spark)).collect()}
    assert got == {(0, "MIT"), (1, "Apache-2.0"), (4, "CC-BY-NC-4.0"), (None, "Unlicense")}
    assert licenses.licenses(df.limit(0), licenses.template_table(spark)).count() == 0


@pytest.mark.parametrize("bits", [64])
def test_blocks_guarantee_the_radius(spark, bits):
    from pyspark.sql import functions as F

    draw = random.Random(6)
    rows = []
    for i in range(300):
        a = draw.getrandbits(bits)
        b = a
        for k in draw.sample(range(bits), draw.randint(0, decontaminate.RADIUS)):
            b ^= 1 << k
        rows.append((i, a - (a >> 63 << 64), b - (b >> 63 << 64)))
    df = spark.createDataFrame(rows, "i int, a bigint, b bigint")
    left = df.select("i", F.inline(decontaminate.blocks("a")))
    right = df.select("i", F.inline(decontaminate.blocks("b")))
    assert left.join(right, ["i", "block", "value"]).select("i").distinct().count() == 300


def shingled(text):
    own = text.lower().split()
    return [tuple(own[i : i + 5]) for i in range(len(own) - 4)]


def test_long_templates_are_compared_whole(spark):
    draw = random.Random(8)
    short, long = words(draw, 250), words(draw, 600)
    rolled = long[:300] + long[:300] + words(draw, 40)  # repeats half of itself: distinct shingles count
    templates = [("short", short), ("long", long), ("rolled", rolled)]
    fill = lambda n: words(draw, n)
    edited = [w if i % 60 else "edit" for i, w in enumerate(long)]
    docs = [
        (0, fill(50) + long[:200] + fill(30)), (1, fill(700) + long + fill(20)), (2, edited + fill(5)),
        (3, long[:500]), (4, long[:300] + fill(400) + long[300:]), (5, fill(9) + short[:210]), (6, short[:190] + fill(60)),
        (7, rolled), (None, long[60:]),
    ]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    table = licenses.template_table(spark, [(n, " ".join(t)) for n, t in templates])
    expected = {}
    for i, text in docs:
        places = shingled(" ".join(text))
        for name, template in templates:
            own, n = set(shingled(" ".join(template))), len(template) - 4
            share = max(len(own.intersection(places[s : s + n])) / len(own) for s in range(max(1, len(places))))
            if share >= 0.8:
                expected[i, name] = round(share, 6)
    got = {(r.id, r.license): round(r.share, 6) for r in licenses.licenses(df, table).collect()}
    assert got == expected and (0, "long") not in got and {(1, "long"), (2, "long"), (5, "short"), (7, "rolled")} <= set(got)


def test_few_pairs_are_compared_and_none_is_lost(spark):
    from pyspark.sql import functions as F

    from codeloom.llm import passages

    draw = random.Random(4)
    items = [words(draw, 40) for _ in range(400)]
    docs = []
    for i in range(150):
        text = words(draw, 20)
        for _ in range(3):
            own = list(draw.choice(items))
            for k in draw.sample(range(40), draw.choice([0, 0, 1, 2])):
                own[k] = "edit"
            text += own + words(draw, 10)
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows, marks, vocabulary = decontaminate.item_tables(bench)
    inside = passages.windows(passages.hits(df, vocabulary)).groupBy(*decontaminate.WINDOW, "size", "h", "w").agg(F.count("*").alias("seen"))
    own = inside.withColumn("weight", F.col("w") * F.col("seen")).groupBy(*decontaminate.WINDOW)
    own = own.agg(decontaminate.fingerprint(w="weight").alias("mark"))
    met = decontaminate.candidates(inside, own, rows, marks).count()
    assert 0 < met < 0.05 * own.count() * len(items)
    got = {(r.id, r.item) for r in decontaminate.leaks(df, bench).collect()}
    exact = set()
    for i, text in docs:
        places = shingled(text)
        for k, item in enumerate(items):
            known = set(shingled(" ".join(item)))
            for s in range(len(places)):
                if len(known.intersection(places[s : s + 36])) >= 32 and (i, k) not in exact:  # all weigh the same: 32 / 40 = 0.8
                    exact.add((i, k))
    assert exact <= got
