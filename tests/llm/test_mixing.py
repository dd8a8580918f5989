"""Mixes: permutations, targets and what is taken, against plain versions."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from codeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(seed=1, docs=300, sources=6):
    draw = random.Random(seed)
    rows = []
    for i in range(docs):
        source = "hot" if draw.random() < 0.4 else draw.choice([f"s{j}" for j in range(sources)] + [None])
        words = " ".join(f"{i}w{k}" for k in range(draw.choice([0, 1, 5, 40, 300])))
        rows.append((i, draw.choice([words, words.replace(" ", "\n\t")]), source))
    return rows


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """source -> target, by resharing what is above the limit until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cut, left = {}, share * sum(sizes.values())
    while True:
        rest = sum(w for s, w in weight.items() if s not in cut)
        target = {s: left * w / rest for s, w in weight.items() if s not in cut}
        above = [s for s in target if target[s] > most * sizes[s]]
        if not above:
            return target | cut
        for s in above:
            cut[s] = most * sizes[s]
            left -= cut[s]


def test_permutations_are_permutations(spark):
    sizes = [1, 2, 3, 5, 16, 17, 100, 1000]
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, x long")
    there = df.withColumn("y", mixing.permuted(F.col("x"), F.col("n"), "p", F.col("n")))
    back = there.withColumn("z", mixing.permuted(F.col("y"), F.col("n"), "p", F.col("n"), back=True)).collect()
    assert all(r.z == r.x and 0 <= r.y < r.n for r in back)
    found = defaultdict(set)
    for r in back:
        found[r.n].add(r.y)
    assert {n: len(v) for n, v in found.items()} == {n: n for n in sizes}
    moved = [r.y for r in sorted(back, key=lambda r: r.x) if r.n == 1000]
    assert sum(a < b for a, b in zip(moved, moved[1:])) in range(420, 580)


def test_targets_and_taken(spark):
    rows = corpus()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += size[i]
    target = filled(by_source)
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5), block=32, per_shard=64)
    docs = mixed.docs.collect()
    taken = Counter()
    for r in docs:
        assert (r.size, r.source_size) == (size[r.id], by_source[r.name])
        assert abs(r.target - target[r.name]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.name] += r.taken
    assert len(docs) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in target)

    pieces = mixed.pieces.collect()
    assert Counter({i: 0 for i in size}) + Counter({r.id: r.taken for r in docs}) == sum((Counter({p.id: p.words}) for p in pieces), Counter())
    slots, uses = defaultdict(list), Counter()
    for p in pieces:
        assert p.shard == p.slot // 64
        slots[p.slot].append((p.at, p.words))
        uses.update((p.id, k) for k in range(p.first, p.first + p.words))
    assert max(uses.values()) <= 2  # no word more than twice
    for own in slots.values():  # pieces of a slot stand side by side
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(n for _, n in own) <= 32
    shards = defaultdict(set)
    for p in pieces:
        shards[p.shard].add(p.rank)
    assert sum(len(s) > 3 for s in shards.values()) > len(shards) // 2  # sources are mixed in every shard


def test_reruns_and_partitions_agree(spark):
    df = spark.createDataFrame(corpus(2, 120), SCHEMA)
    rows = [sorted(tuple(r) for r in mixing.mix(x, block=16, per_shard=32).docs.select("id", "taken").collect()) for x in (df, df.repartition(7))]
    assert rows[0] == rows[1]


def test_texts_of_slots(spark):
    rows = corpus(3, 60)
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA), block=16, per_shard=32, texts=True)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t, _ in rows}
    expected = defaultdict(list)
    for p in sorted(mixed.pieces.collect(), key=lambda p: (p.slot, p.at)):
        expected[p.slot] += words[p.id][p.first : p.first + p.words]
    assert {r.slot: r.text.split(" ") for r in mixing.mixed_texts(mixed).collect()} == dict(expected)


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a  b", "x"), (None, "p q", None), (None, None, None), (2, "", "y"), (3, "z " * 400_000, "w")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "name", "size", "start", "rank", "index", "words", "_part", "cell", "slot"):
        df = df.withColumn(name, F.lit(0))
    found = mixing.mix(df).docs.collect()
    assert sorted((r.id is None, r.id or 0, r.size) for r in found) == [
        (False, 1, 2), (False, 1, 3), (False, 1, 3), (False, 2, 0), (False, 3, 400_000), (True, 0, 0), (True, 0, 2)
    ]
    assert all(r.taken <= 2 * r.size for r in found)
    target = filled({"w": 400_000, "x": 8, "y": 0, None: 2})
    assert {r.name: round(r.target, 3) for r in found} == {s: round(t, 3) for s, t in target.items()}


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).docs.count() == 0
    found = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], SCHEMA)).docs.collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2
