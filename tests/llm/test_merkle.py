"""Merkle manifests against a plain level-by-level version."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from codeloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    steps = []
    for level in tree[:-1]:
        steps.append("" if i ^ 1 >= len(level) else "RL"[i % 2] + level[i ^ 1])
        i //= 2
    return steps


def plain(rows):
    """Sorted (id, leaf, subroot, root, steps) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        leaf = digest(*map(written, row))
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([leaf for _, _, leaf in sorted(groups[name])]) for name in names]
    top = levels([tree[-1][0] for tree in trees])
    found = []
    for g, name in enumerate(names):
        for i, (given, key, leaf) in enumerate(sorted(groups[name])):
            found.append((key if given else None, leaf, trees[g][-1][0], top[-1][0], way(trees[g], i) + way(top, g)))
    return sorted(found, key=repr)


def computed(df, **more):
    return sorted(((r.id, r.leaf, r.subroot, r.root, list(r.steps)) for r in merkle.manifest(df, **more).collect()), key=repr)


def test_open_tree_for_every_size():
    for n in range(1, 70):
        leaves = [digest(str(i)) for i in range(n)]
        tree, whole = merkle.OpenTree(), levels(leaves)
        for leaf in leaves:
            tree.append(leaf)
            assert len(tree.open) <= n.bit_length()
        assert tree.close() == whole[-1][0]
        assert tree.witnesses == [way(whole, i) for i in range(n)]


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i, f"s{i % 3}", "en" if i % 3 else "fr", i, f"text {i}") for i in range(150)]
    rows += [(1000 + i, None, "de", None, None) for i in range(17)] + [(2000 + i, "s", f"l{i}", 1, "x") for i in range(7)]
    assert computed(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [
        (1, "a", None, 3, "abc"), (1, "a", None, 3, "abc"), (1, "b", None, 3, "abd"), (None, None, None, None, None),
        (None, None, None, None, None), (2, "ä", "", 0, ""), (3, "x", "é", 1, "é" * 1_500_000), (4, "x", "en", 1, "-"),
    ]
    assert computed(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_single_and_clashing_columns(spark):
    assert computed(spark.createDataFrame([], SCHEMA)) == []
    one = [(7, "s", "en", 1, "t")]
    df = spark.createDataFrame(one, SCHEMA)
    assert computed(df) == plain(one)
    for name in ("id", "name", "digest", "claim", "tree", "pos", "total", "place", "_part", "steps", "top", "block"):
        df = df.withColumn(name, F.lit("x"))
    assert computed(df) == plain(one)


def test_tampered_leaves_do_not_fold_to_the_root(spark):
    rows = [(i, "s", "en", i, "t") for i in range(2500)]
    df = spark.createDataFrame(rows, SCHEMA)
    fake = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    found = merkle.manifest(df, claim=F.when(F.col("doc_id") % 5 == 0, fake))
    root = merkle.folded(F.coalesce("claim", "leaf"), F.col("steps"))
    state = found.select("id", (root == F.col("root")).alias("ok"), (merkle.folded(F.col("leaf"), F.col("steps")) == F.col("root")).alias("own"))
    assert all(r.own and r.ok == (r.id % 5 != 0) for r in state.collect())
    proof = found.where("id = 11").select(merkle.proof_digest(F.col("steps")).alias("p"), "steps").first()
    assert proof.p == digest(*[s[1:] for s in proof.steps if s])
