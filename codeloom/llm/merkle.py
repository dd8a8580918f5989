"""Merkle manifests of a table: a digest per row, one tree per group, one tree over the groups.

The rows of a group, in order of their key, are the leaves of its tree; of every level the nodes are
joined two by two, and a last one alone is hashed alone. The root of a group's tree is a leaf of the
tree over the groups. Every leaf gets its witness: the siblings on its way up to the root.

Leaves are dealt into aligned blocks of a fixed number of leaves. A task appends a block's leaves one
after another to a tree that holds only its open subtrees; a subtree that finds its sibling is
closed into the next larger one, and the sibling's digest extends the witnesses begun below either. The
blocks' roots are the leaves of the next round, which appends them in the same way, so a group of any size
never meets in one task; its witnesses are extended by a join on the block.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import sent_if_small
from codeloom.llm.order import running
from codeloom.session import materialise
from codeloom.skew import null_safe_join

LEVELS = 10  # levels of a block
BLOCK = 1 << LEVELS
LONE = ""  # step of a node without a sibling


def joined(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class OpenTree:
    """An append-only tree that holds its open subtrees, largest first, and a witness per leaf.

    A step of a witness is L or R (the side the sibling stands on) and the sibling's digest, or LONE.
    """

    def __init__(self):
        self.open = []  # (height, digest, first leaf)
        self.witnesses = []

    def _extend(self, leaves, step):
        for i in leaves:
            self.witnesses[i].append(step)

    def _push(self, height, digest, first):
        """Adds a whole subtree at the right end; closes every pair of siblings that this completes."""
        while self.open and self.open[-1][0] == height:
            _, left, start = self.open.pop()
            self._extend(range(start, first), "R" + digest)
            self._extend(range(first, len(self.witnesses)), "L" + left)
            height, digest, first = height + 1, joined(left, digest), start
        self.open.append((height, digest, first))

    def append(self, digest):
        self.witnesses.append([])
        self._push(0, digest, len(self.witnesses) - 1)

    def close(self, levels=0):
        """The root, ``levels`` levels up at least; lone nodes at the right end are hashed alone."""
        while len(self.open) > 1 or self.open[0][0] < levels:
            height, digest, first = self.open.pop()
            self._extend(range(first, len(self.witnesses)), LONE)
            self._push(height + 1, joined(digest), first)
        return self.open[0][1]


def _append_block(nodes: pa.Table) -> pa.Table:
    """One aligned block: the witness of each node inside it, and the block's root."""
    nodes = nodes.sort_by("pos")
    tree = OpenTree()
    for digest in nodes["digest"].to_pylist():
        tree.append(digest)
    root = tree.close(LEVELS if nodes["total"][0].as_py() > BLOCK else 0)
    nodes = nodes.append_column("steps", pa.array(tree.witnesses, pa.list_(pa.string())))
    return nodes.append_column("top", pa.array([root] * len(nodes), pa.string()))


def witnesses(nodes: DataFrame) -> DataFrame:
    """Adds ``steps`` and ``top`` (the tree's root) to nodes (tree, pos, total, digest, anything else); stored.

    ``pos`` counts from 0 within a tree, ``total`` is the tree's number of nodes.
    """
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint"))
    added = T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("top", T.StringType())
    schema = T.StructType([*blocks.schema.fields, *added])
    done = materialise(blocks.groupBy("tree", "block").applyInArrow(_append_block, schema), "blocks")
    heads = done.where(f"total > {BLOCK} and pos = block * {BLOCK}").select(
        "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).cast("bigint").alias("total"), F.col("top").alias("digest")
    )
    if heads.isEmpty():
        return done.drop("block")
    above = witnesses(heads).select(
        "tree", F.col("pos").alias("block"), F.col("steps").alias("_steps"), F.col("top").alias("_top")
    )
    more = F.concat("steps", F.coalesce("_steps", F.array().cast("array<string>")))
    both = done.join(above, ["tree", "block"], "left")
    both = both.withColumns({"steps": more, "top": F.coalesce("_top", "top")})
    return materialise(both.drop("_steps", "_top", "block"), "witnesses")


def leaf_digest(*values):
    """Column: SHA-256 (lowercase hex) of values, each ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for value in values:
        written = value.cast("string")
        parts += [F.when(written.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written))]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(df: DataFrame, key="doc_id", group="lang", fields=("doc_id", "source", "lang", "n_chars", "text"), claim=None) -> DataFrame:
    """(id, leaf, subroot, root, steps, claim), one row per row of ``df``; stored.

    Leaves ascend by ``key`` (null first; equal keys by digest) within ``group``, groups ascend bytewise, null
    first. ``claim`` is a digest column that is carried along, to be checked with ``folded``. Null
    fields are written as ``-``; a null key or group is a value like any other; repeated rows are leaves of
    their own. An empty table gives no rows. Other columns are not read.
    """
    leaves = df.select(
        F.col(group).alias("name"), F.col(key).alias("id"), leaf_digest(*map(F.col, fields)).alias("digest"),
        (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
    )
    leaves = running(leaves, ["name", "id", "digest"], place=F.lit(1))
    groups = leaves.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("total"))
    groups = running(groups, ["name"], tree=F.lit(1))
    nodes = null_safe_join(leaves, sent_if_small(groups), "name").withColumn("pos", F.col("place") - F.col("first"))
    rows = witnesses(nodes.select("tree", "pos", "total", "digest", "id", "claim"))
    roots = rows.where("pos = 0").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(groups.count()).alias("total"), F.col("top").alias("digest")
    )
    tops = witnesses(roots).select(F.col("pos").alias("tree"), F.col("steps").alias("upper"), F.col("top").alias("root"))
    whole = rows.join(sent_if_small(tops, 10_000), "tree")
    return whole.select(
        "id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("steps", "upper").alias("steps"), "claim"
    )


def folded(leaf, steps):
    """Column: the root that a leaf and the steps of a witness give."""

    def up(digest, step):
        other = F.substring(step, 2, 64)
        pair = F.when(step.startswith("L"), F.concat(other, digest)).when(step.startswith("R"), F.concat(digest, other))
        return F.sha2(F.coalesce(pair, digest).cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


def proof_digest(steps):
    """Column: SHA-256 of a witness's siblings, from the leaf up."""
    siblings = F.transform(F.filter(steps, lambda s: s != LONE), lambda s: F.substring(s, 2, 64))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)
