"""Snippet vectors, exact nearest neighbours and prompt assembly."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import words
from codeloom.operators.candidates import rank
from codeloom.session import materialise

PACK_ROWS = 20000  # snippet vectors a task holds at once
QUERY_BATCH = 4096  # query vectors compared with a pack at once
MATRIX_CELLS = 1 << 21  # distances a task works on at once
PIVOTS, RINGS = 1024, 64  # pivots at most, and rings around each


def with_embedding(texts, text="text", dim=params.EMBEDDING_DIM, out="embedding"):
    """Add the feature-hashed, L2-normalised word counts; null for a text without words.

    Counted inside the row, in one pass over its sorted bucket numbers: a run of equal numbers ends
    where the next one differs, and the places of the ends give the counts. No explode, no shuffle. Explode
    the vector with an outer generator only, and filter before: a filter on it would be moved below and
    count anew for every element.
    """
    bucket = lambda word: F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int") % dim
    hashed = F.transform(words(F.col(text)), bucket)
    ordered = F.sort_array(F.concat(hashed, F.sequence(F.lit(0), F.lit(dim))))  # every bucket once more than it occurs

    def ends_of(numbers):
        differs = lambda x, i: x != F.coalesce(F.get(numbers, i + 1), F.lit(-1))
        return F.array_compact(F.transform(numbers, lambda x, i: F.when(differs(x, i), i)))

    def counts_of(ends):
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(-1)
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.get(ends, i) - before(i) - 1).cast("double"))

    def unit_of(counts):
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
        return once(norm, lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))

    return texts.withColumn(out, once(once(once(ordered, ends_of), counts_of), unit_of))


def once(value, use):
    """``use`` of a column that is worked out once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def embed(texts, key, text="text", dim=params.EMBEDDING_DIM, out="embedding"):
    """(key, vector) of every text that has words."""
    told = texts.select(key, text).where(F.size(words(F.col(text))) > 0)
    return with_embedding(told, text, dim, out).select(key, out)


def best_rows(found, k):
    return found.sort_values(["q", "distance", "id"], kind="stable").groupby("q").head(k)


def pack_search(k, key, vector):
    """A mapInPandas function over rows sorted by (pack, side): the snippets of a pack, then queries.

    A task holds one pack and one batch of queries at a time, and gives out ``k`` rows per query
    and pack. Matrix products pick the rows that can be among the nearest; their distances are then
    taken term by term, so equal vectors get equal distances.
    """

    def nearest_of(rows, ids, matrix, squares):
        near = (rows**2).sum(axis=1)[:, None] + squares[None, :] - 2.0 * rows @ matrix.T
        slack = 1e-9 * (1.0 + np.abs(near).max())
        last = min(k, len(rows)) - 1
        i, j = np.nonzero(near <= np.partition(near, last, axis=0)[last] + slack)
        distance = np.concatenate(
            [((rows[a] - matrix[b]) ** 2).sum(axis=1) for a, b in pieces(i, j)]
        )
        return best_rows(pd.DataFrame({"q": j, "id": ids[i], "distance": distance}), k)

    def search(ids, rows, asked):
        matrix = np.stack(asked[vector].to_numpy()).astype(np.float64)
        squares, found = (matrix**2).sum(axis=1), None
        step = max(1, MATRIX_CELLS // len(matrix))
        for start in range(0, len(ids), step):
            hits = nearest_of(rows[start : start + step], ids[start : start + step], matrix, squares)
            found = hits if found is None else best_rows(pd.concat([found, hits]), k)
        names = asked["query_id"].to_numpy()
        return pd.DataFrame({"query_id": names[found["q"]], key: found["id"], "distance": found["distance"]})

    def run(batches):
        pack, ids, rows = None, [], []
        for batch in batches:
            for (number, side), part in batch.groupby(["pack", "side"], sort=True):
                if number != pack:
                    pack, ids, rows = number, [], []
                if side == 0:
                    ids.append(part[key].to_numpy())
                    rows.append(np.stack(part[vector].to_numpy()).astype(np.float64))
                elif ids:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                    for start in range(0, len(part), QUERY_BATCH):
                        yield search(ids[0], rows[0], part.iloc[start : start + QUERY_BATCH])

    return run


def pieces(i, j, size=1 << 16):
    """Index pairs in pieces, so that many ties cannot blow up the difference array."""
    for start in range(0, max(len(i), 1), size):
        yield i[start : start + size], j[start : start + size]


def pivots_of(stored, key, vector, number):
    """Up to ``number`` different vectors drawn by a hash of their key, as a matrix; a bounded sample."""
    drawn = stored.select(vector).orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(number).collect()
    return np.unique(np.array([r[0] for r in drawn], np.float64), axis=0)


def from_pivots(rows, pivots):
    """Distances of rows to all pivots."""
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2.0 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def with_pivot(pivots, vector):
    """A mapInPandas function that adds each row's nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            if len(batch):
                away = from_pivots(np.stack(batch[vector].to_numpy()).astype(np.float64), pivots)
                yield batch.assign(pivot=away.argmin(axis=1), away=away.min(axis=1))

    return run


def packs_to_ask(packs, pivots, k, vector, second):
    """A mapInPandas function: (pack, query_id, vector) of the packs that a query goes to.

    ``packs`` holds pack, pivot, the least and largest distance of its rows from the pivot, and their
    number. By the triangle inequality no row of a pack is nearer to a query than the distance from the
    query's own distance to that ring. First a query goes to the packs that come first by this bound, until they hold k
    rows; the second time to the others whose bound is within ``reach``, the distance found for the k-th.
    """
    number, pivot, lo, hi, rows = packs

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), QUERY_BATCH):
                part = batch.iloc[start : start + QUERY_BATCH]
                if not len(part):
                    continue
                asked = np.stack(part[vector].to_numpy()).astype(np.float64)
                away = from_pivots(asked, pivots)
                slack = 1e-6 * (1.0 + np.abs(asked).max() + hi.max() + away.max())  # rounding of the distances
                out = []
                step = max(1, MATRIX_CELLS // len(number))
                for at in range(0, len(part), step):
                    own = away[at : at + step][:, pivot]
                    bound = np.maximum(np.maximum(own - hi, lo - own), 0.0)
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(rows[order], axis=1) - rows[order]
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    wanted = first
                    if second:
                        wanted = ~first & (bound <= part["reach"].to_numpy()[at : at + step, None] + slack)
                    q, p = np.nonzero(wanted)
                    out.append((q + at, number[p]))
                q, p = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"pack": p, "query_id": part["query_id"].to_numpy()[q], vector: part[vector].to_numpy()[q]})

    return run


def packed(stored, key, vector, pack_rows):
    """Rows with ``pack`` (stored), and the packs as arrays, with their pivots.

    Rows belong to their nearest pivot; a pivot with more than ``pack_rows`` rows is cut into rings by
    distance, and a ring of very many equal distances by a hash of the key.
    """
    rows = stored.count()
    cells = min(PIVOTS, max(1, math.ceil(rows / pack_rows)))
    pivots = pivots_of(stored, key, vector, cells)
    if not len(pivots):
        return None, None, pivots
    schema = stored.select(key, vector).schema.add("pivot", "long").add("away", "double")
    placed = materialise(stored.select(key, vector).mapInPandas(with_pivot(pivots, vector), schema), "placed")
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("away", [i / RINGS for i in range(1, RINGS)]).alias("at"))
    sizes = sizes.withColumn("rings", F.least(F.ceil(F.col("n") / pack_rows), F.lit(RINGS)))
    # of RINGS cuts as many as the pivot needs, evenly
    used = F.filter("at", lambda x, i: F.floor((i + 1) * F.col("rings") / RINGS) > F.floor(i * F.col("rings") / RINGS))
    sizes = F.broadcast(sizes.select("pivot", used.alias("cuts")))  # at most PIVOTS rows
    ring = F.size(F.filter("cuts", lambda c: c < F.col("away")))
    ringed = materialise(placed.join(sizes, "pivot").withColumn("ring", ring).drop("cuts"), "rings")
    parts = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / (2 * pack_rows)).cast("int").alias("parts"))
    ringed = ringed.join(F.broadcast(parts), ["pivot", "ring"])  # at most PIVOTS * RINGS rows
    own = ringed.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("parts")))
    table = own.groupBy("pivot", "ring", "part").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.count("*").alias("rows"))
    table = sorted(tuple(r) for r in table.collect())  # about rows / pack_rows, six numbers each
    names = own.sparkSession.createDataFrame([(i, *r[:3]) for i, r in enumerate(table)], "pack int, pivot long, ring int, part long")
    dealt = materialise(own.join(names, ["pivot", "ring", "part"]).select("pack", key, vector), "packs")
    columns = [np.array(c) for c in zip(*table)]
    return dealt, (np.arange(len(table)), columns[0], columns[3], columns[4], columns[5]), pivots


def nearest(snippets, queries, k=params.RETRIEVAL_K, key="snippet_id", vector="embedding",
            query_key="query_id", query_vector="embedding", pack_rows=PACK_ROWS, visits=None):
    """(query_id, key, distance, rank): the ``k`` nearest snippets by squared L2 distance.

    Exact. Snippets are dealt into packs by their nearest pivot and the distance from it. A query goes first to
    the packs nearest to it that hold ``k`` rows; the k-th distance found there bounds the search, and by
    the triangle inequality only packs whose ring of distances can hold something as near are asked
    as well. Queries go to packs by shuffle and pass them batch by batch, nothing reaches the driver but a bounded
    sample of pivots and one row per pack, and no pair table exists. A query id that repeats is asked
    once, with its smallest vector; rows without a vector are left out. ``visits``, a list, gets the
    number of packs, of queries and of their visits.
    """
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).alias(vector))
    asked = asked.where(F.col(vector).isNotNull()).groupBy("query_id").agg(F.min(vector).alias(vector))
    stored = materialise(snippets.select(key, vector), "snippets").where(F.col(vector).isNotNull())
    asked = asked.select("query_id", F.col(vector).cast(stored.schema[vector].dataType).alias(vector))
    kind, query_kind = stored.schema[key].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    result = f"query_id {query_kind}, `{key}` {kind}, distance double"

    def search(sent, dealt, packs):
        both = dealt.withColumn("side", F.lit(0)).unionByName(sent.withColumn("side", F.lit(1)), allowMissingColumns=True)
        both = both.repartition(packs, "pack").sortWithinPartitions("pack", "side")
        return both.mapInPandas(pack_search(k, key, vector), result)

    def best(found):
        return rank(found.withColumn("_near", -F.col("distance")), ["query_id"], key, n=k, score="_near").drop("_near")

    if stored.limit(pack_rows + 1).count() <= pack_rows:  # one pack holds them all
        one = F.lit(0).alias("pack")
        if visits is not None:
            visits.append((1, asked.count(), asked.count()))
        return best(search(asked.select(one, "query_id", vector), stored.select(one, key, vector), 1))
    asked = materialise(asked, "queries")
    dealt, packs, pivots = packed(stored, key, vector, pack_rows)
    number = len(packs[0])
    sends = f"pack int, query_id {query_kind}, `{vector}` {asked.schema[vector].dataType.simpleString()}"
    sent = materialise(asked.mapInPandas(packs_to_ask(packs, pivots, k, vector, False), sends), "sent")
    first = materialise(search(sent, dealt, number), "found")
    reach = best(first).groupBy("query_id").agg(F.sqrt(F.max("distance")).alias("reach"))
    more = materialise(asked.join(reach, "query_id").mapInPandas(packs_to_ask(packs, pivots, k, vector, True), sends), "sent")
    if visits is not None:
        visits.append((number, asked.count(), sent.count() + more.count()))
    needed = dealt.join(more.select("pack").distinct(), "pack", "left_semi")
    return best(first.unionByName(search(more, needed, number)))


def with_snippets(hits, snippets, key="snippet_id", text="text"):
    """Attach the snippet text.

    The hits are written first, so the search runs once and Spark knows their size: a few
    queries' hits are broadcast and the texts stay where they are.
    """
    return snippets.select(key, text).join(materialise(hits, "hits"), key)


def prompts(hits_with_text, queries, query_key="query_id", query="query", text="text"):
    """Retrieved texts in rank order, a blank line, then the query text."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    context = hits_with_text.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("context")
    )
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(query).alias("query"))
    return asked.join(context, "query_id", "left").select(
        "query_id",
        F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n"), "query").alias("prompt"),
    )


def encode_snippets(texts, text="text", dim=params.EMBEDDING_DIM):
    """Texts with ``snippet_id``, the content key, and ``embedding``; equal texts share both."""
    return with_embedding(texts.withColumn("snippet_id", F.md5(text)), text, dim)


def add_snippets(existing, new_texts, text="text", dim=params.EMBEDDING_DIM):
    """The snippet set with new texts, encoded on the way in."""
    return existing.unionByName(encode_snippets(new_texts, text, dim))
