"""Vectors, nearest neighbours and prompts."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.operators import retrieval
from codeloom.plans.registry import query
from codeloom.plans.sql import words_sql
from codeloom.sources.tables import documents, read_table

D = params.EMBEDDING_DIM


def hashed_sql(name, table, key):
    """name(key, v): dense hashed vector of every text of a table."""
    return f"""
{name}_w AS (SELECT {key} AS id, ('0x' || substring(md5(unnest({words_sql('text')})), 1, 4))::int % {D} AS dim FROM {table}),
{name}_c AS (SELECT id, dim, count(*) AS c FROM {name}_w GROUP BY ALL),
{name} AS (SELECT id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM {name}_c)
"""


@query(
    "hash_embedding",
    f"WITH {hashed_sql('e', 'documents', 'doc_id')} SELECT id AS doc_id, dim, round(x, 6) AS x FROM e",
)
def hash_embedding(spark, folder):
    docs = documents(spark, folder)
    vectors = retrieval.embed(docs, "doc_id")
    long = vectors.select("doc_id", F.posexplode_outer("embedding").alias("dim", "x"))
    return long.where("x <> 0").withColumn("x", F.round("x", 6))


@query(
    "knn_l2",
    f"""
    WITH c AS (SELECT label, unnest(range({D})) + 1 AS dim,
                      unnest(embedding)::double AS x FROM embeddings),
    q AS (SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS x FROM c GROUP BY ALL) GROUP BY label),
    d AS (SELECT q.label AS query_id, vec_id,
            list_sum(list_transform(list_zip(q.v, embedding), lambda p: power(p[1] - p[2]::double, 2))) AS distance
          FROM q, embeddings)
    SELECT query_id, vec_id, round(distance, 6) AS distance,
           (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::int AS rank
    FROM d QUALIFY rank <= {params.RETRIEVAL_K}
    """,
)
def knn(spark, folder):
    """The vectors nearest to the mean vector of every label."""
    vectors = read_table(spark, folder, "embeddings")
    means = vectors.groupBy("label").agg(
        F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(D)]).alias("mean")
    )
    near = retrieval.nearest(
        vectors, means, key="vec_id", query_key="label", query_vector="mean"
    )
    return near.withColumn("distance", F.round("distance", 6))


RAG_SQL = f"""
{hashed_sql('e', 'documents', 'doc_id')}, {hashed_sql('q', 'benchmark', 'item_id')},
dot AS (SELECT q.id AS query_id, e.id AS doc_id, sum(q.x * e.x) AS dot FROM q JOIN e USING (dim) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, round(2 - 2 * dot, 6) AS distance,
           (row_number() OVER (PARTITION BY query_id ORDER BY round(2 - 2 * dot, 9), doc_id))::int AS rank
         FROM dot QUALIFY rank <= {params.RETRIEVAL_K})
"""


def hits(spark, folder):
    docs = documents(spark, folder)
    items = read_table(spark, folder, "benchmark")
    return retrieval.nearest(
        retrieval.embed(docs, "doc_id"),
        retrieval.embed(items, "item_id"),
        key="doc_id",
        query_key="item_id",
    )


@query("retrieve_snippets", f"WITH {RAG_SQL} SELECT query_id, doc_id, distance, rank FROM hits")
def retrieve(spark, folder):
    return hits(spark, folder).withColumn("distance", F.round("distance", 6))


@query(
    "rag_prompt",
    f"""
    WITH {RAG_SQL}
    SELECT item_id AS query_id, string_agg(d.text, chr(10) ORDER BY rank) || chr(10) || chr(10) || any_value(b.text) AS prompt
    FROM hits JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id GROUP BY item_id
    """,
)
def rag_prompt(spark, folder):
    docs = read_table(spark, folder, "documents")
    items = read_table(spark, folder, "benchmark")
    found = retrieval.with_snippets(hits(spark, folder), docs, "doc_id")
    return retrieval.prompts(found, items, "item_id", "text")


@query(
    "append_snippets",
    f"""
    WITH t AS (SELECT md5(text) AS snippet_id, 'documents' AS origin, text FROM documents
               UNION ALL SELECT md5(text), 'benchmark', text FROM benchmark)
    SELECT snippet_id, origin,
           len(list_distinct(list_transform({words_sql('text')}, lambda w: ('0x' || substring(md5(w), 1, 4))::int % {D})))::int AS used
    FROM t
    """,
)
def append_snippets(spark, folder):
    def texts(name):
        return read_table(spark, folder, name).select(F.lit(name).alias("origin"), "text")

    stored = retrieval.encode_snippets(texts("documents"))
    grown = retrieval.add_snippets(stored, texts("benchmark"))
    used = F.size(F.filter(F.coalesce("embedding", F.array()), lambda x: x != 0))
    return grown.select("snippet_id", "origin", used.alias("used"))
