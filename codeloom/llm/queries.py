"""The registered queries of this subpackage, each next to the SQL it must agree with, if SQL can say it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    bpe,
    decontaminate,
    exact,
    html,
    langid,
    licenses,
    merkle,
    mixing,
    near,
    paragraphs,
    repeats,
    toxicity,
    variants,
)

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key, by):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(by))


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.learn(docs, labels.where(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


@query()
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query()
def op4_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


@query()
def op5_repeated_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    found = paragraphs.repeated_paragraphs(table(spark, folder, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("spans")


@query()
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query(
    r"""
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
    WINDOW same AS (PARTITION BY body)
    """
)
def op7_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, folder, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query(
    r"""
    WITH item_words AS (
        SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
        FROM benchmark),
    item_places AS (
        SELECT item_id, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS h
        FROM item_words, range(1, len(w) - 3) AS r(i) WHERE len(w) >= 5),
    number AS (SELECT count(DISTINCT item_id) AS items FROM item_places),
    weights AS (
        SELECT h, CAST(least(greatest(round(16 * ln(1 + (SELECT items FROM number) / count(DISTINCT item_id))), 1), 255)
            AS BIGINT) AS w
        FROM item_places GROUP BY h),
    known AS (SELECT item_id, n, h, w, count(*) AS c FROM item_places JOIN weights USING (h) GROUP BY ALL),
    totals AS (SELECT item_id, sum(w * c) AS total FROM known GROUP BY item_id),
    doc_words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
        FROM documents),
    doc_places AS (
        SELECT doc_id, len(w) - 4 AS m, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS h
        FROM doc_words, range(1, len(w) - 3) AS r(i) WHERE len(w) >= 5),
    hits AS (SELECT doc_id, item_id, m, n, pos, h, w, c FROM doc_places JOIN known USING (h)),
    starts AS (
        SELECT DISTINCT doc_id, item_id, m, n, s
        FROM hits, range(greatest(pos - n + 5, 0), pos + 1) AS r(s)),
    counted AS (
        SELECT s.doc_id, s.item_id, s.m, s.n, s.s, h.h, h.w, h.c, count(*) AS seen
        FROM starts AS s JOIN hits AS h
            ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND h.pos BETWEEN s.s AND s.s + s.n - 5
        GROUP BY ALL),
    sums AS (
        SELECT doc_id, item_id, s, sum(w * least(seen, c)) AS common,
               any_value(total) + sum(w * greatest(seen - c, 0)) + (least(any_value(n) - 4, any_value(m) - s) - sum(seen))
                   * CAST(least(greatest(round(16 * ln(1 + (SELECT items FROM number))), 1), 255) AS BIGINT) AS whole
        FROM counted JOIN totals USING (item_id) GROUP BY doc_id, item_id, s)
    SELECT doc_id, item_id, max(CAST(common AS DOUBLE) / whole) AS similarity
    FROM sums WHERE common * 100 >= whole * 80 GROUP BY doc_id, item_id
    """
)
def op8_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


@query(
    r"""
    WITH template(license, body) AS (VALUES {templates}),
    template_words AS (
        SELECT *, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM template),
    known AS (
        SELECT DISTINCT license, body, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS h
        FROM template_words, range(1, len(w) - 3) AS r(i)),
    totals AS (SELECT license, body, count(*) AS total FROM known GROUP BY ALL),
    doc_words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w
        FROM documents),
    places AS (
        SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS h
        FROM doc_words, range(1, len(w) - 3) AS r(i) WHERE len(w) >= 5),
    hits AS (SELECT doc_id, license, body, n, pos, h FROM places JOIN known USING (h)),
    starts AS (SELECT DISTINCT doc_id, license, body, n, s FROM hits, range(greatest(pos - n + 5, 0), pos + 1) AS r(s)),
    counted AS (
        SELECT s.doc_id, s.license, s.body, s.s, count(DISTINCT h.h) AS common
        FROM starts AS s JOIN hits AS h ON s.doc_id = h.doc_id AND s.license = h.license AND s.body = h.body
            AND h.pos BETWEEN s.s AND s.s + s.n - 5
        GROUP BY ALL)
    SELECT doc_id, license, max(CAST(common AS DOUBLE) / total) AS share
    FROM counted JOIN totals USING (license, body) WHERE common * 100 >= total * 80 GROUP BY doc_id, license
    """.format(templates=", ".join(f"('{n}', '{t}')" for n, t in licenses.TEMPLATES))
)
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.licenses(table(spark, folder, "documents"), licenses.template_table(spark))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("id", 4) == 2, F.lit(False))
    return langid.predict(docs, model).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def crc32_sql(text):
    """The unsigned CRC-32 of a text's UTF-8 bytes (every byte, then eight shifts), which DuckDB lacks."""
    return rf"""xor(4294967295, list_reduce(flatten(list_transform(
        range(CAST(octet_length(encode({text})) AS BIGINT)),
        lambda i: [CAST('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2] AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295))"""


def draw_sql(*names):
    """``mixing.draw`` of names and numbers."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(names)})), 1, 15) AS BIGINT)"


def permuted_sql(name, rows, x, n, *names):
    """Two tables: ``name`` holds ``rows`` with ``y``, where ``mixing.permuted`` sends x."""
    d = [draw_sql(*names, str(i), side) for i, side in enumerate(("r0", "l1", "r1", "l2"))]
    return f"""{name}_walk AS (
        SELECT *, CAST({x} AS BIGINT) AS y, 0 AS k, CAST({n} AS BIGINT) AS nn, CAST(ceil(sqrt({n})) AS BIGINT) AS a,
            ({n} + a - 1) // a AS b FROM {rows}
        UNION ALL
        SELECT * EXCLUDE (l0, r0, l1, r1, l2, r2) REPLACE (l2 * b + r2 AS y, k + 1 AS k) FROM (
            SELECT *, y // b AS l0, y % b AS r0, (l0 + {d[0]}) % a AS l1, (r0 + {d[1]}) % b AS r1,
                (l1 + {d[2]}) % a AS l2, (r1 + {d[3]}) % b AS r2
            FROM {name}_walk WHERE k = 0 OR y >= nn)),
    {name} AS (SELECT * EXCLUDE (k, nn, a, b) FROM {name}_walk WHERE k > 0 AND y < nn)"""


EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(
    rf"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size
        FROM documents),
    ranked AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
            [5, 2, 1][rank % 3 + 1] AS weight, 2 * words AS room, room / weight AS ratio
        FROM sized GROUP BY source),
    levels AS (
        SELECT *, (CAST(1.5 AS DOUBLE) * sum(words) OVER () - coalesce(sum(room) OVER (ORDER BY ratio, rank {EARLIER}), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank {EARLIER}), 0)) AS level
        FROM ranked),
    found AS (SELECT coalesce(first(level ORDER BY ratio, rank), 0) AS found FROM levels WHERE level * weight <= room),
    goals AS (
        SELECT source, rank, words, least(found * weight, CAST(room AS DOUBLE)) AS target,
            CAST(floor(target + 0.5) AS BIGINT) AS goal, (words + 127) // 128 AS blocks,
            CASE WHEN goal > 0 THEN least((goal + 127) // 128 + 2, 2 * blocks) ELSE 0 END AS quota
        FROM ranked, found),
    spans AS (SELECT *, coalesce(CAST(sum(quota) OVER (ORDER BY rank {EARLIER}) AS BIGINT), 0) AS lo FROM goals),
    total AS (SELECT CAST(sum(quota) AS BIGINT) AS total FROM goals),
    points AS (
        SELECT CAST(r.slot AS BIGINT) AS slot, {draw_sql("'draw'", "r.slot")} % total AS point
        FROM total, range(0, total) AS r(slot)),
    drawn AS (
        SELECT slot, rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS nth
        FROM points JOIN spans ON point >= lo AND point < lo + quota),
    sums AS (
        SELECT s.* EXCLUDE (lo), coalesce(d.drawn, 0) AS drawn FROM spans AS s
        LEFT JOIN (SELECT rank, count(*) AS drawn FROM drawn GROUP BY rank) AS d USING (rank)),
    dealt AS (
        SELECT *, coalesce(CAST(sum(greatest(drawn - quota, 0)) OVER (ORDER BY rank {EARLIER}) AS BIGINT), 0) AS spare,
            coalesce(CAST(sum(greatest(quota - drawn, 0)) OVER (ORDER BY rank {EARLIER}) AS BIGINT), 0) AS lack
        FROM sums),
    extra AS (SELECT CAST(sum(greatest(drawn - quota, 0)) AS BIGINT) AS extra FROM sums),
    over_drawn AS (SELECT slot, d.rank, nth, drawn, quota, spare FROM drawn AS d JOIN dealt AS s ON d.rank = s.rank WHERE drawn > quota),
    {permuted_sql("picked", "over_drawn", "nth", "drawn", "'keep'", "rank")},
    moving AS (SELECT slot, spare + y - quota AS nth, extra FROM picked, extra WHERE y >= quota),
    {permuted_sql("moved", "moving", "nth", "extra", "'spare'")},
    placed AS (
        SELECT slot, d.rank, nth AS place FROM drawn AS d JOIN dealt AS s ON d.rank = s.rank WHERE drawn <= quota
        UNION ALL SELECT slot, rank, y FROM picked WHERE y < quota
        UNION ALL SELECT slot, rank, drawn + y - lack FROM moved JOIN dealt ON y >= lack AND y < lack + greatest(quota - drawn, 0)),
    turns AS (
        SELECT slot, p.rank, place, place // blocks AS turn, place % blocks AS x, blocks, words, goal
        FROM placed AS p JOIN dealt AS s ON p.rank = s.rank),
    {permuted_sql("chosen", "turns", "x", "blocks", "'block'", "rank", "turn")},
    slots AS (
        SELECT c.rank, c.y AS index, least(c.goal - c.place * 128 + count(e.place) * (128 - c.words % 128), c.words - c.y * 128, 128) AS take
        FROM chosen AS c LEFT JOIN chosen AS e
            ON c.rank = e.rank AND e.y = e.blocks - 1 AND e.words % 128 > 0 AND e.place < c.place
        GROUP BY c.slot, c.rank, c.place, c.y, c.goal, c.words),
    packed AS (
        SELECT doc_id, d.source, size, words AS source_size, target, rank,
            coalesce(sum(size) OVER (PARTITION BY rank ORDER BY doc_id NULLS FIRST, size {EARLIER}), 0) AS start, row_number() OVER () AS row
        FROM sized AS d JOIN goals AS s ON d.source IS NOT DISTINCT FROM s.source),
    taken AS (
        SELECT row, sum(greatest(least(start + size, index * 128 + take) - greatest(start, index * 128), 0)) AS taken
        FROM packed JOIN slots ON packed.rank = slots.rank AND take > 0 AND start < index * 128 + take AND index * 128 < start + size
        GROUP BY row)
    SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM packed LEFT JOIN taken USING (row)
    """
)
def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.docs.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def written_sql(*columns):
    """Fields as a leaf of a manifest holds them."""
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


@query(
    f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, run, count(*) AS c FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
        GROUP BY doc_id, run),
    marks AS (
        SELECT run, c, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs WHERE length(run) >= 7),
    words AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
            CAST(sum(c) AS BIGINT) AS n
        FROM marks GROUP BY 1 HAVING sum(c) >= 2 AND length(word) >= 7),
    holes AS (
        SELECT word, n, substr(word, 1, i) || '?' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    shorter AS (SELECT DISTINCT h.word AS a, h.n AS na, w.word AS b, w.n AS nb FROM holes AS h JOIN words AS w ON h.rest = w.word),
    near AS (
        SELECT a.word, b.word AS other, b.n AS m FROM holes AS a JOIN holes AS b ON a.hole = b.hole AND a.word <> b.word
        UNION ALL SELECT a, b, nb FROM shorter UNION ALL SELECT b, a, na FROM shorter),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
    forms AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
        FROM words LEFT JOIN best USING (word)),
    chains AS (
        SELECT word, word AS root, 0 AS step FROM forms
        UNION ALL SELECT c.word, f.form, step + 1 FROM chains AS c JOIN forms AS f ON c.root = f.word WHERE f.form IS NOT NULL)
    SELECT word, form, last.root, n, n_near, form_n
    FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY word) AS last USING (word)
    """
)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


@query(
    f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, sha256({written_sql("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
            CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0
                THEN sha256({written_sql("doc_id", "source", "lang", "(n_chars + 1)", "text")}) END AS claim,
            dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
        FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
    nodes AS (
        SELECT g, CAST(0 AS BIGINT) AS level, pos, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM placed
        UNION ALL
        SELECT g, any_value(level) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY g, pos // 2),
    tops AS (
        SELECT CAST(0 AS BIGINT) AS level, g AS pos, count(*) OVER () AS n, h FROM nodes WHERE n = 1
        UNION ALL
        SELECT any_value(level) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
        FROM tops WHERE n > 1 GROUP BY pos // 2),
    sub AS (SELECT g, h AS subroot FROM nodes WHERE n = 1),
    whole AS (SELECT h AS root FROM tops WHERE n = 1),
    steps AS (
        SELECT p.g, p.pos, list(CASE WHEN s.h IS NULL THEN '' WHEN (p.pos >> l.level) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END
            ORDER BY l.level) AS steps
        FROM placed AS p JOIN (SELECT DISTINCT g, level FROM nodes WHERE n > 1) AS l ON p.g = l.g
        LEFT JOIN nodes AS s ON s.g = l.g AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
        GROUP BY p.g, p.pos),
    upper_steps AS (
        SELECT b.g, list(CASE WHEN s.h IS NULL THEN '' WHEN (b.g >> l.level) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END
            ORDER BY l.level) AS steps
        FROM sub AS b JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) AS l ON true
        LEFT JOIN tops AS s ON s.level = l.level AND s.pos = xor(b.g >> l.level, 1)
        GROUP BY b.g),
    ways AS (
        SELECT p.doc_id, p.leaf, p.claim, p.g, list_concat(coalesce(s.steps, []), coalesce(u.steps, [])) AS steps
        FROM placed AS p LEFT JOIN steps AS s ON p.g = s.g AND p.pos = s.pos LEFT JOIN upper_steps AS u ON p.g = u.g),
    proved AS (
        SELECT doc_id, leaf, subroot, root,
            sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> ''), lambda s: s[2:]), '')) AS proof_sha256,
            list_reduce(steps, lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END),
                coalesce(claim, leaf)) AS folded_root
        FROM ways JOIN sub USING (g) JOIN whole ON true)
    SELECT *, folded_root = root AS verified FROM proved
    """
)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    more = F.col("n_chars").cast("decimal(38,0)") + 1  # the tampered count
    tampered = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))
    found = merkle.manifest(docs, claim=F.when(remainder("doc_id", 7) == 0, tampered))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        merkle.proof_digest("steps").alias("proof_sha256"),
        merkle.folded(F.coalesce("claim", "leaf"), "steps").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
