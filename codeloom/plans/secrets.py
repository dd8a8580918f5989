"""Credentials left in documents."""

from codeloom.operators.secrets import QUOTED, SECRET_RULES, all_patterns, secret_summary, secrets
from codeloom.plans.registry import query, text_literal
from codeloom.sources.tables import documents

SECRETS_SQL = f"""
    WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line
               FROM documents),
    h AS (SELECT doc_id, source, line, unnest(hits) AS hit, generate_subscripts(hits, 1) - 1 AS place
          FROM (SELECT *, regexp_extract_all(row, {text_literal(all_patterns())}) AS hits FROM l)),
    v AS (SELECT *, regexp_extract(hit, {text_literal(QUOTED)}) AS q FROM h),
    r AS (SELECT *, CASE WHEN q <> '' THEN q[2:-2] ELSE hit END AS value,
            CASE {" ".join(f"WHEN regexp_full_match(hit, {text_literal(p)}) THEN '{n}'" for n, p, _ in SECRET_RULES)} END AS rule FROM v),
    c AS (SELECT *, string_split(value, '') AS marks FROM r),
    e AS (SELECT *, round(-list_sum(list_transform(list_sort(list_distinct(marks)),
            lambda x: (len(list_filter(marks, lambda y: y = x)) / len(marks)) * log2(len(list_filter(marks, lambda y: y = x)) / len(marks)))), 4) + 0 AS entropy
          FROM c),
    s AS (SELECT doc_id, source, line::int AS line, place::int AS place, rule, length(value)::int AS length, entropy,
            sha256(value) AS value_sha256,
            entropy >= CASE rule {" ".join(f"WHEN '{n}' THEN {b}" for n, _, b in SECRET_RULES)} END AS likely FROM e)
"""


def document_secrets(spark, folder):
    return secrets(documents(spark, folder, "source", "text"), keep=["doc_id", "source"])


@query("secret_scan", f"{SECRETS_SQL} SELECT * FROM s")
def secret_scan(spark, folder):
    return document_secrets(spark, folder)


@query(
    "secret_summary",
    f"""{SECRETS_SQL} SELECT source, rule, count(*) AS hits, count(*) FILTER (likely) AS likely,
    count(DISTINCT value_sha256) AS different FROM s GROUP BY source, rule""",
)
def summary(spark, folder):
    return secret_summary(document_secrets(spark, folder))
