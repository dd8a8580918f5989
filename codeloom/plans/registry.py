"""Name -> plan, and name -> checking SQL."""

from textwrap import dedent

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a plan ``(spark, folder) -> DataFrame`` with its checking SQL."""

    def add(plan):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = dedent(sql).strip()
        return plan

    return add


def text_literal(value):
    return "'" + value.replace("'", "''") + "'"


def list_literal(values):
    return "[" + ", ".join(text_literal(v) for v in values) + "]"
