"""Runs a plan and its checking SQL on the same tables and compares rows and types."""

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """None when equal, else a short account of the first difference."""
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_types = dict(df.dtypes)
    if sorted(described) != sorted(spark_types):
        return f"columns {sorted(spark_types)} != {sorted(described)}"
    for name, kind in spark_types.items():
        if SAME.get(kind) != described[name]:
            return f"type of {name}: {kind} != {described[name]}"
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    theirs = normal(cursor.fetchall(), list(described))
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} != {b}"
    return None
