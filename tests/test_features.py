"""The Python feature pass and whole-file analysis."""

import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.operators.analysis import analyse, issue_dictionary, issue_table
from codeloom.operators.features import SLICE_BYTES, SLICE_ROWS, feature_table, parse, python_features, slices


def facts(code, kind):
    return [f for f in parse(code)[-1] if f[0] == kind]


def test_imports_as_listed():
    code = "import a.b as c, d\nfrom . import x\nfrom m.n import y, z"
    assert [f[1] for f in facts(code, "import")] == ["a.b", "d", "None.x", "m.n.y, z"]


def test_function_and_class_details():
    code = '@a.b\n@c(1)\n@d[0]\ndef f(x, *y, z=1): "doc"\nclass K(p.q, r()): pass'
    (function,) = facts(code, "function")
    assert function[1] == "f" and function[6] == ["x"] and function[7] == ["a.b", "c", "d[0]"] and function[8] == "doc"
    (cls,) = facts(code, "class")
    assert cls[6] == ["p.q", "r()"]


def test_depth_follows_direct_nesting_only():
    direct = "for a in b:\n  while a:\n    if a: pass"
    assert parse(direct)[5:7] == (3, 3)
    assert parse("def f():\n  for a in b:\n    if a: pass")[5:7] == (0, 2)
    assert parse("if a: pass\nelif b: pass\nelif c: pass")[5:7] == (3, 3)


def test_unreadable_sources():
    assert parse("x = (")[:2] == (False, "SyntaxError")
    assert parse("a\0b")[0] is False
    assert parse("(" * 100000)[0] is False
    assert parse("")[0] is True


def test_deep_expressions_give_a_row():
    chain = parse("x" + ".a" * 1200 + "()")
    assert chain[0] is True and [f[1] for f in chain[-1] if f[0] == "call"] == ["x" + ".a" * 1200]
    for code in ("class K(" + "+".join("a" * 990) + "): pass", "@" + "+".join("a" * 990) + "\ndef f(): pass"):
        assert len(parse(code)) == 8


def test_first_node_of_a_position():
    (first, *_) = facts("x = f(1)\n", "node")
    assert first[1:4] == ("Assign", 1, 0)


def test_pass_keeps_rows_and_skips_missing_text(spark):
    rows = spark.createDataFrame([(1, "import os"), (2, None), (3, "x = ")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in python_features(rows).collect()}
    assert set(out) == {1, 3} and out[1]["valid"] and not out[3]["valid"]
    assert feature_table(python_features(rows)).where("kind = 'import'").count() == 1


def test_analysis_order_and_routing(spark):
    code = "import pickle\nx = eval(y)\ntry:\n    pass\nexcept:\n    exec(z)\n"
    rows = spark.createDataFrame([(1, code), (2, "# c\n" + code), (3, "plain words")], "doc_id long, text string")
    done = analyse(rows)
    found = {}
    for r in issue_table(done).orderBy("doc_id", "place").collect():
        found.setdefault(r["doc_id"], []).append((r["source"], r["line"]))
    assert found == {
        1: [("except", 5), ("import", 1), ("call", 2), ("call", 6)],
        2: [("import", 2), ("call", 3), ("call", 7)],  # unknown language: security rules only
    }
    lists = done.where("doc_id = 1").select(issue_dictionary(F.col("issues")).alias("d")).first()["d"]
    assert [len(lists[c]) for c in ("errors", "warnings", "style_issues", "security_issues")] == [1, 0, 0, 3]


def test_own_rule_tables(spark):
    rows = spark.createDataFrame([(1, "import os\nos.system(x)\nimport pickle")], "doc_id long, text string")
    own = analyse(rows, unsafe_functions={"os.system": "runs a command"}, unsafe_modules={"os": "system access"})
    assert [(r["source"], r["message"]) for r in issue_table(own).orderBy("place").collect()] == [
        ("import", "Importing potentially unsafe module 'os': system access"),
        ("call", "Potentially unsafe use of 'os.system': runs a command"),
    ]


def test_text_rules_read_code_only(spark):
    from codeloom.operators.analysis import text_rule_issues

    code = (
        "function f() {\n// var x;\nvar s = 'let y;';\n/* try { a } */ var z;\ntry { if (a) { b(); } }\n"
        "try { c({}); } catch (e) { try { d(); } finally { } }\n\x01let q;\nvar t = `try { }`; // catch {\n}\n"
    )
    rows = spark.createDataFrame([(1, code, "javascript"), (2, code, "python"), (3, "", "java")], "id int, text string, language string")
    found = rows.select("id", F.explode(text_rule_issues(F.col("text"), F.col("language"))).alias("i"))
    got = sorted((r["id"], r["line"], r["col"], r["source"]) for r in found.select("id", "i.*").collect())
    assert got == [(1, 4, 20, "var"), (1, 5, 0, "try"), (1, 7, 5, "var")]


def test_a_worker_holds_the_facts_of_few_files(spark):
    """Large batches are taken in slices by rows and bytes, in order."""
    sizes = [10] * 600 + [400_000] * 6 + [0] * 5
    batch = pa.RecordBatch.from_pydict({"text": ["#" * n for n in sizes]})
    parts = [p.column("text").to_pylist() for p in slices(batch, "text")]
    assert [len(t) for p in parts for t in p] == sizes
    assert max(len(p) for p in parts) <= SLICE_ROWS and max(sum(map(len, p)) for p in parts) <= SLICE_BYTES
    assert not list(slices(batch.slice(0, 0), "text"))
    assert [len(p) for p in slices(pa.RecordBatch.from_pydict({"text": ["#" * SLICE_BYTES * 2] * 3}), "text")] == [1, 1, 1]
    code = F.concat(F.lit("x = 'é"), F.col("id").cast("string"), F.lit("'\nimport a, b"))
    files = spark.range(3000, numPartitions=1).withColumn("text", code).withColumn("at", F.timestamp_seconds("id"))
    found = feature_table(python_features(files, keep=["at", "id"]), ["at", "id"]).where("kind = 'import'")
    assert found.where(F.col("at") == F.timestamp_seconds("id")).groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("n")).where("n = array('a', 'b')").count() == 3000
