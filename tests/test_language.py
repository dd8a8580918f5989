"""Language detection on small texts and files."""

import pytest
from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.language import extension_language, preprocess, with_language
from codeloom.sources.tables import read_sources

SNIPPETS = {
    "python": 'import json\n\ndef load(path):\n    return json.load(open(path))',
    "javascript": "function area(r) {\n  return 3 * r * r;\n}",
    "java": "public class Box {\n  int w;\n}",
    "ruby": 'require "json"\n\nclass Box\n  def w\n  end\nend',
    "go": 'package box\n\nfunc W() int { return 1 }',
    "rust": "fn width(b: &Box) -> u8 {\n    b.w\n}",
    "unknown": "These are words that belong to no programming language.",
}


def detect(spark, rows, **options):
    df = spark.createDataFrame(rows, "id int, text string")
    return {r["id"]: r["language"] for r in with_language(df, **options).collect()}


def test_snippets(spark):
    rows = list(enumerate(SNIPPETS.values()))
    assert detect(spark, rows) == dict(enumerate(SNIPPETS))


def test_listing_order_breaks_ties_and_anchors_are_literal(spark):
    rows = [(0, "def area(r)"), (1, "# note\nimport os"), (2, "class A\n"), (3, "class A:\n"), (4, "see main.go\n")]
    assert detect(spark, rows) == {0: "python", 1: "unknown", 2: "ruby", 3: "python", 4: "go"}
    assert detect(spark, rows, mode="multiline")[1] == "python"


def test_new_language(spark):
    table = {**params.LANGUAGE_PATTERNS, "perl": r"{BOL}use{S}+strict"}
    assert detect(spark, [(0, "use strict;")], table=table) == {0: "perl"}


def test_comments_and_strings_are_removed(spark):
    code = "# a\ndef main():  # b\n    print(\"c\", 'd') // e\n/* f\n g */"
    clean = spark.createDataFrame([(code,)], "text string").select(preprocess(F.col("text"))).first()[0]
    assert clean == "\ndef main():  \n    print(, ) \n"


@pytest.mark.parametrize(
    "path,language",
    [("a/b.py", "python"), ("b.js", "javascript"), ("B.java", "java"), ("b.rb", "ruby"), ("x.y.go", "go"),
     ("b.rs", "rust"), ("b.txt", None), (".py", None), ("dir.py/readme", None)],
)
def test_extension(spark, path, language):
    row = spark.createDataFrame([(path,)], "path string").select(extension_language(F.col("path")))
    assert row.first()[0] == language


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.py").write_bytes(b"fn main() {\r\n}\r\n")
    (tmp_path / "sub" / "two.txt").write_text("package main\n")
    files = read_sources(spark, str(tmp_path))
    found = {r["path"].rsplit("/", 1)[-1]: (r["language"], r["text"]) for r in with_language(files, path="path").collect()}
    assert found == {"one.py": ("python", "fn main() {\n}\n"), "two.txt": ("go", "package main\n")}
