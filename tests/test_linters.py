"""Linter formats, including lines that do not fit."""

from codeloom.sources import linters


def read(spark, parser, lines, *columns):
    rows = spark.createDataFrame([(x,) for x in lines], "raw string")
    return [tuple(r) for r in parser(rows).select(*columns).collect()]


COLUMNS = ("category", "line", "col", "message", "bad")


def test_pylint(spark):
    lines = ["E:3:4: broken ", "W:1:0:unused", "C:1:1:style", "E:x:1:m", "E:7"]
    assert read(spark, linters.pylint, lines, *COLUMNS) == [
        ("errors", 3, 4, "broken", False), ("warnings", 1, 0, "unused", False),
        ("errors", None, 1, "m", True), ("errors", 7, None, None, True)]


def test_eslint_keeps_colons(spark):
    assert read(spark, linters.eslint, ["1:2: a: b", "summary"], *COLUMNS) == [
        ("warnings", 1, 2, "a: b", False), ("warnings", None, None, None, True)]


def test_checkstyle(spark):
    assert read(spark, linters.checkstyle, ["ERROR:1:2: x", "INFO:1:2:y", "WARNING:3:4:z"], *COLUMNS) == [
        ("warnings", 1, 2, "x", False), ("warnings", 3, 4, "z", False)]


def test_ruby_and_compilers(spark):
    assert read(spark, linters.ruby, ["a.rb:1: warning"], *COLUMNS) == [("errors", 0, 0, "a.rb:1: warning", False)]
    assert read(spark, linters.compiler, ["a.go:3:4: x: y"], "file", *COLUMNS) == [("a.go", "errors", 3, 4, "x: y", False)]


def test_bandit(spark):
    rows = spark.createDataFrame(
        [('{"results": [{"issue_text": "a", "line_number": 3}]}', "failed"), ("{}", ""), ("oops", "no file"), ("oops", "")],
        "raw string, error string",
    )
    assert [tuple(r) for r in linters.bandit(rows).select("issue_type", "line", "message").collect()] == [
        ("Bandit Issue", 3, "a"),
        ("Bandit Error", 0, "Error running Bandit: no file"),
        ("Bandit Parsing Error", 0, "Error parsing Bandit output")]
