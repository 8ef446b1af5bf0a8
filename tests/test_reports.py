"""Records and reports."""

import json

from pyspark.sql import functions as F

from skein.operators import reports as R


def test_records(spark):
    df = spark.createDataFrame([("PreToolUse", "git status -b", "r", "a\n", "p/q.txt"), ("PreToolUse", None, None, "a\n", None)], "e string, c string, r string, t string, p string")
    rows = df.select(R.rewrite_record(F.col("e"), F.col("c"), F.col("r")).alias("w"), R.advice_record(F.col("e"), F.col("t")).alias("a"), R.with_recovery(F.col("t"), F.col("p")).alias("f")).collect()
    assert json.loads(rows[0]["w"])["hookSpecificOutput"]["updatedInput"] == {"command": "git status -b"} and rows[1]["w"] is None
    assert rows[0]["f"] == "a\n[skein: full: p/q.txt]" and rows[1]["f"] == "a\n"


def test_targets(spark):
    df = spark.createDataFrame([("context", None), (None, "t"), (None, None)], "f string, t string")
    assert [r[0] for r in df.select(R.target(F.col("f"), F.col("t"), {})).collect()] == ["context", "context", "structured"]
    assert df.select(R.target(F.col("f"), F.col("t"), {"context_home": "x"})).collect()[2][0] == "context"


def test_tables(spark):
    plain = spark.createDataFrame([("b", 100, 50, "x|y"), ("a", 0, 0, "z")], "name string, bytes_in long, bytes_out long, rules string")
    whole = spark.createDataFrame([("b", 100, 90)], "name string, bytes_in long, bytes_out long")
    report = R.ratio_report(plain, whole)
    assert [(r["name"], r["percent"], r["whole_percent"]) for r in report.collect()] == [("a", 0.0, None), ("b", 50.0, 10.0)]
    assert R.markdown_rows(report.select("name", "rules")).collect()[1]["line"] == "| b | x\\|y |"
    names = spark.createDataFrame([("a", "xx"), ("b", "yy"), ("c", "z")], "name string, text string")
    assert R.largest(names).first()["name"] == "b"
    scripts = spark.createDataFrame([("s1",), ("s2",), ("s2",)], "script string")
    assert [r["script"] for r in R.missing_scripts(scripts, spark.createDataFrame([("s1",)], "script string")).collect()] == ["s2"]


def test_grep_write_back(spark):
    df = spark.sql("select named_struct('mode', 'content', 'numFiles', 2, 'content', 'a\nb\nc', 'numLines', 3) r")
    out = df.select(R.grep_write_back(F.col("r"), F.lit("a\nb")).alias("r")).first()["r"]
    assert (out["content"], out["numLines"], out["numFiles"], out["mode"]) == ("a\nb", 2, 2, "content")
