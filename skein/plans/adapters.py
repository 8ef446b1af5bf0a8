"""Inputs for the queries, made from the test tables: shell logs, facts, transcripts, reads, listings, tool outputs.

They only build input; nothing here belongs to an operator.  Each is stated a
second time in SQL in plans.oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.sources.tables import table

COMMANDS = ["npm install", "git status", "pytest -q", "cargo build", "FOO=1 npx eslint src", "docker ps", "pip install x && ls", "make"]


BLOCK = 1000  # lines joined at once


def lines_text(rows: DataFrame, *order: str) -> DataFrame:
    """(id, text): lines in order, in blocks first, as a million lines of a text in one list take many times its size."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy(*order, "line")) - 1
    items = F.array_sort(F.collect_list(F.struct("nth", "line")))
    text = F.when(F.count("line") > 0, F.array_join(F.transform(items, lambda x: x["line"]), "\n"))
    blocks = rows.select("id", "line", nth.alias("nth")).groupBy("id", F.floor(F.col("nth") / BLOCK).alias("block")).agg(text.alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    return blocks.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def _say(*parts: object) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    line = _say(F.when(F.col("event_type") == "error", "skip ").otherwise(""), "worker ", F.col("user_id"), " processed item ", k, " at ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select(F.col("user_id").alias("id"), "ts", "event_id", "event_type", k.alias("k"), line.alias("line"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    return lines_text(event_rows(spark, d), "ts", "event_id")


def ansi_logs(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).withColumn("text", F.replace("text", F.lit("worker"), F.lit("\x1b[32mworker\x1b[0m")))


def progress_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d)
    kind = F.pmod("event_id", F.lit(4))
    line = F.when(kind == 0, _say("download ", F.col("k"), "%")).when(kind == 1, _say("part", "\r", F.col("line"))).otherwise(F.col("line"))
    return lines_text(rows.withColumn("line", line), "ts", "event_id")


def facts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        _say("s", F.col("user_id")).alias("session_id"), T.utc_day(F.col("ts")).alias("day"), "ts", F.col("event_type").alias("tool"), _say("cmd", k % 7).alias("command"), _say("p", F.col("user_id") % 5).alias("project"),
        (k * 10 + 1000).alias("bytes_in"), (F.col("event_id") * 7 % 900 + 500).alias("bytes_out"), F.lit(1).cast("long").alias("events"), "event_id",
    )


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("conv_id") % 8 + 1).cast("int"))
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), _say("u", F.col("turn")).alias("id"), F.lit("Bash").alias("name"), F.struct(command.alias("command")).alias("input"))).alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), _say("u", F.col("turn") - 1).alias("tool_use_id"), F.col("text").alias("content"))).alias("content")).alias("message")))
    raw = F.when(F.col("role") == "user", use).otherwise(result)
    return c.select(_say("conv", F.col("conv_id")).alias("file"), F.col("turn").cast("long").alias("line_no"), raw.alias("raw"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    n = F.col("doc_id")
    step = F.floor(n * 13 / 7) % 5
    path = n * 7 % 5
    return t.select(
        _say("s", F.floor(n / 50)).alias("session_id"), _say("f", path, ".txt").alias("path"), n.alias("seq"), F.when(step == 3, "Edit").when(step == 4, "Write").otherwise("Read").alias("op"),
        (step == 2).alias("bounded"), F.lit(False).alias("failed"), _say("file ", path, " version ", F.floor(n / 11) % 2, "\n", F.repeat(F.lit("x y z\n"), 100)).alias("content"),
    )


def grep_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "body"))
    line = _say(F.col("source"), "/f", F.floor(F.col("n") / 5), ".txt:", F.col("n"), ":", F.col("body"))
    each = F.array(F.struct(F.lit(0).alias("k"), line.alias("line")), F.struct(F.lit(1).alias("k"), F.when(F.col("n") % 5 == 0, line).alias("line")), F.struct(F.lit(2).alias("k"), F.when(F.col("n") % 7 == 6, "--").alias("line")))
    return t.select("id", "n", F.explode(each).alias("x")).where("x.line is not null").select("id", (F.col("n") * 3 + F.col("x.k")).alias("pos"), "x.line")


def glob_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    deep = t.select(F.col("lang").alias("id"), F.col("doc_id").alias("pos"), _say(F.col("lang"), "/", F.col("source"), "/d", F.col("doc_id")).alias("name"))
    flat = t.select(_say(F.col("lang"), "_flat").alias("id"), F.col("doc_id").alias("pos"), _say(F.col("lang"), "/d", F.col("doc_id")).alias("name"))
    return deep.unionByName(flat)


def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    item = _say('{"order": ', F.col("l_orderkey"), ', "line": ', F.col("l_linenumber"), ', "flag": "', F.col("l_returnflag"), '"}')
    many = li.select(_say("s", F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), item.alias("line"))
    o = table(spark, d, "orders")
    few = o.select(_say("c", F.col("o_custkey")).alias("id"), F.col("o_orderkey").alias("a"), F.lit(0).alias("b"), _say('{"order": ', F.col("o_orderkey"), "}").alias("line"))
    rows = many.unionByName(few.withColumn("b", F.col("b").cast(many.schema["b"].dataType)))
    items = F.array_sort(F.collect_list(F.struct("a", "b", "line")))
    return rows.groupBy("id").agg(_say("[", F.array_join(F.transform(items, lambda x: x["line"]), ",\n "), "]").alias("text"), F.count(F.lit(1)).alias("n"))


def status_text(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    code = F.element_at(F.array(F.lit(" M"), F.lit("??"), F.lit("A "), F.lit("MM")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    files = s.select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("pos"), _say(code, " src/s", F.col("s_suppkey")).alias("line"))
    heads = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(-1).cast(files.schema["pos"].dataType).alias("pos"), _say("## main...origin/", F.lower("n_name")).alias("line"))
    return lines_text(files.unionByName(heads), "pos")


def log_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    each = F.array(_say("commit ", F.md5(key.cast("string"))), _say("Author: c", key), F.lit("Date: today"), F.lit(""), F.when(key % 11 != 0, _say("    subject ", key)))
    return c.select(F.col("c_nationkey").alias("id"), key, F.posexplode(each).alias("j", "line")).where("line is not null").select("id", (F.col("c_custkey") * 5 + F.col("j")).alias("pos"), "line")


def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey is not null")
    key = F.col("o_orderkey")
    line = F.when(key % 9 == 0, _say("+added ", key)).when(key % 13 == 0, _say("-removed ", key)).otherwise(_say(" context ", key))
    body = o.select((F.col("o_custkey") % 40).alias("id"), key.alias("pos"), line.alias("line"))
    ids = body.select("id").distinct()
    heads = ids.select("id", F.lit(-2).cast(body.schema["pos"].dataType).alias("pos"), _say("diff --git a/f", F.col("id"), " b/f", F.col("id")).alias("line"))
    index = ids.select("id", F.lit(-1).cast(body.schema["pos"].dataType).alias("pos"), F.lit("index 1..2 100644").alias("line"))
    return body.unionByName(heads).unionByName(index)


def lint_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    line = F.when(key % 17 == 0, F.lit("nothing to see")).otherwise(_say("src/a", key % 3, ".ts(", key, ",1): error TS", key % 2 + 1000, ": message ", key % 5))
    return p.select((key % 20).alias("id"), key.alias("pos"), line.alias("line"))


def package_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    line = F.when(key % 4 == 0, _say("npm warn deprecated x", key % 3)).when(key % 50 == 49, _say("added ", key, " packages in 2s")).otherwise(_say("timing step ", key))
    return lines_text(p.select((key % 25).alias("id"), key.alias("pos"), line.alias("line")), "pos")


def go_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    action = F.when(key % 97 == 0, "fail").when(key % 2 == 0, "pass").otherwise("run")
    line = _say('{"Action":"', action, '","Package":"pkg', key % 4, '","Test":"T', key, '"}')
    return lines_text(p.select((key % 50).alias("id"), key.alias("pos"), line.alias("line")), "pos")


def runner_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    line = F.when(key % 5 == 0, _say("PASS src/t", key)).when(key % 47 == 3, _say("Tests  ", key, " passed")).otherwise(_say("running case ", key))
    return lines_text(p.select((key % 30).alias("id"), key.alias("pos"), line.alias("line")), "pos")


def failing_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    line = F.when(key % 23 == 0, _say("FAIL src/t", key)).when(key % 23 == 10, _say("    expected ", key)).when(key % 5 == 0, _say("PASS src/t", key)).when(key % 47 == 3, _say("Tests  1 failed, ", key, " passed")).otherwise(_say("running case ", key))
    return lines_text(p.select((key % 10).alias("id"), key.alias("pos"), line.alias("line")), "pos")


def table_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    rows = n.select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").cast("long").alias("pos"), _say(F.col("n_name"), "   Running    ", F.col("n_nationkey"), "d  ").alias("line"))
    heads = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(-1).cast("long").alias("pos"), F.lit("NAME   STATUS    AGE").alias("line"))
    return lines_text(rows.unionByName(heads), "pos")


def trace_text(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d)
    each = F.when(F.col("event_type") == "error", F.array(F.lit("Traceback (most recent call last):"), _say('  File "a', F.col("k") % 2, '.py", line 3'), F.lit("    run()"), _say('  File "a', F.col("k") % 2, '.py", line 3'), F.lit("    run()"), _say("ValueError: bad ", F.col("k") % 2))).otherwise(F.array(F.col("line")))
    return lines_text(rows.select("id", "ts", "event_id", F.posexplode(each).alias("j", "line")), "ts", "event_id", "j")


def shell_results(spark: SparkSession, d: str) -> DataFrame:
    """All texts of this module as results of fitting commands."""
    parts = []
    for name, command, frame in (("log", "node worker.js", logs(spark, d)), ("status", "git status", status_text(spark, d)), ("pkg", "npm install", package_text(spark, d)), ("run", "jest", runner_text(spark, d)), ("fail", "jest", failing_text(spark, d)), ("trace", "node x.mjs", trace_text(spark, d)), ("table", "kubectl get pods", table_text(spark, d)), ("lint", "npx tsc", lines_text(lint_rows(spark, d), "pos")), ("diff", "git diff", lines_text(diff_rows(spark, d), "pos"))):
        parts.append(frame.select(_say(name, F.col("id")).alias("id"), F.lit(command).alias("command"), F.col("text").alias("stdout")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("*", F.lit("").alias("stderr"), F.lit(None).cast("int").alias("exit_code"), F.lit(False).alias("is_image"))
