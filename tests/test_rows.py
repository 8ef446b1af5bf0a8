"""Tool results row by row: repeated ids, listings without names, many warnings, arrays folded in place."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.commands import described
from skein.operators import compressors as C
from skein.operators import lines as R
from skein.operators import tools

SCHEMA = "id string, session_id string, seq long, tool_name string, tool_input string, tool_response string"


def events(spark, responses):
    return spark.createDataFrame([(i, "s", k, "Grep", "{}", r) for k, (i, r) in enumerate(responses)], SCHEMA)


def listing(name, n):
    return json.dumps({"mode": "content", "content": "\n".join(f"src/{name}.py:{k}:found {name} here" for k in range(n)), "numLines": n})


def test_two_results_under_one_id_are_two_results(spark):
    both = [("x", listing("a", 60)), ("x", listing("b", 70)), (None, listing("c", 80))]
    apart = [(str(k), r) for k, (_, r) in enumerate(both)]
    pick = lambda rows: sorted((r["outcome"], r["size_in"], r["size_out"], r["record"]) for r in rows.collect())
    assert pick(tools.grep_results(events(spark, both))) == pick(tools.grep_results(events(spark, apart)))
    assert all(r[0] == "compressed" for r in pick(tools.grep_results(events(spark, both))))
    names = lambda x: json.dumps({"filenames": [f"{x}/{k % 3}/file{k}" for k in range(150)]})
    both = [("x", names("p")), ("x", names("q")), ("x", names("p"))]
    pick = lambda rows: sorted((r["outcome"], r["filenames"]) for r in rows.collect())
    assert pick(tools.glob_results(events(spark, both))) == pick(tools.glob_results(events(spark, [(str(k), r) for k, (_, r) in enumerate(both)])))


def test_listings_without_names_are_only_attempted(spark):
    rows = [("a", '{"mode":"x","count":3}'), ("b", '{"filenames":5}'), ("c", None), ("d", ""), ("e", '{"filenames":[]}'), ("f", "plain"), ("g", json.dumps({"filenames": ["a/b"] * 200}))]
    got = {r["id"]: r["outcome"] for r in tools.glob_results(events(spark, rows)).collect()}
    assert got == {"a": None, "b": None, "c": "unsupportedShape", "d": "unsupportedShape", "e": "skippedBelowThreshold", "f": None, "g": "compressed"}


def test_reads_of_one_id(spark):
    text = "line of text\n" * 100
    read = json.dumps({"file": {"content": text}})
    rows = [("x", "s", k, "Read", '{"file_path":"f"}', read, False, None) for k in range(3)] + [("x", "s", 9, "Move", "{}", "{}", False, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", is_error boolean, content_after string")
    assert sorted(r["outcome"] for r in tools.file_results(df).collect()) == ["deduped", "deduped", "skippedFirstRead", "unsupportedTool"]


def test_folding_in_place_is_folding_by_rows(spark):
    rng = random.Random(2)
    pool = [f"src/{c}.py:{k}:hit" for c in "ab" for k in range(9)] + ["--", "plain", "", "x:y"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["", "a", "\n".join(pool[:9])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r["id"]: r["text"] for r in R.collapse_matches(R.explode_lines(df)).collect()}
    clash = df.withColumn("small_lines", F.lit(1)).withColumn("small_kept", F.lit(2))
    got = R.with_collapsed_matches(clash, F.col("text"), "small")
    assert {r["id"]: r["small"] for r in got.collect()} == want and got.columns == ["id", "text", "small_lines", "small_kept", "small"]
    names = [[f"{rng.choice('abc')}/{rng.choice('de')}/f{rng.randrange(99)}" for _ in range(rng.randrange(1, 120))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, names array<string>")
    want = {r["id"]: r["lines"] for r in R.glob_lines(df.select("id", F.posexplode("names").alias("pos", "name"))).collect()}
    assert {r["id"]: r["lines"] for r in R.with_folder_lines(df, F.col("names"), "lines").collect()} == want


def test_runs_of_an_array(spark):
    rows = [([],), (["a"],), (["a", "a", None, None, "b", "b", "b", "a"],), (None,)]
    df = spark.createDataFrame(rows, "k array<string>").select(T.run_starts(F.transform("k", lambda x: F.struct(x.alias("p"))), "p").alias("r"))
    assert [None if r["r"] is None else [tuple(x) for x in r["r"]] for r in df.collect()] == [[], [(0, 1)], [(0, 2), (2, 1), (3, 1), (4, 3), (7, 1)], None]


def _package(spark, text):
    df = described(spark.createDataFrame([("npm install", text)], "command string, text string"), "command")
    return df.select(C.packages(F.col("text"), F.col("about"))["text"].alias("out"))


def test_warnings_in_order_of_first_sight(spark):
    text = "npm warn b\nnpm warn a\nx\nnpm warn b\nnpm warn c\nnpm warn a\nnpm warn b\nadded 3 packages in 2s"
    assert _package(spark, text).first()["out"].split("\n") == ["npm install: added 3 packages in 2s", "npm warn b", "npm warn a", "npm warn c", "... [skein: 2 duplicate package warnings omitted]", "... [skein: 1 duplicate package warnings omitted]", "... [skein: 1 package-manager lines omitted]"]


@pytest.mark.parametrize("n", [5000])
def test_thousands_of_warnings(spark, n):
    _package(spark, "npm warn x\nadded 1 packages").collect()
    text = "\n".join(f"npm warn deprecated thing{k % n}" for k in range(2 * n)) + "\nadded 9 packages in 2s"
    began = time.time()
    out = _package(spark, text).first()["out"]
    assert time.time() - began < 6 and out.count("duplicate package warnings") == n  # a second or two on a machine of its own
