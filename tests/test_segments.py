"""Folds over blocks against the same folds over whole texts, cut anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import folds
from skein.operators import segments as S

LINES = ["", "  ", "item 1 done at 10", "item 2 done at 11", "item 33 done at 12", "other text here 5", "other words 7", "plain", "plain", "1234", "é 😀 line 1", "é 😀 line 2"]
TESTS = ["", "", "  ", "FAIL a", "  indented", "\tx", "==== FAILURES ====", "==== 1 failed, 2 passed in 3s ====", "Tests 3 passed", "ok plain", "E   assert", "FAILED x::y", "plain", "Test Suites: 1 failed, 2 total"]
TRACES = ["Traceback (most recent call last):", "Traceback (most recent call last):", '  File "a.py", line 1', '  File "a.py", line 1', "    body()", "    body()", "ValueError: x", "ValueError: y", "    at f (a.js:1)", "    at f (a.js:1)", "plain", ""]
DIFFS = ["diff --git a b", "index 1..2", "@@ -1 +1 @@", "+a", "-b", " c", " d", " e", " f", "", "old mode 1"]


def texts(pool, n, seed, most=60):
    rng = random.Random(seed)
    made = ["\n".join(rng.choices(pool, rng.choices(range(1, 20), k=len(pool)), k=rng.randrange(most))) + "\n" * rng.choice([0, 0, 1, 3]) for _ in range(n)]
    # stretches that reach over many blocks
    return [*made, "", "\n", "\n\n\n\n", "\n\n\n" + pool[3], "\n".join([pool[2]] * 40), "\r\n".join(pool * 3), "\n".join([*pool, *[""] * 30])]


def cut(spark, made, seed):
    """Blocks with ends anywhere between lines, in any order."""
    rng, rows = random.Random(seed), []
    for k, t in enumerate(made):
        ls = t.split("\n")
        at, seq = 0, 0
        while at < len(ls):
            n = rng.choice([1, 1, 2, 3, 8])
            rows.append((k, seq, "\n".join(ls[at : at + n]) + "\n"))
            at, seq = at + n, seq + rng.choice([1, 1, 4])
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, seq long, text string")


CASES = {
    "runs": (S.collapsed_blocks, folds.collapse_runs, LINES),
    "failing": (S.failing_blocks, lambda t: "" if not folds.failing_summary(t).strip("\n") else folds.failing_summary(t), TESTS),
    "traces": (S.trace_blocks, folds.dedup_traces, TRACES),
    "diffs": (S.diff_blocks, folds.diff_context, DIFFS),
    "chain": (S.reduced_blocks, lambda t: folds.chain(t)[0], LINES + TESTS + TRACES),
}


@pytest.mark.parametrize("name", CASES)
def test_cut_anywhere(spark, name):
    fold, plain, pool = CASES[name]
    made = texts(pool, 150, name)
    got = {r["id"]: r["text"] for r in S.whole(fold(cut(spark, made, name))).collect()}
    for k, t in enumerate(made):
        assert got.get(k, "") == plain(t).rstrip("\n"), (name, t)


def test_whole_texts_in_blocks(spark):
    made = texts(TRACES, 30, 3)
    df = spark.createDataFrame([*enumerate(made), (99, None)], "id long, text string")
    rows = S.blocks(df, 10)
    assert {r["id"]: r["text"] for r in S.whole(rows).collect()} == {k: t.replace("\r\n", "\n").rstrip("\n") for k, t in enumerate(made)}
    assert rows.agg(F.max(F.size(F.split("text", "\n")))).first()[0] == 11
    got = {r["id"]: r["text"] for r in S.whole(S.reduced_blocks(rows)).collect()}
    assert all(got.get(k, "") == folds.chain(t)[0].rstrip("\n") for k, t in enumerate(made))


def test_an_id_of_any_kind_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 0, "x 1\n"), ("a", 1, "x 2\nx 3\nx 4\n")], "id string, seq int, text string")
    assert S.whole(S.collapsed_blocks(rows)).first()["text"] == folds.collapse_runs("x 1\nx 2\nx 3\nx 4")
    assert S.whole(S.reduced_blocks(rows.limit(0))).count() == 0


def test_segments_of_a_hot_text_go_to_many_tasks(spark):
    """One text with all rows: no task sees more than a few of its blocks."""
    text = "\n".join(f"step {'abcdefghij'[k % 10]} of {k}" if k % 7 else "----" for k in range(20000))
    rows = S.blocks(spark.createDataFrame([(1, text)], "id long, text string"), 50)
    dealt = S.segments(rows, S.Runs.free).groupBy("segment").count()
    assert dealt.count() > 390 and dealt.agg(F.max("count")).first()[0] <= 2
    assert S.whole(S.collapsed_blocks(rows)).first()["text"] == folds.collapse_runs(text)
