"""Operators, gates, ledger, transcripts, reads, sources and streams on small fixtures."""

import datetime as dt
import json
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from skein.config import Config
from skein.functions import folds
from skein.operators import compressors as C
from skein.operators import ledger as L
from skein.operators import lines as R
from skein.operators import pipeline as P
from skein.operators import reads as D
from skein.operators import transcripts as X
from skein.sources import tables as S
from skein.streaming.state import LedgerMerge, daily_windows, latest_windows, read_cache_stream, run_to_table, windows_to_table


def rows(spark, *lines, id=1):
    return spark.createDataFrame([(id, k, x) for k, x in enumerate(lines)], "id long, pos int, line string")


def text_of(df):
    return df.first()["text"]


def test_grep_chain(spark):
    got = text_of(R.collapse_matches(rows(spark, "a:1:x", "a:2:y", "a:2:y", "a:3:z", "a:4:w", "a:5:v", "--", "b:1:x", "--", "plain")))
    assert got == "a:1:x\na:2:y\na:3:z\n... [skein: 2 more at a:4, a:5]\n--\nb:1:x\n--\nplain\n... [skein: 1 duplicate match lines omitted]"


def test_array_dedup_equals_rows(spark):
    ls = ["a", "--", "b", "a", "--", "", "", "b", "c"]
    out = spark.createDataFrame([("\n".join(ls),)], "t string").select(R.dedup_lines(F.split("t", "\n")).alias("x")).first()["x"]
    kept = R.first_occurrences(rows(spark, *ls)).where("kept").orderBy("pos").collect()
    assert out == [r["line"] for r in kept] == ["a", "--", "b", "--", "", "c"]


def test_glob_groups_cap(spark):
    names = spark.createDataFrame([(1, k, f"d/f{k}") for k in range(60)] + [(1, 60, "top")], "id long, pos int, name string")
    first, second = text_of(R.glob_groups(names)).split("\n")
    assert first.startswith("d/ (60 files: f0, f1,") and first.endswith("f49, ... [skein: 10 more])") and second == "./ (1 files: top)"


DIFF = ["diff --git a/x b/x", "index 1..2", "@@ -1 +1 @@", *[f" c{k}" for k in range(9)], "+new", " d", "index inside", " e", "-old"]


def test_diff_window_equals_fold(spark):
    assert text_of(R.diff_context(rows(spark, *DIFF))) == folds.diff_context("\n".join(DIFF))
    assert "... [skein: 3 unchanged context lines omitted]" in folds.diff_context("\n".join(DIFF))


def compressed(spark, text, command):
    from skein.functions.commands import described

    df = described(spark.createDataFrame([(text, command)], "t string, command string"))
    return df.select(C.compress(F.col("t"), F.col("about"), F.col("command"), F.lit(False)).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("command", "text", "want", "rule"),
    [
        ("git status", "## main...o/main\n M a\n?? b\nMM c", "main...o/main | 2M 1?\n M a\n?? b\nMM c", "gitStatus"),
        ("git status", "## main", "main | clean", "gitStatus"),
        ("git log", "commit abcdef1234\nAuthor: x\nDate: y\n\n    the subject\n\n    body", "abcdef1234 the subject", "gitLog"),
        ("git pull", "Already up to date.\n", "ok git pull:\nAlready up to date.", "gitOperation"),
        ("npm install", "npm warn a\nnpm warn a\ntiming\nadded 3 packages in 1s", "npm install: added 3 packages in 1s\nnpm warn a\n... [skein: 1 duplicate package warnings omitted]\n... [skein: 1 package-manager lines omitted]", "packageManagerSummary"),
        ("go test -json ./...", '{"Action":"run","Package":"p"}\n{"Action":"pass","Package":"p","Test":"T"}', "go test: ok (1 tests, 1 packages)", "goTestJson"),
        ("npx jest", "PASS a\nTests  3 passed\nx", "Tests  3 passed", "testRunnerSummary"),
        ("docker ps", "ID   NAME\n1    a  \n", "ID | NAME\n1 | a", "dockerTable"),
        ("eslint src", "/a/b.js\n  1:1  error  bad thing  no-bad\n\n1 problem", "/a/b.js\n  1:1  error  bad thing  no-bad", "linterDiagnostics"),
        ("ruff check", "all checks passed", "all checks passed", "linterSummary"),
    ],
)
def test_compressors(spark, command, text, want, rule):
    got = compressed(spark, text, command)
    assert (got["text"], got["rule"]) == (want, rule)


@pytest.mark.parametrize(("command", "text"), [("git push", "done"), ("npm install", "fatal: x\nadded 1 packages"), ("git log -p", "commit abcdef1234\n s"), ("ls", "a"), ("docker ps | cat", "a  b\nc  d"), ("go test -json", "not json")])
def test_no_compressor(spark, command, text):
    assert compressed(spark, text, command) is None


def test_lint_three_of_each():
    text = "\n".join(f"a.ts({k},1): error TS1: same" for k in range(5))
    assert folds.lint_summary(text).split("\n")[-1] == "... [skein: 2 identical diagnostics omitted (TS1)]"


def results(spark, *items):
    return spark.createDataFrame(list(items), "id string, command string, stdout string, stderr string, exit_code int, is_image boolean")


def test_outcomes(spark):
    log = "\n".join(f"build worker {k} processed {k} files here" for k in range(30)) + "\n" + "\n".join(f"unique words {chr(97 + k % 26)}{k * 7919} stay" for k in range(3))
    prose = " ".join(f"word{k}" for k in range(200))
    got = P.bash_results(results(
        spark, ("a", "node x", log, "", None, False), ("b", "node x", "short", "", None, False), ("c", "node x", prose, "", None, False),
        ("d", "node x", log + "\nfatal: no", "", None, False), ("e", "node x", log, "", 1, False), ("f", "node x", log, "", None, True), ("g", None, log, None, 0, None),
    ))
    rows_ = {r["id"]: r for r in got.collect()}
    assert {k: r["outcome"] for k, r in rows_.items()} == {"a": "compressed", "b": "skippedBelowThreshold", "c": "skippedPoorRatio", "d": "skippedFailure", "e": "skippedFailure", "f": "skippedImage", "g": "compressed"}
    assert rows_["c"]["out_stdout"] == prose and rows_["c"]["bytes_in"] == rows_["c"]["bytes_out"]
    assert rows_["a"]["out_stdout"].endswith("[skein: collapseRepeatedLines]") and rows_["a"]["lossy"]
    assert P.bash_results(results(spark, ("a", "x", log, "", None, False)), Config(disable=("bash",))).first()["outcome"] == "disabled"


def test_near_empty_guard(spark):
    log = "\n".join(f"build worker {k} processed {k} files here" for k in range(100))
    r = P.generic_chain(spark.createDataFrame([(1, log)], "id int, text string")).first()
    assert r["reduced"] == log and r["rules"] == []


def test_ledger(spark):
    day = dt.date(2024, 1, 30)
    f = spark.createDataFrame([("s", day, "Bash", "git status", "p", 100, 25, 1), ("s", day, "Bash", "ls", "q", 50, 20, 1), ("s", dt.date(2023, 10, 1), "Read", "ls", "p", 3000, 1000, 0)], "session_id string, day date, tool string, command string, project string, bytes_in long, bytes_out long, events long")
    by = {r["tool"]: (r["events"], r["bytes_in"], r["bytes_out"], r["bytes_saved"]) for r in L.by_tool(f).collect()}
    assert by["Bash"] == (2, 150, 45, 105)
    history = L.marginals(f)
    assert history.where("dim = 'tool' and key = 'Read'").first()["events"] == 1
    assert L.retained(history, day).where("key = 'Read'").count() == 0
    assert L.period_report(history, "daily", day).first()["est_tokens"] == 35
    assert {r["section"] for r in L.project_report(history, "p", "all", day).collect()} == {"project", "command"}
    total = L.session_summary(f).where("tool is null").first()
    assert (total["bytes_saved"], total["est_tokens"]) == (2105, 702)
    merged = {(r["day"], r["dim"], r["key"]): r["events"] for r in S.merge_history(history, history).collect()}
    assert merged[(day, "tool", "Bash")] == 4


def test_recovery(spark):
    r = spark.createDataFrame([("s", f"u{k}", k, "x" * 5000, k != 3, k == 5) for k in range(7)], "session_id string, use_id string, seq long, original string, lossy boolean, failed boolean")
    assert [x["use_id"] for x in L.recovery_rows(r, 2).orderBy("nth").collect()] == ["u6", "u5"]
    assert [x["use_id"] for x in L.recovery_rows(r, 2, "failures").collect()] == ["u5"]
    assert L.recovery_rows(r, 0).count() == 0


def line(**kind):
    return json.dumps({"message": {"content": [kind]}})


def test_transcripts(spark, tmp_path):
    use = lambda i, c: line(type="tool_use", id=i, name="Bash", input={"command": c})
    done = lambda i, o: line(type="tool_result", tool_use_id=i, content=o)
    folder = tmp_path / "-home-me"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([done("1", "early"), use("1", "npm install"), done("1", [{"text": "x" * 30}]), use("1", "git status"), done("1", "[skein: y]"), "{broken", done("9", "none")]))
    (folder / "b.jsonl").write_text(done("1", "other file"))
    lines = S.transcript_lines(spark, str(tmp_path), "/home/me")
    pairs = X.pairs(X.recent(X.tool_blocks(lines), dt.datetime(2024, 1, 1)))
    assert sorted((r["command"], r["output"][:3]) for r in pairs.collect()) == [("git status", "[sk"), ("npm install", "xxx")]
    report = X.costs(pairs)
    assert [(r["command"], r["tokens"]) for r in X.section(report, "all").collect()] == [("npm install", 10), ("git status", 3)]
    assert [r["command"] for r in X.section(report, "rewritable").collect()] == ["npm install"]


def reads(spark):
    big, other = "x\n" * 300, "y\n" * 300
    ops = [("Read", False, big), ("Read", False, big), ("Read", True, big), ("Edit", False, other), ("Read", False, other), ("Read", False, big), ("Write", False, big), ("Read", False, big), ("Read", False, "tiny")]
    return spark.createDataFrame([("s", "f", k, op, bounded, False, text) for k, (op, bounded, text) in enumerate(ops)] + [("s", "g", 0, "Edit", False, False, big), ("s", "g", 1, "Read", False, False, big)], "session_id string, path string, seq long, op string, bounded boolean, failed boolean, content string")


def test_read_cache(spark):
    got = {(r["path"], r["seq"]): r for r in D.read_cache(reads(spark)).collect()}
    assert [got["f", k]["hit"] for k in range(9)] == [False, True, False, False, True, False, False, True, False]
    assert got["f", 4]["source"] == "Edit" and got["f", 7]["source"] == "Write"
    assert got["g", 0]["outcome"] == "skippedNoPriorRead" and not got["g", 1]["hit"]
    stubs = D.stubs(D.read_cache(reads(spark)))
    assert stubs.count() == 3 and stubs.where("bytes_out < bytes_in").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    events = reads(spark)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run_to_table(read_cache_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    key = ["session_id", "path", "seq", "op", "hit", "source", "header_lines"]
    got = spark.read.parquet(str(tmp_path / "out")).select(key)
    assert sorted(map(str, got.collect())) == sorted(map(str, D.read_cache(events).select(key).collect()))


def test_ledger_merge_is_idempotent(spark, tmp_path):
    ledger = LedgerMerge(spark, str(tmp_path / "ledger"))
    assert ledger.read().count() == 0
    batch = spark.createDataFrame([(dt.date(2024, 1, 1), "tool", "Bash", 1, 10, 5), (dt.date(2023, 1, 1), "tool", "Bash", 1, 10, 5)], S.HISTORY_SCHEMA)
    for batch_id in (0, 1, 1):
        ledger.write(batch, batch_id)
    assert [r["events"] for r in ledger.read().collect()] == [2, 2]
    ledger.compact()
    ledger.write(batch, 2)
    assert [r["events"] for r in ledger.read().collect()] == [3, 3]
    ledger.compact(dt.date(2024, 2, 1))
    assert [(r["day"], r["events"]) for r in ledger.read().collect()] == [(dt.date(2024, 1, 1), 3)]


def test_history_is_loaded_or_refused(spark, tmp_path):
    assert S.load_history(spark, str(tmp_path / "nothing")).count() == 0
    day = dt.date(2024, 1, 1)
    rows = [(day, "command", "git push https://me:secret@host", 1, 10, 5), (day, "command", "git push", 2, 20, 5), (day, "tool", "git x y", 1, 1, 1)]
    spark.createDataFrame(rows, S.HISTORY_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "h"))
    got = {(r["dim"], r["key"]): r["events"] for r in S.load_history(spark, str(tmp_path / "h")).collect()}
    assert got == {("command", "git push"): 3, ("tool", "git x y"): 1}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.parquet").write_text("no parquet file at all")
    assert S.load_history(spark, str(tmp_path / "bad")).count() == 0
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "h.parquet").write_bytes(b"")


def test_stream_state_of_another_version_counts_as_none():
    from skein.streaming import state

    assert state.valid((1, "h", 3, "Read"))
    assert not any(state.valid(x) for x in ((0, "h", 3, "Read"), (1, None, 3, "Read"), (1, "h", 3, "Other"), ("h", 3, "Read")))


def test_daily_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 23, 59)
    facts = spark.createDataFrame([(at, "Bash", 10, 5), (at + dt.timedelta(minutes=2), "Bash", 1, 1), (at, "Read", 7, 2), (at, "Bash", 10, 5)], "ts timestamp, tool string, bytes_in long, bytes_out long")
    facts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    daily_windows(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r["day"]), r["tool"]): (r["events"], r["bytes_in"]) for r in spark.table("days").collect()}
    assert got == {("2024-01-01", "Bash"): (2, 20), ("2024-01-02", "Bash"): (1, 1), ("2024-01-01", "Read"): (1, 7)}


def test_daily_windows_leave_the_state(spark, tmp_path):
    schema = "ts timestamp, tool string, bytes_in long, bytes_out long"
    for k in range(6):  # ten days a file
        rows = [(dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=10 * k + i), f"t{i % 2}", 1, 1) for i in range(10) for _ in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows_to_table(daily_windows(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 22
    got = latest_windows(spark, str(tmp_path / "out")).collect()
    assert len(got) == 60 and {r["events"] for r in got} == {2}


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 10, 5)], "day string, bytes_in long, bytes_out long")
    S.write_report(rows, str(tmp_path / "csv"))
    S.write_report(rows, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["bytes_out"] == "5"
    assert spark.read.json(str(tmp_path / "json")).first()["bytes_in"] == 10
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    assert [r["text"] for r in S.text_files(spark, str(tmp_path / "t"), "*.txt").collect()] == ["one\ntwo\n"]


def test_period_of_a_month(spark):
    days = [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 31), dt.date(2024, 2, 1)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    assert [r["day"] for r in df.where(L.in_period(F.col("day"), "monthly", dt.date(2024, 1, 15))).collect()] == days[1:3]


def test_recovery_path_keeps_what_components_keep(spark):
    got = spark.createDataFrame([("s.1", "a b~!'()*/é%")], "s string, u string").select(L.recovery_path(F.col("s"), F.col("u")).alias("p")).first()["p"]
    assert got == "s%2E1/a%20b~!'()*%2F%C3%A9%25.log"


def test_read_guard_cuts_inside_a_character(spark):
    text = "é" * (5 * 1024 * 1024 // 2 - 1) + "\n" + "é" * 10  # byte 5 MiB is the first of a character
    got = D.read_guard(spark.createDataFrame([("a", "x" + text)], "path string, text string"), Config(read_guard_lines=1)).first()
    assert got["capped"] and got["n_lines"] == 2


GREP = "\n".join([f"src/a.py:{k}:match number {k} of this file" for k in range(40)] + ["src/a.py:3:match number 3 of this file", "--", "src/b.py:1:other"])
NAMES = [f"src/d{k % 3}/file{k}.py" for k in range(150)]


def test_tool_results(spark):
    from skein.operators import tools

    grep = lambda **r: json.dumps({"mode": "content", "numFiles": 2, "filenames": [], "content": GREP, "numLines": 43} | r)
    rows = [("a", grep()), ("b", grep(content="short")), ("c", json.dumps({"filenames": ["a"]})), ("d", json.dumps("\n".join(f"line {k} alone" for k in range(60)))), ("e", grep(mode="count", content=7)), ("f", None), ("g", GREP)]
    got = {r["id"]: r for r in tools.grep_results(spark.createDataFrame(rows, "id string, tool_response string")).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"a": "compressed", "b": "skippedBelowThreshold", "c": "unsupportedShape", "d": "skippedPoorRatio", "e": "unsupportedShape", "f": "unsupportedShape", "g": "compressed"}
    record = json.loads(got["a"]["record"])
    assert list(record) == ["mode", "numFiles", "filenames", "content", "numLines"] and record["numLines"] == record["content"].count("\n") + 1 == 7
    assert record["content"].endswith("... [skein: 1 duplicate match lines omitted]") and got["g"]["record"] == record["content"]
    assert got["a"]["size_in"] == len(GREP) and got["a"]["size_out"] == len(record["content"]) and got["d"]["record"] is None
    off = tools.grep_results(spark.createDataFrame(rows[:1], "id string, tool_response string"), Config(disable=("grep",))).first()
    assert off["outcome"] == "disabled"

    files = [("a", json.dumps({"filenames": NAMES, "durationMs": 3, "truncated": False})), ("b", json.dumps({"filenames": NAMES[:100]})), ("c", '{"filenames":"x"}'), ("d", json.dumps({"filenames": [f"d{k}/f" for k in range(101)]})), ("e", None), ("f", json.dumps({"filenames": ["a"] * 101}))]
    got = {r["id"]: r for r in tools.glob_results(spark.createDataFrame(files, "id string, tool_response string")).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"a": "compressed", "b": "skippedBelowThreshold", "c": "unsupportedShape", "d": "skippedPoorRatio", "e": "unsupportedShape", "f": "skippedBelowThreshold"}
    record = json.loads(got["a"]["record"])
    assert record["durationMs"] == 3 and len(record["filenames"]) == 3 and record["filenames"][1].startswith("src/d1/ (50 files: file1.py, file4.py")
    assert got["a"]["size_in"] == len(json.dumps(NAMES, separators=(",", ":")))

    pretty = json.dumps([{"k": k, "name": "n"} for k in range(60)], indent=4)
    rows = [("a", json.dumps({"content": pretty, "extra": "kept"})), ("b", json.dumps({"content": "word " * 200})), ("c", "{}"), ("d", json.dumps([{"type": "image"}, {"type": "text", "text": pretty}]))]
    got = {r["id"]: r for r in tools.json_results(spark.createDataFrame(rows, "id string, tool_response string"), Config(fold_arrays=True)).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"a": "compressed", "b": "skippedPoorRatio", "c": "unsupportedShape", "d": "compressed"}
    assert json.loads(got["a"]["record"])["extra"] == "kept" and len(json.loads(json.loads(got["d"]["record"])[1]["text"])) == 11


def test_file_results(spark):
    from skein.operators import tools

    big, other = "x\n" * 300, "y\n" * 300
    read = lambda text, **given: ("Read", json.dumps({"file_path": "f"} | given), json.dumps({"type": "text", "file": {"filePath": "f", "content": text, "numLines": 301, "startLine": 1}}), None, False)
    change = lambda tool, text, path="f", back='{"ok":true}', error=False: (tool, json.dumps({"file_path": path} if path else {}), back, text, error)
    steps = [
        (read(big), "skippedFirstRead"), (read(big), "deduped"), (read(big, offset=3), "skippedFirstRead"), (read("tiny"), "skippedBelowThreshold"), (("Read", "{}", '{"x":1}', None, False), "unsupportedShape"),
        (change("Edit", other), "updated"), (read(other), "deduped"), (change("Edit", big, error=True), "toolFailed"), (change("Write", big, back='{"error":"no"}'), "toolFailed"), (read(other), "deduped"),
        (change("Edit", big, path="g"), "skippedNoPriorRead"), (change("Write", "z\n" * 3000), "skippedOversized"), (change("Edit", big, path=None), "missingPath"), (change("Move", big), "unsupportedTool"), (change("Write", None), "failedOpen"),
        (change("Write", big), "updated"), (read(big), "deduped"),
    ]
    rows = [(str(k), "s", k, *step) for k, (step, _) in enumerate(steps)]
    events = spark.createDataFrame(rows, "id string, session_id string, seq long, tool_name string, tool_input string, tool_response string, content_after string, is_error boolean")
    got = {int(r["id"]): r for r in tools.file_results(events).collect()}
    assert [got[k]["outcome"] for k in range(len(steps))] == [want for _, want in steps]
    assert [got[k]["bucket"] for k in (1, 6, 16)] == ["Read", "Edit", "Edit"]
    record = json.loads(got[1]["record"])["file"]
    assert record["content"].startswith("[skein: f unchanged since previous read") and record["numLines"] == 1 and record["startLine"] == 1
    assert tools.file_results(events, Config(disable=("all",))).where("outcome <> 'disabled'").count() == 0


def test_read_guard(spark):
    got = D.read_guard(spark.createDataFrame([("a", "x\n" * 20), ("b", "x")], "path string, text string"), Config(read_guard_lines=10)).collect()
    assert [r["path"] for r in got] == ["a"] and "21 lines (~13 tokens)" in got[0]["advice"]


def test_located_text(spark):
    cases = {'"plain"': ("plain", "string"), "raw text": ("raw text", "plain"), '{"file":{"content":"c"}}': ("c", "file"), '{"output":"o"}': ("o", "output"), '[{"type":"text","text":"t"}]': ("t", "blocks"), '[{"type":"text","text":"t"},{"type":"text","text":"u"}]': (None, None), '{"x":1}': (None, None)}
    text, shape = S.located_text("r")
    got = {r["r"]: (r["t"], r["s"]) for r in spark.createDataFrame([(k,) for k in cases], "r string").select("r", text.alias("t"), shape.alias("s")).collect()}
    assert got == cases


def test_events_and_outputs(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"tool_name":"Bash","session_id":"s"}\nnot json\n')
    assert S.tool_events(spark, str(tmp_path / "e.json")).count() == 1
    r = spark.createDataFrame([("a", "o", "", "compressed", None, None), ("b", "o", "", "skippedFailure", None, None)], "id string, out_stdout string, out_stderr string, outcome string, interrupted boolean, is_image boolean")
    got = {x["id"]: x["record"] for x in S.replacement(r).collect()}
    assert json.loads(got["a"])["stdout"] == "o" and got["b"] is None


def log_lines(n):
    for k in range(n):
        yield from (f"commit {k:07x}", "Author: a", "Date: today", "", *([f"    subject {k}"] if k % 11 else []))


def log_subject(k, n):
    return f"subject {k}" if k % 11 else f"commit {k + 1:07x}" if k + 1 < n else None


def test_subjects_of_a_long_log_take_one_pass(spark):
    n = 4000
    lines = spark.createDataFrame([("a", k, x) for k, x in enumerate(log_lines(n))], "id string, pos long, line string")
    began = time.time()
    got = R.log_subjects(lines).orderBy("pos").select("hash", "subject").collect()
    assert time.time() - began < 30
    assert [tuple(r) for r in got] == [(f"{k:07x}", log_subject(k, n)) for k in range(n)]


def test_summary_of_a_long_log_takes_one_pass(spark):
    n = 2399
    df = spark.createDataFrame([("\n".join(log_lines(n)),)], "t string")
    began = time.time()
    got = df.select(C.git_log(F.col("t"), F.array(F.lit("git"), F.lit("log")))["text"]).first()[0]
    assert time.time() - began < 30
    assert got.split("\n") == [" ".join(filter(None, (f"{k:07x}", log_subject(k, n)))) for k in range(n)]
    one = spark.sql("select 'Author: x\ncommit abcdef0\nDate: y' a, 'no log' b, cast(null as string) c")
    assert tuple(one.select(*(C.git_log(F.col(x), F.array().cast("array<string>"))["text"] for x in "abc")).first()) == ("abcdef0", None, None)


def test_shell_results_hold_a_long_text_in_one_step(spark):
    """No two Python steps, each of which holds whole rows, lie between two tables."""
    diff = "\n".join(["diff --git a/x b/x", *(f"{'+' if k % 3 == 0 else ' '}line {k}" for k in range(200))])
    lint = "\n".join(f"src/a.ts({k},1): error TS1000: message" for k in range(40))
    runs = "\n".join(["go", *(f"worker {k} processed item {k} of the long queue" for k in range(14))])
    df = spark.createDataFrame([("d", "git diff", diff, "", None, None), ("l", "npx tsc", lint, "", None, None), ("r", "node x", runs, "", None, None)], "id string, command string, stdout string, stderr string, exit_code int, is_image boolean")
    out = P.bash_results(df)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["out_stdout"], list(r["rules"]), r["outcome"]) for r in out.collect()}
    assert got["d"] == (diff, [], "skippedPoorRatio")
    assert got["l"][1:] == (["linterDiagnostics"], "compressed") and got["r"][1:] == (["collapseRepeatedLines"], "compressed")
    assert got["r"][0] == "go\nworker 0 processed item 0 of the long queue\n[skein: 13 more similar lines collapsed]\n[skein: collapseRepeatedLines]"


def test_folds_cut_long_texts_in_stretches():
    """A fold takes no list of all lines, which would be many times the text."""
    text = "\n".join(f"{'+' if k % 5 == 0 else ' '}line {k}" for k in range(300_000))
    for fold, most in ((folds.diff_context, 4), (folds.dedup_traces, 4)):
        tracemalloc.start()
        assert fold(text) == text
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text)
