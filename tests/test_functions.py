"""Text functions, folds, commands, settings and JSON on small fixtures."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.config import Config, Filter, RewriteOptions, TeeOptions, load, overlay, safe_pattern
from skein.functions import commands, folds, jsontext
from skein.functions import fixed as K
from skein.functions import text as T


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "n"),
    [("", 0), ("abc", 3), ("é", 1), ("😀", 2)],
)
def test_units_are_utf16(spark, text, n):
    assert one(spark, T.units(F.col("t")), t=text) == n


def test_strip_ansi_takes_real_and_literal_escapes(spark):
    assert one(spark, T.strip_ansi(F.col("t")), t="\x1b[31mred\x1b[0m \\u001b[1mbold\\u001b[0m \x1bMx") == "red bold x"


def test_progress_lines_go_and_are_counted(spark):
    text = "start\n50%\rdownload 10%\n| 3\n- a list item\n100% done\n\n"
    assert one(spark, T.strip_progress(F.col("t")), t=text) == "start\n- a list item\n100% done\n[skein: 2 progress lines omitted]"


def test_progress_only_for_build_output(spark):
    assert one(spark, T.strip_progress(F.col("t")), t="Compiling a v1") == "Compiling a v1"
    assert one(spark, T.strip_progress(F.col("t"), True), t="Compiling a v1") == "[skein: 1 progress lines omitted]"


@pytest.mark.parametrize(("text", "bad"), [("0 failed", False), ("0 FAILED", False), ("2 failed", True), ("10 FAILED", True), ("x\nfatal: no", True), ("an error in prose", False), ("error[E12]: x", True), ("FAIL a", True)])
def test_failure_records(spark, text, bad):
    assert one(spark, T.has_failure(F.col("t")), t=text) is bad


def test_head_tail_keeps_important_lines(spark):
    text = "\n".join(f"line {k}" if k != 50 else "WARNING here" for k in range(100))
    out = one(spark, T.head_tail(F.col("t"), 10, 2, 3), t=text).split("\n")
    assert out == ["line 0", "line 1", "[skein: 95 lines omitted]", "[skein: important omitted lines]", "WARNING here", "line 97", "line 98", "line 99"]


def test_half_up_and_sizes(spark):
    row = spark.sql("select -2.5D a, 2.5D b, 1536L c, 5L d, 2097152L e").select(T.half_up(F.col("a")), T.half_up(F.col("b")), T.human_size(F.col("c")), T.human_size(F.col("d")), T.human_size(F.col("e"))).first()
    assert tuple(row) == (-2, 3, "1.5KB", "5B", "2.0MB")


def test_one_decimal_is_that_of_the_double(spark):
    # 12.35 lies below its half as a double, 1.55 above; 10.25 lies on it, and the even tenth is taken
    known = {12350: "12.3", 11950: "11.9", 1550: "1.6", 10250: "10.2", 10750: "10.8", 1000: "1.0", 999950: "1000.0"}
    values = [*known, *range(50, 400_000, 50), *range(10**12 + 50, 10**12 + 10**6, 100)]
    got = spark.createDataFrame([(n,) for n in values], "n long").select("n", T.one_decimal(F.col("n"), 1000).alias("k"), T.one_decimal(F.col("n"), 1024).alias("kb")).collect()
    assert [r for r in got if (r.k, r.kb) != (f"{r.n / 1000:.1f}", f"{r.n / 1024:.1f}")] == []
    assert {r.n: r.k for r in got if r.n in known} == known
    assert one(spark, T.human_size(F.length("t") * 256), t="x" * 5) == "1.2KB"


@pytest.mark.parametrize(("path", "d", "b"), [("a/b/c", "a/b", "c"), ("c", ".", "c"), ("/c", "/", "c"), ("a/b/", "a", "b")])
def test_paths(spark, path, d, b):
    assert one(spark, F.concat_ws("|", T.dirname(F.col("t")), T.basename(F.col("t"))), t=path) == f"{d}|{b}"


def test_runs_compare_with_their_first_line():
    same = "\n".join(f"build worker {k} processed item {k} files" for k in range(6))
    assert folds.collapse_runs(same) == "build worker 0 processed item 0 files\n[skein: 5 more similar lines collapsed]"
    assert folds.collapse_runs("\n".join(["a 1", "a 2", "a 3"])) == "a 1\na 2\na 3"
    listing = "\n".join(f"{k} x{k}y" for k in range(10))
    assert folds.collapse_runs(listing) == listing


def test_failing_summary_keeps_blocks():
    text = "PASS a\n==== FAILURES ====\nE  assert 1\n==== 1 failed, 3 passed in 2s ====\nnoise\nFAIL b\n  expected 1\n\nPASS c"
    assert folds.failing_summary(text) == "==== FAILURES ====\nE  assert 1\n==== 1 failed, 3 passed in 2s ====\nFAIL b\n  expected 1\n\n[skein: 3 test runner lines omitted]"


def test_traces_fold_frames_and_repeats():
    trace = 'Traceback (most recent call last):\n  File "a", line 1\n    f()\n  File "a", line 1\n    f()\nValueError: x'
    out = folds.dedup_traces("go\n" + trace + "\nretry\n" + trace)
    assert out == 'go\nTraceback (most recent call last):\n  File "a", line 1\n    f()\n[skein: 2 repeated frames]\nValueError: x\n[skein: stack trace repeated 2 times]\nretry'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["item 1 done in 3ms", "item 2 done in 4ms", "", "other line", "x"]), max_size=25))
def test_collapsing_accounts_for_every_line(ls):
    text = "\n".join(ls)
    out = folds.collapse_runs(text).split("\n")
    shown = [x for x in out if not x.startswith(K.MARK)]
    gone = sum(int(x.split()[1]) for x in out if x.startswith(K.MARK))
    assert len(shown) + gone == len(text.rstrip("\n").split("\n"))
    assert set(shown) <= {*ls, ""}


@pytest.mark.parametrize(
    ("command", "family", "binary", "sub"),
    [
        ("git status -s", "git status", "git", "status"),
        ("TOKEN=x npm install lodash", "npm install", "npm", "install"),
        ("npx -p foo eslint src", "npx", "eslint", "src"),
        ("yarn run jest --ci", "yarn run", "jest", "--ci"),
        ("yarn eslint .", "yarn eslint", "eslint", "."),
        ("pnpm --silent exec tsc", "pnpm", "tsc", ""),
        ("/usr/bin/make all", "make", "make", "all"),
        ('"my tool" x', "(other)", "my tool", "x"),
    ],
)
def test_families_and_tools(command, family, binary, sub):
    assert commands.family(command) == family
    m = commands.meta(command)
    assert (m.binary, m.subcommand) == (binary, sub)


@pytest.mark.parametrize("command", ["a | b", "a && b", "echo `x`", "x $(y)", "a\nb", "a > f"])
def test_shell_forms_are_left_alone(command):
    assert commands.meta(command) is None
    assert commands.rewrite(command) is None


def test_unbalanced_commands():
    assert commands.tokenize("echo 'a") is None
    assert commands.family("echo 'a") == "(unknown)"
    assert commands.tokenize("a\\ b 'c d' \"e\\\"f\"") == ["a\\ b", "'c d'", '"e\\"f"']


@pytest.mark.parametrize(
    ("command", "to"),
    [
        ("npm ci", "npm ci --loglevel=error --no-fund --no-audit"),
        ("npm install --no-fund", "npm install --no-fund --loglevel=error --no-audit"),
        ("pip install x", "pip install x -q"),
        ("cargo test", "cargo test --quiet"),
        ("pytest tests", "pytest tests -q"),
        ("git status", "git status --porcelain=v1 -b"),
        ("gradle build", "gradle build -q"),
        ("mvn test", None),
        ("pytest -qq", None),
        ("npm install --verbose", None),
        ("cargo build -- x", None),
        ("docker build .", None),
    ],
)
def test_rewrites_are_idempotent(command, to):
    got = commands.rewrite(command)
    assert (got[0] if got else None) == to
    if to:
        assert commands.rewrite(to) is None


def test_rewrite_options():
    assert commands.rewrite("docker build .", Config(rewrite=RewriteOptions(docker_build=True)))[1] == "docker-build-quiet"
    assert commands.rewrite("git status", Config(rewrite=RewriteOptions(exclude=("git status",)))) is None
    assert commands.rewrite("git status", Config(rewrite=RewriteOptions(enabled=False))) is None


def test_config_layers(tmp_path):
    good, bad, big = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    good.write_text(json.dumps({"minChars": 10, "disable": ["grep"], "filters": [{"matchCommand": "x"}] * 60, "tee": {"mode": "never", "maxFiles": -1}}))
    bad.write_text("{")
    big.write_text(" " * (K.MAX_CONFIG_BYTES + 1))
    config, notes = load(str(good), str(bad), str(big), env={"SKEIN_DISABLE": "Bash, all "})
    assert config.min_chars == 10 and len(config.filters) == 50 and config.tee.mode == "never" and config.tee.max_files == 20
    assert notes == ["malformedConfig", "oversizedConfig"] and config.disabled("read")
    assert overlay(Config(), {"minChars": "x", "disable": ["a", 1], "tee": {"mode": "always"}}) == Config()
    assert overlay(Config(), {"tee": {"mode": "failures", "maxFiles": 3}}).tee == TeeOptions(True, "failures", 3)


def test_environment_is_the_last_layer(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"disable": ["rewrite"], "rewrite": {"enabled": True, "dockerBuild": True}}))
    env = {"SKEIN_DISABLE": "Grep", "SKEIN_MIN_CHARS": "7", "SKEIN_READ_GUARD_LINES": "-1", "SKEIN_READ_DEFAULT_LINES": "12", "SKEIN_REWRITE_EXCLUDE": "git status, npm ", "SKEIN_REWRITE_DOCKER_BUILD": "FALSE"}
    config, notes = load(str(tmp_path / "a.json"), env=env)
    assert notes == [] and config.min_chars == 7 and config.read_guard_lines == K.READ_LINE_LIMIT and config.read_default_lines == 12
    assert config.rewrite == RewriteOptions(True, ("git status", "npm"), False)
    assert config.disabled("grep") and not config.disabled("rewrite") and config.rewrites_off()  # a file says so
    assert load(env={"SKEIN_REWRITE_ENABLED": "false"})[0].rewrites_off() and not load(env={})[0].rewrites_off()
    assert Config().tee == TeeOptions(True, "lossy", 20) and Config().keeps_originals()
    assert not load(env={"SKEIN_DISABLE": "tee"})[0].keeps_originals()


def test_long_objects_are_ordered_in_linear_time():
    import time

    began = time.time()
    text = json.dumps({str(k): k for k in range(60000, 0, -1)})
    assert jsontext.minified(text).startswith('{"1":1,"2":2') and time.time() - began < 5


@pytest.mark.parametrize(("source", "ok"), [("^a+$", True), ("(a+)+", False), ("(a|b)*", False), ("((a+)b)*", False), (r"\(a+\)+", True), ("[(a+)]+", True), ("(ab)+c|d", True), ("(a{2,3})+", False), ("(a?)+", True), (r"(a)\1", False), ("(", False), ("", False), ("x" * 300, False)])
def test_safe_patterns(source, ok):
    assert (safe_pattern(source) is not None) is ok


@pytest.mark.parametrize(
    ("text", "small"),
    [
        ('{"b": 1, "a": [1, 2.0, 1e3]}', '{"b":1,"a":[1,2,1000]}'),
        ('{"2": 0, "1": 0, "x": 1, "x": 2}', '{"1":0,"2":0,"x":2}'),
        ("[1e21, 1e-7, 0.000001, -0, 123456789012345680000]", "[1e+21,1e-7,0.000001,0,123456789012345680000]"),
        ('"é"', '"é"'),
    ],
)
def test_minify(text, small):
    assert jsontext.minified(text) == small


def test_arrays_and_blobs():
    rows = json.dumps([{"b": k, "a": k} for k in range(55)])
    out = json.loads(jsontext.reduced(rows, True))
    assert len(out) == 11 and out[-1] == "[skein: 45 more items, same keys: a,b]"
    assert jsontext.reduced(json.dumps([{"a": 1}, {"b": 1}] * 30), True).count("{") == 60
    blob = "data:image/png;base64," + "A" * 320
    assert jsontext.short_base64(f"x {blob} y") == f"x {blob[:64]}[skein: {len(blob) - 64} base64 chars omitted] y"
    assert jsontext.short_base64("a" * 512) == "a" * 512
    assert jsontext.minified("not json") is None


def test_custom_filter_columns(spark):
    from skein.operators.compressors import custom

    config = Config(filters=(Filter("^make", "m", strip_lines_matching="^skip", max_lines=2), Filter("^none", "n", strip_lines_matching=".*"), Filter("^keep", "k", strip_lines_matching=".", on_empty="keep")))
    df = spark.createDataFrame([("make x", "skip\na\nb\nc"), ("none", "a"), ("keep", "a"), ("other", "a")], "c string, t string")
    made, _ = custom(F.col("t"), F.col("c"), config)
    got = {r["c"]: r["x"] for r in df.select("c", made["text"].alias("x")).collect()}
    assert got == {"make x": "a\nb", "none": None, "keep": "a", "other": None}


def test_least_size_of_a_recovery_copy():
    from skein.config import Config, from_environment

    sizes = {v: from_environment(Config(), {"SKEIN_TEE_MIN": v}).tee.min_bytes for v in ("100", " 7 ", "", "0", "-1", "x", "inf", "2.5")}
    assert sizes == {"100": 100, " 7 ": 7, "": 0, "0": 0, "-1": 4096, "x": 4096, "inf": 4096, "2.5": 2.5}
    assert from_environment(Config(), {}).tee.min_bytes == 4096
