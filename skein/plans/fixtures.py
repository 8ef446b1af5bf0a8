"""Texts of fifteen kinds of tool output, composed by rules, on which the reduction is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.commands import described
from skein.operators import pipeline as P
from skein.operators import reports as O
from skein.operators.compressors import compress

_NAMES = "amber birch cedar delta ember flint grove heath iris jasper kelp larch maple north olive poplar quartz river slate thorn".split()


def _name(k: int) -> str:
    return _NAMES[k % len(_NAMES)] + (f"_{_NAMES[k // len(_NAMES)]}" if k >= len(_NAMES) else "")


def _cargo() -> str:
    ls = [f"\\u001b[1m\\u001b[32m   Compiling\\u001b[0m {_name(k)} v0.{k}.{k % 3}" for k in range(38)]
    ls += ["warning: unused variable: `total`", "  --> src/main.rs:12:9", "   |", "12 |     let total = 3;", "   |         ^^^^^ help: prefix it with an underscore", "    Finished dev [unoptimized + debuginfo] target(s) in 12.5s"]
    return "\n".join(ls)


def _pull() -> str:
    bars = r"\r".join(f"{k:03x}9f{k}ab77c: Downloading [{'=' * (k // 2)}>{' ' * (20 - k // 2)}] {k * 2}.1MB/80MB" for k in range(4, 36, 4))
    return "\n".join(["latest: Pulling from library/web", *[f"a{k}b{k}c{k}d{k}e{k}f0: Pulling fs layer" for k in range(3)], bars, bars, "Digest: sha256:" + "ab12" * 16, "Status: Downloaded newer image for web:latest", "docker.io/library/web:latest"])


def _npm() -> str:
    ls = [f"npm timing reify:{_name(k)}: timing reifyNode:node_modules/{_name(k)} Completed in {k * 7 + 3}ms" for k in range(46)]
    steps = [f"npm timing {_name(k)}{_name(k + 3).title()} done, {_name(k + 7)} follows" for k in range(9)]
    return "\n".join(["npm timing idealTree Completed in 812ms", *ls, *steps, "npm warn deprecated old-thing@1.0.0: use new-thing", r"reify: 10%\rreify: 55%\rreify: 90%", "added 212 packages, and audited 213 packages in 9s", "found 0 vulnerabilities"])


def _commits() -> str:
    one = lambda k: f"commit {k:02x}c0ffee{k:02x}5eed{k:02x}0ddba11{k:02x}abcdef{k:02x}12345\nAuthor: {_name(k)} <{_name(k)}@mail.test>\nDate:   Mon Jan {k + 1} 10:00:00 2024 +0000\n\n    Let the {_name(k + 3)} part read its {_name(k + 5)} first\n"
    return "\n".join(map(one, range(15)))


def _failing_jest() -> str:
    ls = [f"\\u001b[32mPASS\\u001b[0m src/{_name(k)}.test.js ({k * 11} ms)" for k in range(30)]
    return "\n".join([*ls, "\\u001b[31mFAIL\\u001b[0m src/sum.test.js", "  adds numbers", "    Expected: 4", "    Received: 5", "      11 | test('adds numbers', () => {", "    > 12 |   expect(add(2, 2)).toBe(5);", "      13 | });", "", "Tests:       1 failed, 30 passed, 31 total", "Time:        3.2 s"])


def _pytest(bad: bool) -> str:
    ls = [f"tests/test_{_name(k)}.py::test_{_name(k + 1)} PASSED" for k in range(30 if bad else 38)]
    if not bad:
        return "\n".join(["===== test session starts =====", *ls, "===== 38 passed in 2.10s ====="])
    return "\n".join(["===== test session starts =====", *ls, "tests/test_sum.py::test_adds FAILED", "===== FAILURES =====", "    def test_adds():", ">       assert add(2, 2) == 5", "E       assert 4 == 5", "===== short test summary info =====", "FAILED tests/test_sum.py::test_adds", "===== 1 failed, 30 passed in 2.30s ====="])


def _traces() -> str:
    trace = ["Traceback (most recent call last):", *[f'  File "/app/{_name(k)}.py", line {k + 10}, in {_name(k + 2)}\n    {_name(k + 4)}.call()' for k in range(4)], "ConnectionError: no route to host"]
    return "\n".join(f"retry number {'x' * k}\n" + "\n".join(trace) for k in range(1, 7))


def texts() -> list[tuple[str, str, str, str]]:
    """(name, command, channel, text)."""
    return [
        ("cargo-build", "cargo build", "stderr", _cargo()),
        ("docker-ps", "docker ps", "stdout", "CONTAINER ID   IMAGE        COMMAND       STATUS       PORTS\n0a1b2c3d4e5f   web:latest   \"/bin/serve\"   Up 3 hours   80/tcp"),
        ("docker-pull", "docker pull web:latest", "stderr", _pull()),
        ("eslint", "eslint src", "stdout", "/app/src/main.js\n  3:7  warning  'total' is never used  no-unused-vars\n  9:1  error  Missing semicolon  semi\n\n2 problems"),
        ("git-diff", "git diff", "stdout", "diff --git a/a.txt b/a.txt\nindex 1111111..2222222 100644\n--- a/a.txt\n+++ b/a.txt\n@@ -1,2 +1,2 @@\n same\n-old\n+new"),
        ("git-log", "git log", "stdout", _commits()),
        ("git-status-porcelain", "git status --porcelain=v1 -b", "stdout", "## main...origin/main\n M src/a.py\n?? notes.txt\nMM src/b.py"),
        ("go-test-json", "go test -json ./...", "stdout", '{"Action":"run","Package":"app/a","Test":"TestOne"}\n{"Action":"pass","Package":"app/a","Test":"TestOne"}\n{"Action":"pass","Package":"app/a"}'),
        ("npm-install", "npm install", "stdout", _npm()),
        ("npm-test-failing", "npm test", "stdout", _failing_jest()),
        ("pytest-failing", "pytest", "stdout", _pytest(True)),
        ("pytest-passing", "pytest", "stdout", _pytest(False)),
        ("stacktrace-repeat", "node script.mjs", "stdout", _traces()),
        ("tsc", "tsc --noEmit", "stdout", "src/a.ts(3,5): error TS2322: Type 'string' is not assignable to type 'number'.\nsrc/b.ts(9,1): error TS2304: Cannot find name 'total'."),
        ("webpack", "webpack", "stdout", "\n".join(f"  ./src/{_name(k)}/{_name(k * 7 + 2)}.js {k * 13 % 90 + 1}.{k % 9} KiB [built] [{'code generated' if k % 2 else 'cached'}] chunk {_name(k + 9)}" for k in range(36))),
    ]


def reductions(spark: SparkSession) -> DataFrame:
    """(name, bytes_in, percent, whole_percent, rules): the compressor or chain alone, and the whole way through all gates."""
    rows = spark.createDataFrame([(n, c, t if ch == "stdout" else "", t if ch == "stderr" else "", t) for n, c, ch, t in texts()], "name string, command string, stdout string, stderr string, text string")
    df = P.settled(described(rows).withColumn("special", compress(F.col("text"), F.col("about"), F.col("command"), F.lit(False))))
    df = P.generic_chain(df)
    small = F.coalesce(F.col("special.text"), F.col("reduced"))
    rules = F.when(F.col("special").isNotNull(), F.col("special.rule")).otherwise(F.array_join("rules", ", "))
    plain = df.select("name", F.octet_length("text").alias("bytes_in"), F.octet_length(small).alias("bytes_out"), rules.alias("rules"))
    events = rows.select(F.col("name").alias("id"), "command", "stdout", "stderr", F.lit(None).cast("int").alias("exit_code"), F.lit(False).alias("is_image"))
    whole = P.bash_results(events).select(F.col("id").alias("name"), "bytes_in", "bytes_out")
    return O.ratio_report(plain, whole)


def floors(spark: SparkSession) -> DataFrame:
    """(name, percent) of the generic chain alone, by UTF-16 units."""
    rows = spark.createDataFrame([(n, t) for n, _, _, t in texts()], "name string, text string")
    n_in, n_out = T.units(F.col("text")), T.units(F.col("reduced"))
    return P.generic_chain(rows).select("name", T.reduction_percent(n_in, n_out).alias("percent"))
