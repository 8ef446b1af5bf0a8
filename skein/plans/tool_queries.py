"""Queries of per-tool results, sources, sinks, records and reports over the test tables, each beside its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import Config, Filter, RewriteOptions, TeeOptions
from skein.functions import fixed as K
from skein.functions import text as T
from skein.functions.commands import described
from skein.operators import compressors as C
from skein.operators import ledger as L
from skein.operators import lines as R
from skein.operators import pipeline as P
from skein.operators import reads as D
from skein.operators import reports as O
from skein.operators import tools
from skein.operators import transcripts as X
from skein.plans import adapters as A
from skein.plans.oracles import ARRAYS, CHAIN, FACTS, FAILING, GREP, HISTORY, LOGS, READS, RUNNER
from skein.plans.oracles import ORACLES as _ORACLES
from skein.sources import tables as S
from skein.sources.recovery import RecoveryStore
from skein.streaming.history import History, ledger_stream
from skein.streaming.sessions import held_state, last_set, session_reads, session_reads_to_table
from skein.streaming.state import LedgerMerge, daily_windows, latest_windows, windows_to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _say(*parts: object) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- results by tool ----

_GREP_OUT = f"""WITH {GREP}, s AS (SELECT id, pos, line, CASE WHEN line <> '--' THEN string_split(line, ':')[1] END AS path, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM gk WHERE kept),
    i AS (SELECT *, rn - row_number() OVER (PARTITION BY id, path ORDER BY pos) AS g FROM s),
    c AS (SELECT *, count(*) OVER (PARTITION BY id, path, g) AS n, row_number() OVER (PARTITION BY id, path, g ORDER BY pos) AS nth FROM i),
    parts AS (SELECT id, pos, 0 AS part, line FROM c WHERE path IS NULL OR n <= 3 OR nth <= 3
      UNION ALL SELECT id, min(pos), 1, '... [skein: ' || count(*) || ' more at ' || string_agg(string_split(line, ':')[1] || ':' || string_split(line, ':')[2], ', ' ORDER BY pos) || ']' FROM c WHERE path IS NOT NULL AND n > 3 AND nth > 3 GROUP BY id, path, g
      UNION ALL SELECT id, 2147483647, 2, '... [skein: ' || count(*) || ' duplicate match lines omitted]' FROM gk WHERE NOT kept GROUP BY id),
    small AS (SELECT id, string_agg(line, chr(10) ORDER BY pos, part) AS small FROM parts GROUP BY id),
    whole AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS text FROM gr GROUP BY id),
    o AS (SELECT id, text, small, CASE WHEN id % 10 = 9 THEN 'unsupportedShape' WHEN length(text) < 500 THEN 'skippedBelowThreshold' WHEN (length(text) - length(small)) * 10 < length(text) THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome FROM whole JOIN small USING (id))"""


def _grep_events(spark: SparkSession, d: str) -> DataFrame:
    text = R.joined(A.grep_rows(spark, d))
    shape = F.when(F.col("id") % 10 == 9, F.to_json(F.struct(F.lit("count").alias("mode"), F.lit(3).alias("content")))).otherwise(F.to_json(F.struct(F.lit("content").alias("mode"), F.lit(1).alias("numFiles"), F.col("text").alias("content"), F.size(T.lines(F.col("text"))).alias("numLines"))))
    return text.select("id", shape.alias("tool_response"))


@query(f"{_GREP_OUT} SELECT id, outcome, CASE WHEN outcome = 'compressed' THEN length(text) END AS size_in, CASE WHEN outcome = 'compressed' THEN length(small) END AS size_out, CASE WHEN outcome = 'compressed' THEN small END AS content, CASE WHEN outcome = 'compressed' THEN len(string_split(small, chr(10)))::BIGINT END AS lines FROM o")
def grep_end_to_end(spark, d):
    out = tools.grep_results(_grep_events(spark, d))
    return out.select("id", "outcome", "size_in", "size_out", F.get_json_object("record", "$.content").alias("content"), F.get_json_object("record", "$.numLines").cast("long").alias("lines"))


@query("""WITH n AS (SELECT source || '/' || lang AS id, doc_id AS pos, lang || '/' || (doc_id % 7) || '/' || source AS dir, 'd' || doc_id AS base FROM documents UNION ALL SELECT lang, doc_id, lang || '/' || doc_id, 'd' FROM documents UNION ALL SELECT 'all', doc_id, 'x' || (doc_id % 3), 'file' || doc_id FROM documents),
    g AS (SELECT id, dir, min(pos) AS pos, list(base ORDER BY pos) AS bs FROM n GROUP BY id, dir),
    l AS (SELECT id, list(dir || '/ (' || len(bs) || ' files: ' || array_to_string(bs[1:50], ', ') || CASE WHEN len(bs) > 50 THEN ', ... [skein: ' || (len(bs) - 50) || ' more]' ELSE '' END || ')' ORDER BY pos) AS ls FROM g GROUP BY id),
    w AS (SELECT id, count(*) AS k, sum(length(dir || '/' || base) + 3) + 1 AS n_in FROM n GROUP BY id),
    o AS (SELECT id, k, n_in, ls, list_sum(list_transform(ls, lambda x: length(x) + 3)) + 1 AS n_out FROM w JOIN l USING (id)),
    r AS (SELECT *, CASE WHEN n_in < 500 OR k <= 100 THEN 'skippedBelowThreshold' WHEN (n_in - n_out) * 10 < n_in THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome FROM o)
    SELECT id, outcome, CASE WHEN outcome = 'compressed' THEN n_in::BIGINT END AS size_in, CASE WHEN outcome = 'compressed' THEN n_out::BIGINT END AS size_out, CASE WHEN outcome = 'compressed' THEN array_to_string(ls, chr(10)) END AS text FROM r""")
def glob_end_to_end(spark, d):
    t = S.table(spark, d, "documents")
    n = F.col("doc_id")
    names = t.select(_say(F.col("source"), "/", F.col("lang")).alias("id"), n.alias("pos"), _say(F.col("lang"), "/", n % 7, "/", F.col("source"), "/d", n).alias("name"))
    names = names.unionByName(t.select(F.col("lang").alias("id"), n.alias("pos"), _say(F.col("lang"), "/", n, "/d").alias("name"))).unionByName(t.select(F.lit("all").alias("id"), n.alias("pos"), _say("x", n % 3, "/file", n).alias("name")))
    files = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    events = names.groupBy("id").agg(F.to_json(F.struct(files.alias("filenames"), F.lit(3).alias("durationMs"))).alias("tool_response"))
    out = tools.glob_results(events)
    return out.select("id", "outcome", "size_in", "size_out", F.array_join("filenames", "\n").alias("text"))


@query(f"""WITH {ARRAYS}, t AS (SELECT id, n, '[' || CASE WHEN n > 50 THEN array_to_string(smalls[1:10], ',') || ',"[skein: ' || (n - 10) || ' more items, same keys: ' || CASE WHEN id LIKE 's%' THEN 'flag,line,order' ELSE 'order' END || ']"' ELSE array_to_string(smalls, ',') END || ']' AS small,
    (SELECT 1) AS one FROM jt), w AS (SELECT id, '[' || string_agg(line, ',' || chr(10) || ' ' ORDER BY a, b, line) || ']' AS text FROM ja GROUP BY id),
    o AS (SELECT id, text, small, CASE WHEN length(text) < 500 THEN 'skippedBelowThreshold' WHEN (length(text) - length(small)) * 10 < length(text) THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome FROM w JOIN t USING (id))
    SELECT id, outcome, CASE WHEN outcome = 'compressed' THEN strlen(text) END AS size_in, CASE WHEN outcome = 'compressed' THEN strlen(small) END AS size_out, CASE WHEN outcome = 'compressed' THEN small END AS text FROM o""")
def mcp_end_to_end(spark, d):
    arrays = A.json_arrays(spark, d)
    response = F.when(F.col("id").startswith("s"), F.to_json(F.struct(F.col("text").alias("content"), F.lit("kept").alias("extra")))).otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))))
    out = tools.json_results(arrays.select("id", response.alias("tool_response")), Config(fold_arrays=True))
    return out.select("id", "outcome", "size_in", "size_out", F.coalesce(F.get_json_object("record", "$.content"), F.get_json_object("record", "$[0].text")).alias("text"))


_FILES = """fe AS (SELECT 's' || (doc_id // 60) AS session_id, doc_id AS seq, doc_id * 7 % 4 AS f, (doc_id * 13 // 7) % 6 AS step, doc_id % 17 = 16 AS bad, doc_id % 19 = 18 AS nopath,
     'file ' || (doc_id * 7 % 4) || ' version ' || ((doc_id // 13) % 2) || chr(10) || repeat('x y z' || chr(10), CASE WHEN doc_id % 23 = 22 THEN 2500 WHEN doc_id % 29 = 28 THEN 5 ELSE 100 END::INT) AS content FROM documents),
  ff AS (SELECT *, CASE WHEN step < 3 THEN 'Read' WHEN step = 3 THEN 'Edit' WHEN step = 4 THEN 'Write' ELSE 'Move' END AS op, sha256(content) AS hash, len(string_split(content, chr(10))) AS n_lines FROM fe),
  fg AS (SELECT *, CASE WHEN op = 'Read' THEN CASE WHEN length(content) < 500 THEN 'skippedBelowThreshold' END WHEN op = 'Move' THEN 'unsupportedTool' WHEN bad THEN 'toolFailed' WHEN nopath THEN 'missingPath' END AS gate FROM ff),
  fh AS (SELECT *, gate IS NULL AND NOT nopath AND (op <> 'Read' OR step <> 2) AND (op = 'Read' OR n_lines <= 2000) AS ok FROM fg),
  fs AS (SELECT *, coalesce(bool_or(ok AND op <> 'Edit') OVER b, false) AS seeded FROM fh WINDOW b AS (PARTITION BY session_id, f ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ft AS (SELECT *, ok AND (op <> 'Edit' OR seeded) AS touches FROM fs),
  fu AS (SELECT *, last_value(CASE WHEN touches THEN hash END IGNORE NULLS) OVER b AS old FROM ft WINDOW b AS (PARTITION BY session_id, f ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  fv AS (SELECT *, op = 'Read' AND touches AND coalesce(hash = old, false) AS hit FROM fu),
  fw AS (SELECT *, last_value(CASE WHEN touches AND NOT hit THEN op END IGNORE NULLS) OVER b AS setter FROM fv WINDOW b AS (PARTITION BY session_id, f ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_FILES} SELECT seq AS id, op AS tool_name, CASE WHEN hit THEN CASE WHEN setter = 'Read' THEN 'Read' ELSE 'Edit' END END AS bucket,
    coalesce(gate, CASE WHEN hit THEN 'deduped' WHEN op = 'Edit' AND NOT seeded THEN 'skippedNoPriorRead' WHEN op <> 'Read' AND n_lines > 2000 THEN 'skippedOversized' WHEN op <> 'Read' THEN 'updated' ELSE 'skippedFirstRead' END) AS outcome, CASE WHEN hit THEN strlen(content) END AS size_in FROM fw""")
def edit_cache_outcomes(spark, d):
    t = S.table(spark, d, "documents")
    n = F.col("doc_id")
    step, f = F.floor(n * 13 / 7) % 6, n * 7 % 4
    op = F.when(step < 3, "Read").when(step == 3, "Edit").when(step == 4, "Write").otherwise("Move")
    size = F.when(n % 23 == 22, 2500).when(n % 29 == 28, 5).otherwise(100)
    rows = t.select(n.alias("id"), _say("s", F.floor(n / 60)).alias("session_id"), n.alias("seq"), op.alias("tool_name"), step.alias("step"), _say("f", f).alias("path"), size.alias("size")).withColumn("content", F.concat(_say("file ", F.substring("path", 2, 9), " version ", F.floor(F.col("id") / 13) % 2, "\n"), F.expr("repeat('x y z\\n', size)")))
    is_read = F.col("tool_name") == "Read"
    nopath = F.col("id") % 19 == 18
    events = rows.select(
        "id", "session_id", "seq", "tool_name",
        F.to_json(F.struct(F.when(~nopath, F.col("path")).alias("file_path"), F.when(F.col("step") == 2, 5).alias("limit"))).alias("tool_input"),
        F.when(is_read, F.to_json(F.struct(F.struct(F.col("content"), F.lit(1).alias("startLine")).alias("file")))).when(F.col("id") % 17 == 16, F.lit('{"error":"no"}')).otherwise(F.lit('{"ok":true}')).alias("tool_response"),
        F.when(~is_read, F.col("content")).alias("content_after"), F.lit(False).alias("is_error"),
    )
    return tools.file_results(events).select("id", "tool_name", "bucket", "outcome", "size_in")


_SHAPES = "sh AS (SELECT doc_id AS id, 'text of ' || doc_id AS t, doc_id % 9 AS k FROM documents)"


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    t = _say("text of ", F.col("doc_id"))
    one = F.struct(F.lit("text").alias("type"), t.alias("text"))
    kinds = [F.to_json(F.struct(F.struct(t.alias("content"), F.lit(1).alias("numLines")).alias("file"))), F.to_json(F.struct(t.alias("content"), F.lit("s").alias("side"))), F.to_json(F.struct(t.alias("output"), F.lit(7).alias("text"))), F.to_json(F.struct(t.alias("text"))), F.to_json(F.array(one)), F.to_json(F.array(one, one)), F.to_json(F.struct(F.lit(1).alias("x"))), t, _say('"', t, '"')]
    k = F.col("doc_id") % 9
    response = F.lit(None).cast("string")
    for i, x in enumerate(kinds):
        response = F.when(k == i, x).otherwise(response)
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), response.alias("tool_response"))


@query(f"WITH {_SHAPES} SELECT id, CASE WHEN k IN (5, 6) THEN NULL ELSE t END AS text, ['file', 'content', 'output', 'text', 'blocks', NULL, NULL, 'plain', 'string'][k + 1] AS shape FROM sh")
def located_shapes(spark, d):
    text, shape = S.located_text()
    return _shapes(spark, d).select("id", text.alias("text"), shape.alias("shape"))


@query(f"""WITH {_SHAPES} SELECT id, CASE k WHEN 0 THEN '{{"file":{{"content":"new","numLines":1}}}}' WHEN 1 THEN '{{"content":"new","side":"s"}}' WHEN 2 THEN '{{"output":"new","text":7}}' WHEN 3 THEN '{{"text":"new"}}' WHEN 4 THEN '[{{"type":"text","text":"new"}}]' WHEN 7 THEN 'new' WHEN 8 THEN '"new"' END AS record FROM sh""")
def shape_write_back(spark, d):
    from skein.functions import jsontext

    text, shape = S.located_text()
    rows = P.settled(_shapes(spark, d).withColumn("shape", shape))
    return rows.select("id", jsontext.write_back(F.col("tool_response"), F.col("shape"), F.lit("new")).alias("record"))


# ---- shell results with every gate ----


@query(f"WITH {LOGS} SELECT id, ['skippedFailure', 'skippedFailure', 'skippedBelowThreshold', 'skippedImage', 'skippedBelowThreshold', 'skippedFailure', 'skippedPoorRatio'][id % 7 + 1] AS outcome FROM logs")
def shell_gates(spark, d):
    """Exit codes, failure records on either stream, images, short texts and texts with nothing to leave out."""
    k = F.col("id") % 7
    rows = A.logs(spark, d).select(
        "id", F.when(k == 5, "make").otherwise("npx eslint x").alias("command"),
        F.when(k.isin(2, 4), "short").when(k == 5, F.concat(F.repeat(F.lit("fine line\n"), 60), F.lit("fatal: x"))).when(k == 6, F.repeat(F.lit("one line, "), 70)).otherwise(F.concat("text", F.repeat(F.lit(" padding"), 100))).alias("stdout"),
        F.when(k == 1, "npm ERR! x").otherwise("").alias("stderr"), F.when(k == 0, 2).cast("int").alias("exit_code"), (k == 3).alias("is_image"),
    )
    return P.bash_results(rows).select("id", "outcome")


_SUMMARIES = f"""
  st AS (SELECT 'status' || n_nationkey AS id, '## main...origin/' || lower(n_name) || coalesce(chr(10) || files, '') AS text FROM nation LEFT JOIN (SELECT s_nationkey AS id, string_agg([' M', '??', 'A ', 'MM'][s_suppkey % 4 + 1] || ' src/s' || s_suppkey, chr(10) ORDER BY s_suppkey) AS files FROM supplier GROUP BY 1) f ON f.id = n_nationkey),
  pl AS (SELECT p_partkey % 25 AS id, p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'npm warn deprecated x' || (p_partkey % 3) WHEN p_partkey % 50 = 49 THEN 'added ' || p_partkey || ' packages in 2s' ELSE 'timing step ' || p_partkey END AS line, p_partkey % 4 = 0 AS sig FROM part),
  pk AS (SELECT 'pkg' || id AS id, string_agg(line, chr(10) ORDER BY key) || chr(10) || 'added 5 packages in 1s' AS text FROM pl GROUP BY pl.id),
  pd AS (SELECT id, line, min(key) AS k, count(*) AS n FROM pl WHERE sig GROUP BY id, line),
  pw AS (SELECT id, string_agg(line, chr(10) ORDER BY k) AS ws, string_agg('... [skein: ' || (n - 1) || ' duplicate package warnings omitted]', chr(10) ORDER BY k) FILTER (WHERE n > 1) AS ds FROM pd GROUP BY id),
  pc AS (SELECT id, count(*) FILTER (WHERE NOT sig) AS n FROM pl GROUP BY id),
  ps AS (SELECT pc.id, 'npm install: added 5 packages in 1s' || coalesce(chr(10) || ws, '') || coalesce(chr(10) || ds, '') || CASE WHEN n > 0 THEN chr(10) || '... [skein: ' || n || ' package-manager lines omitted]' ELSE '' END AS text FROM pc LEFT JOIN pw ON pc.id = pw.id),
  lt AS (SELECT 'lint' || (p_partkey % 20) AS id, string_agg(CASE WHEN p_partkey % 17 = 0 THEN 'nothing to see' ELSE 'src/a' || (p_partkey % 3) || '.ts(' || p_partkey || ',1): error TS' || (p_partkey % 2 + 1000) || ': message ' || (p_partkey % 5) END, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_partkey % 20),
  df AS (SELECT 'diff' || (o_custkey % 40) AS id, 'diff --git a/f' || (o_custkey % 40) || ' b/f' || (o_custkey % 40) || chr(10) || 'index 1..2 100644' || chr(10) || string_agg(CASE WHEN o_orderkey % 9 = 0 THEN '+added ' WHEN o_orderkey % 13 = 0 THEN '-removed ' ELSE ' context ' END || o_orderkey, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey % 40),
  tb AS (SELECT 'table' || r_regionkey AS id, 'NAME   STATUS    AGE' || string_agg(chr(10) || n_name || '   Running    ' || n_nationkey || 'd  ', '' ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey),
  sp AS (SELECT 'status' || id AS id, text AS small, 'gitStatus' AS rule FROM ({_ORACLES["git_status_counts"]}) UNION ALL SELECT 'pkg' || id, text, 'packageManagerSummary' FROM ps UNION ALL SELECT 'lint' || id, text, 'linterDiagnostics' FROM ({_ORACLES["linter_text"]})
    UNION ALL SELECT 'diff' || id, text, 'gitDiff' FROM ({_ORACLES["git_diff_context"]}) UNION ALL SELECT 'table' || id, text, 'kubectlTable' FROM ({_ORACLES["container_table"]})),
  al AS (SELECT * FROM st UNION ALL SELECT * FROM pk UNION ALL SELECT * FROM lt UNION ALL SELECT * FROM df UNION ALL SELECT * FROM tb),
  fm AS (SELECT al.id, al.text, small, rule, small || chr(10) || '[skein: ' || rule || ']' AS out FROM al JOIN sp ON al.id = sp.id WHERE small IS NOT NULL),
  oc AS (SELECT *, CASE WHEN length(text) < 500 THEN 'skippedBelowThreshold' WHEN strlen(out) * 10 > strlen(text) * 9 THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome FROM fm)"""


@query(f"""WITH {_SUMMARIES} SELECT id, CASE WHEN outcome = 'compressed' THEN out ELSE text END AS out_stdout, CASE WHEN outcome = 'compressed' THEN rule ELSE '' END AS rules, strlen(text) AS bytes_in, CASE WHEN outcome = 'compressed' THEN strlen(out) ELSE strlen(text) END AS bytes_out, outcome = 'compressed' AND small <> text AS lossy, outcome FROM oc""")
def bash_summaries(spark, d):
    """Shell results whose commands have a summary of their own, through all gates."""
    packages = A.package_text(spark, d).withColumn("text", F.concat("text", F.lit("\nadded 5 packages in 1s")))
    parts = [("status", "git status", A.status_text(spark, d)), ("pkg", "npm install", packages), ("lint", "npx tsc", R.joined(A.lint_rows(spark, d))), ("diff", "git diff", R.joined(A.diff_rows(spark, d))), ("table", "kubectl get pods", A.table_text(spark, d))]
    texts = [frame.select(_say(name, F.col("id")).alias("id"), F.lit(command).alias("command"), F.col("text").alias("stdout")) for name, command, frame in parts]
    rows = reduce(DataFrame.unionByName, texts).select("*", F.lit("").alias("stderr"), F.lit(None).cast("int").alias("exit_code"), F.lit(False).alias("is_image"))
    return P.bash_results(rows).select("id", "out_stdout", F.array_join("rules", ",").alias("rules"), "bytes_in", "bytes_out", "lossy", "outcome")


@query(f"""WITH {CHAIN}, m AS (SELECT id, text, CASE WHEN strlen(small) * 10 < strlen(text) THEN text ELSE small END AS kept FROM chained), r AS (SELECT *, kept || CASE WHEN kept <> text THEN chr(10) || '[skein: collapseRepeatedLines]' ELSE '' END AS out FROM m),
    o AS (SELECT *, CASE WHEN length(text) < 500 THEN 'skippedBelowThreshold' WHEN strlen(out) * 10 > strlen(text) * 9 THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome FROM r)
    SELECT id, CASE WHEN outcome = 'compressed' THEN out ELSE text END AS out_stdout, outcome, outcome = 'compressed' AND kept <> text AS lossy FROM o""")
def bash_logs(spark, d):
    """Shell results of commands without a summary: the generic chain, its near-empty guard, the rule marker and all gates."""
    rows = A.logs(spark, d).select("id", F.lit("node worker.js").alias("command"), F.col("text").alias("stdout"), F.lit("").alias("stderr"), F.lit(None).cast("int").alias("exit_code"), F.lit(False).alias("is_image"))
    return P.bash_results(rows).select("id", "out_stdout", "outcome", "lossy")


@query("""SELECT s_suppkey AS id, 'done ' || s_suppkey || chr(10) || '[skein: 3 progress lines omitted]' || chr(10) || '[skein: stripAnsi, stripProgressNoise]' AS out_stderr, repeat('plain words only', 3) AS out_stdout, 'compressed' AS outcome FROM supplier""")
def stderr_chain(spark, d):
    """Error streams keep their lines but for escapes and progress, builds included."""
    key = F.col("s_suppkey")
    err = _say("\x1b[31mCompiling a v", key, "\x1b[0m\n", "Building b\n", "Checking c", "\n", "done ", key)
    pad = F.concat(F.repeat(F.lit("\x1b[0m"), 400))
    rows = S.table(spark, d, "supplier").select(key.alias("id"), F.lit("make").alias("command"), F.repeat(F.lit("plain words only"), 3).alias("stdout"), F.concat(pad, err).alias("stderr"), F.lit(0).alias("exit_code"), F.lit(False).alias("is_image"))
    return P.bash_results(rows).select("id", "out_stderr", "out_stdout", "outcome")


# ---- commands ----

_ALL = ["npm ci", "pip install x", "cargo test", "pytest a", "git status", "docker build .", "gradle build", "npm install --verbose", "pytest -q", "mvn test", "git status -b", "cargo build -- x", "git log $(x)", "npm install --no-fund", "/usr/bin/git push 'https://a:b@c'", "npx -p x eslint a", "yarn run jest", "A=1 B=2 make all", "'unbalanced", "  "]
_SQL_ALL = "['" + "', '".join(c.replace("'", "''") for c in _ALL) + "']"
_CM = f"cm AS (SELECT c_custkey AS id, {_SQL_ALL}[c_custkey % {len(_ALL)} + 1] AS command FROM customer)"


def _all_commands(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("c_custkey") % len(_ALL) + 1).cast("int")
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.element_at(F.array(*map(F.lit, _ALL)), at).alias("command"))


@query(f"""WITH {_CM}, t(command, rewritten, rewrite_rule) AS (VALUES ('npm ci', 'npm ci --loglevel=error --no-fund --no-audit', 'npm-quiet'), ('pip install x', 'pip install x -q', 'pip-quiet'), ('cargo test', 'cargo test --quiet', 'cargo-quiet'), ('pytest a', 'pytest a -q', 'pytest-quiet'),
    ('git status', 'git status --porcelain=v1 -b', 'git-status-porcelain'), ('docker build .', 'docker build . --quiet', 'docker-build-quiet'), ('gradle build', 'gradle build -q', 'gradle-quiet'), ('git status -b', 'git status -b --porcelain=v1', 'git-status-porcelain'), ('npm install --no-fund', 'npm install --no-fund --loglevel=error --no-audit', 'npm-quiet'))
    SELECT cm.id, cm.command, t.rewritten, t.rewrite_rule FROM cm LEFT JOIN t ON cm.command = t.command""")
def rewrite_all_rules(spark, d):
    return described(_all_commands(spark, d), config=Config(rewrite=RewriteOptions(docker_build=True))).select("id", "command", "about.rewritten", "about.rewrite_rule")


@query(f"""WITH {_CM}, t(command, family) AS (VALUES ('pip install x', 'pip install'), ('cargo test', 'cargo test'), ('pytest a', 'pytest'), ('docker build .', 'docker build'), ('gradle build', 'gradle build'), ('npm install --verbose', 'npm install'), ('pytest -q', 'pytest'), ('git status -b', 'git status'), ('cargo build -- x', 'cargo build'), ('git log $(x)', 'git log'),
    ('npm install --no-fund', 'npm install'), ('/usr/bin/git push ''https://a:b@c''', 'git push'), ('npx -p x eslint a', 'npx'), ('yarn run jest', 'yarn run'), ('A=1 B=2 make all', 'make'), ('''unbalanced', '(unknown)'), ('  ', '(unknown)'))
    SELECT cm.id, coalesce(t.family, cm.command) AS family FROM cm LEFT JOIN t ON cm.command = t.command""")
def family_all_forms(spark, d):
    return described(_all_commands(spark, d)).select("id", "about.family")


@query(f"""WITH {_CM} SELECT id, CASE WHEN command IN ('git log $(x)', '''unbalanced', '  ') THEN NULL WHEN command LIKE 'npx%' THEN 'eslint' WHEN command LIKE 'yarn%' THEN 'jest' WHEN command LIKE 'A=1%' THEN 'make' WHEN command LIKE '/usr%' THEN 'git' ELSE string_split(command, ' ')[1] END AS binary FROM cm""")
def binary_all_forms(spark, d):
    return described(_all_commands(spark, d)).select("id", "about.binary")


@query(f"""WITH {_CM} SELECT id, '{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","permissionDecision":"allow","permissionDecisionReason":"gradle-quiet","updatedInput":{{"command":"gradle build -q"}}}}}}' AS record FROM cm WHERE command = 'gradle build'""")
def rewrite_records(spark, d):
    rows = described(_all_commands(spark, d)).where("about.rewrite_rule = 'gradle-quiet'")
    return rows.select("id", O.rewrite_record(F.lit("PreToolUse"), F.col("about.rewritten"), F.col("about.rewrite_rule")).alias("record"))


# ---- command outputs ----


@query("SELECT n_nationkey AS id, 'ok git pull:' || chr(10) || 'Updating ' || n_name || chr(10) || 'Fast-forward' AS text, 'gitOperation' AS rule FROM nation")
def git_pull_text(spark, d):
    about = F.struct(F.array(F.lit("git"), F.lit("pull")).alias("tokens"), F.lit("git").alias("binary"), F.lit("pull").alias("subcommand"))
    out = C.git(_say("Updating ", F.col("n_name"), "\r\nFast-forward\n\n"), about)
    return S.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), out["text"].alias("text"), out["rule"].alias("rule"))


_LINT = """li AS (SELECT p_partkey % 15 AS id, p_partkey AS pos, p_partkey // 15 % 4 AS f, p_partkey % 3 AS form FROM part),
  hd AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY id ORDER BY pos) <> f, true) AS new FROM li),
  ln AS (SELECT id, pos * 2 AS pos, 'src/dir' || f || '/a.js' AS file, CASE WHEN form = 0 THEN '  ' || pos || ':1  warning  message ' || (pos % 2) || '  rule-' || (pos % 2) ELSE 'lib/b' || (pos % 2) || '.py:' || pos || ':7: E' || (pos % 2 + 500) || ' line ' || (pos % 2) END AS line,
    CASE WHEN form = 0 THEN 'src/dir' || f || '/a.js' ELSE 'lib/b' || (pos % 2) || '.py' END AS owner, CASE WHEN form = 0 THEN 'rule-' || (pos % 2) ELSE 'E' || (pos % 2 + 500) END AS rule, CASE WHEN form = 0 THEN 'message ' || (pos % 2) ELSE 'line ' || (pos % 2) END AS message FROM hd)"""


def _lint_forms(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    key = F.col("p_partkey")
    rows = p.select((key % 15).alias("id"), key.alias("key"), (F.floor(key / 15) % 4).alias("f"), (key % 3).alias("form"))
    key, even = F.col("key"), F.col("key") % 2
    line = F.when(F.col("form") == 0, _say("  ", key, ":1  warning  message ", even, "  rule-", even)).otherwise(_say("lib/b", even, ".py:", key, ":7: E", even + 500, " line ", even))
    return rows.select("id", F.explode(F.array(F.struct((key * 2 - 1).alias("pos"), _say("src/dir", F.col("f"), "/a.js").alias("line")), F.struct((key * 2).alias("pos"), line.alias("line")))).alias("x")).select("id", "x.pos", "x.line")


@query(f"""WITH {_LINT} SELECT id, pos, file, rule, line, row_number() OVER k AS nth, count(*) OVER (PARTITION BY id, owner, rule, message) AS total FROM ln WINDOW k AS (PARTITION BY id, owner, rule, message ORDER BY pos)""")
def lint_forms(spark, d):
    return R.lint_dedup(_lint_forms(spark, d)).select("id", "pos", "file", "rule", "line", "nth", "total")


@query(f"""WITH {_LINT}, n AS (SELECT *, row_number() OVER (PARTITION BY id, owner, rule, message ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id, owner, rule, message) AS total, first_value(file) OVER (PARTITION BY id, owner, rule, message ORDER BY pos) AS top, min(pos) OVER (PARTITION BY id, owner, rule, message) AS first FROM ln),
    s AS (SELECT *, coalesce(lag(file) OVER (PARTITION BY id ORDER BY pos) <> file, true) AS new FROM n WHERE nth <= 3),
    p AS (SELECT id, 0 AS part, pos, CASE WHEN new THEN file || chr(10) ELSE '' END || line AS line FROM s
      UNION ALL SELECT id, 1, first, '... [skein: ' || (total - 3) || ' identical diagnostics omitted for ' || top || ' (' || rule || ')]' FROM n WHERE nth = 1 AND total > 3)
    SELECT id, string_agg(line, chr(10) ORDER BY part, pos) AS text FROM p GROUP BY id""")
def lint_forms_text(spark, d):
    from skein.functions import folds

    text = R.joined(_lint_forms(spark, d))
    return text.select("id", folds.text_udf(folds.lint_summary)(F.col("text")).alias("text"))


@query("SELECT r_regionkey AS id, 'REPOSITORY | TAG | SIZE' || string_agg(chr(10) || lower(n_name) || ' | v' || n_nationkey || ' | 1 MB', '' ORDER BY n_nationkey) AS text, 'dockerTable' AS rule FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def docker_table(spark, d):
    n = S.table(spark, d, "nation")
    rows = n.select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").cast("long").alias("pos"), _say(F.lower("n_name"), "     v", F.col("n_nationkey"), "   1 MB").alias("line"))
    heads = S.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(-1).cast("long").alias("pos"), F.lit("REPOSITORY   TAG    SIZE  ").alias("line"))
    about = F.struct(F.array(F.lit("docker"), F.lit("images")).alias("tokens"), F.lit("docker").alias("binary"), F.lit("images").alias("subcommand"))
    out = C.containers(F.col("text"), about)
    return A.lines_text(rows.unionByName(heads), "pos").select("id", out["text"].alias("text"), out["rule"].alias("rule"))


# ---- transcripts, sessions, files ----


@query("""WITH t AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN DATE '2024-01-30' - conv_id::INT % 61 ELSE NULL END AS day FROM conversations WHERE role <> 'user' AND turn > 0)
    SELECT 'conv' || conv_id AS file, turn AS line_no FROM t WHERE day IS NULL OR day::TIMESTAMP + INTERVAL 12 HOUR >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 DAY""")
def transcript_recent(spark, d):
    """Stamps that are missing, readable or unreadable."""
    c = S.table(spark, d, "conversations")
    day = F.date_sub(F.lit(dt.date(2024, 1, 30)), (F.col("conv_id") % 61).cast("int"))
    stamp = F.when(F.col("conv_id") % 3 == 1, F.concat(day.cast("string"), F.lit("T12:00:00.000Z"))).when(F.col("conv_id") % 3 == 2, F.lit("some day"))
    raw = F.to_json(F.struct(stamp.alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), _say("u", F.col("turn")).alias("tool_use_id"), F.col("text").alias("content"))).alias("content")).alias("message")))
    rows = c.where("role <> 'user' and turn > 0").select(_say("conv", F.col("conv_id")).alias("file"), F.col("turn").cast("long").alias("line_no"), raw.alias("raw"))
    return X.recent(X.tool_blocks(rows), dt.datetime(2024, 1, 30)).select("file", "line_no")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE role = 'user') AS uses FROM conversations WHERE conv_id % 5 = 3")
def transcript_files(spark, d):
    """Lines of JSONL files under a folder, of one project only."""
    base = S.scratch(spark, "transcripts")
    lines = A.transcripts(spark, d).select(_say("-home-me-p", F.substring("file", 5, 20).cast("long") % 5).alias("project"), "file", "line_no", F.col("raw").alias("value"))
    for part in range(5):
        lines.where(F.col("project") == f"-home-me-p{part}").repartition(4, "file").sortWithinPartitions("file", "line_no").select("value").write.text(f"{base}/-home-me-p{part}", lineSep="\n")
    _rename_jsonl(spark, base)
    found = S.transcript_lines(spark, base, "/home/me/p3")
    uses = F.col("raw").contains("tool_use\",")
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(uses).alias("uses"))


def _rename_jsonl(spark: SparkSession, base: str) -> None:
    """Gives the text files of a folder the ending of transcripts."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in files.listStatus(path(base)):
        for f in files.listStatus(folder.getPath()):
            name = f.getPath().getName()
            if name.startswith("part-"):
                files.rename(f.getPath(), path(folder.getPath(), name.replace(".txt", ".jsonl")))


@query("SELECT event_type AS tool, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY event_type")
def event_source(spark, d):
    """JSON lines of events; a tenth of them broken."""
    base = S.scratch(spark, "events")
    e = S.table(spark, d, "events")
    good = F.to_json(F.struct(F.lit("PostToolUse").alias("hook_event_name"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), F.col("event_id").alias("seq")))
    e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), good)).otherwise(good).alias("value")).write.text(base)
    return S.tool_events(spark, base).groupBy(F.col("tool_name").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'a b/' || n_nationkey || '.c~!(x)' AS id, 'a-b-' || n_nationkey || '-c---x-' AS slug, 's%2E' || n_nationkey || '/a%20b%2F' || n_nationkey || '%2Ec~!(x).log' AS path, 'ab' || n_nationkey || 'cx' AS session FROM nation")
def names_and_paths(spark, d):
    key = F.col("n_nationkey")
    name = _say("a b/", key, ".c~!(x)")
    return S.table(spark, d, "nation").select(name.alias("id"), T.project_slug(name).alias("slug"), L.recovery_path(_say("s.", key), name).alias("path"), T.session_id(name).alias("session"))


@query("SELECT n_nationkey AS path, true AS capped, n_nationkey % 5 + 2 AS n_lines FROM nation")
def read_guard_capped(spark, d):
    """Files of over 5 MiB whose cut falls inside a character."""
    key = F.col("n_nationkey")
    text = F.concat(F.lit("x"), F.repeat(F.lit("\n"), (key % 5 + 1).cast("int")), F.repeat(F.lit("é"), 2621440), F.repeat(F.lit("\n"), 50))
    return D.read_guard(S.table(spark, d, "nation").select(key.alias("path"), text.alias("text")), Config(read_guard_lines=1)).select("path", "capped", "n_lines")


# ---- ledger, streams, reports ----


@query(f"WITH {HISTORY} SELECT day::VARCHAR AS day, dim, key, events * 2 AS events, bytes_in * 2 AS bytes_in, bytes_out * 2 AS bytes_out FROM hi")
def ledger_stream_merge(spark, d):
    """Two batches, one of them written twice, folded into a base and added to."""
    ledger = LedgerMerge(spark, S.scratch(spark, "ledger"))
    rows = L.marginals(A.facts(spark, d))
    ledger.write(rows, 0)
    ledger.write(rows, 0)
    ledger.compact()
    ledger.write(rows, 1)
    return ledger.read().withColumn("day", F.col("day").cast("string"))


@query(f"WITH {HISTORY} SELECT * REPLACE (day::VARCHAR AS day) FROM hi")
def ledger_stream_once(spark, d):
    """A stream in which every event is delivered twice, into the history; a replay of all days, so any of them may come late."""
    base = S.scratch(spark, "deliveries")
    facts = A.facts(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        facts.write.mode("append").parquet(f"{base}/in")
    days = facts.agg(F.date_diff(F.max("ts"), F.min("ts"))).first()[0] or 0
    history = History(spark, f"{base}/history")
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    ledger_stream(stream, history, f"{base}/checkpoint", f"{days + 1} days").awaitTermination()
    return history.read().withColumn("day", F.col("day").cast("string"))


@query(f"WITH {HISTORY}, r AS (SELECT 1 AS version, * FROM hi UNION ALL SELECT 3, * REPLACE (events * 2 AS events, bytes_in * 2 AS bytes_in, bytes_out * 2 AS bytes_out) FROM hi WHERE day >= DATE '2024-01-20') SELECT version, day::VARCHAR AS day, dim, key, events, bytes_in, bytes_out FROM r")
def history_versions(spark, d):
    """What two readers of the history see, of which one began before its days were added to again and compacted."""
    history = History(spark, S.scratch(spark, "history"))
    rows = L.marginals(A.facts(spark, d))
    history.add(rows)
    before = history.read().withColumn("version", F.lit(1))
    history.add(rows)
    history.compact(dt.date(2024, 1, 20) + dt.timedelta(days=K.RETENTION_DAYS - 1))
    now = history.read().withColumn("version", F.lit(max(history.versions())))
    return before.unionByName(now).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {FACTS}, r AS (SELECT session_id, 'u' || event_id AS use_id, event_id AS seq, event_id % 3 * 4096 AS size, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS nth FROM fa WHERE event_id % 5 <> 0 AND event_id % 3 > 0)
    SELECT session_id, use_id, seq, session_id || '/' || use_id || '.log' AS path, size::INT AS size FROM r WHERE nth <= 4""")
def recovery_store(spark, d):
    """Originals kept on disk in two additions, the oldest of a session dropped beyond four."""
    f = A.facts(spark, d)
    r = f.select("session_id", _say("u", F.col("event_id")).alias("use_id"), F.col("event_id").alias("seq"), F.repeat(F.lit("x"), (F.col("event_id") % 3 * 4096).cast("int")).alias("original"), (F.col("event_id") % 5 != 0).alias("lossy"), F.lit(False).alias("failed"))
    store = RecoveryStore(spark, S.scratch(spark, "recovery"), TeeOptions(max_files=4))
    for half in (1, 0):
        store.add(r.where(F.col("seq") % 2 == half))
    return store.read().select("session_id", "use_id", "seq", "path", F.octet_length("original").alias("size"))


def _session_stream(spark, d, base):
    """Reads of every second session streamed whole; of the others the first half gives, in batch, the state that the rest is streamed from."""
    events = A.reads(spark, d).withColumn("early", (F.floor(F.col("seq") / 50) % 2 == 1) & (F.col("seq") % 50 < 25))
    rest = events.where("not early").drop("early")
    rest.write.parquet(f"{base}/in")
    early = events.where("early").drop("early")
    stream = session_reads(spark.readStream.schema(rest.schema).parquet(f"{base}/in"), seed=last_set(early))
    session_reads_to_table(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return early


@query(f"WITH {READS} SELECT session_id, path, seq, op, hit, source, coalesce(header_lines, 0) AS header_lines FROM rj")
def read_cache_sessions(spark, d):
    """The read cache as a map of paths for each session, seeded in batch for every second one."""
    base = S.scratch(spark, "sessions")
    early = D.read_cache(_session_stream(spark, d, base))
    columns = ["session_id", "path", "seq", "op", "hit", "source", "header_lines"]
    return early.select(columns).unionByName(spark.read.parquet(f"{base}/out").select(columns)).withColumn("header_lines", F.coalesce("header_lines", F.lit(0)))


@query(f"WITH {READS} SELECT session_id, path, arg_max(hash, seq) AS hash, arg_max(n_lines, seq)::INT AS header_lines, arg_max(op, seq) AS source FROM rj WHERE touches AND NOT hit GROUP BY session_id, path")
def session_state_table(spark, d):
    """What the stream of sessions holds at its end, read from its checkpoint."""
    base = S.scratch(spark, "sessions")
    _session_stream(spark, d, base)
    return held_state(spark, f"{base}/checkpoint")


@query(f"WITH {FACTS} SELECT day::VARCHAR AS day, tool, count(*) AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out FROM fa GROUP BY day, tool")
def daily_window_stream(spark, d):
    base = S.scratch(spark, "days")
    A.facts(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "tool", "bytes_in", "bytes_out").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    windows_to_table(daily_windows(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return latest_windows(spark, f"{base}/out").withColumn("day", F.col("day").cast("string"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '{"stdout":"out ' || s_suppkey || '","stderr":"err","interrupted":false,"isImage":false}' END AS structured, CASE WHEN s_suppkey % 2 = 0 THEN '{"stopReason":"output was reduced","additionalContext":"out ' || s_suppkey || '\\nerr"}' END AS context FROM supplier""")
def replacement_records(spark, d):
    key = F.col("s_suppkey")
    rows = S.table(spark, d, "supplier").select(key.alias("id"), _say("out ", key).alias("out_stdout"), F.lit("err").alias("out_stderr"), F.when(key % 2 == 0, "compressed").otherwise("skippedFailure").alias("outcome"), F.lit(None).cast("boolean").alias("interrupted"), F.lit(False).alias("is_image"))
    one, two = S.replacement(rows).withColumnRenamed("record", "structured"), S.replacement(rows, "context").withColumnRenamed("record", "context")
    return one.join(two, "id")


@query("""SELECT '| ' || replace(replace(r_name, chr(92), chr(92) || chr(92)), '|', chr(92) || '|') || ' | a' || chr(92) || '|b c | ' || r_regionkey || ' |' AS line FROM region""")
def markdown_table(spark, d):
    return O.markdown_rows(S.table(spark, d, "region").select("r_name", F.lit("a|b\nc").alias("x"), "r_regionkey"))


@query("""SELECT n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN n_name || chr(10) || '[skein: full: /kept/' || n_nationkey || ']' ELSE n_name || chr(10) END AS shown FROM nation""")
def recovery_lines(spark, d):
    path = F.when(F.col("n_nationkey") % 2 == 0, _say("/kept/", F.col("n_nationkey")))
    return S.table(spark, d, "nation").select(F.col("n_name").alias("text"), O.with_recovery(_say(F.col("n_name"), "\n"), path).alias("shown"))


@query("""SELECT p_partkey::VARCHAR AS name, p_size::BIGINT + 1000 AS bytes_in, floor((p_size + 1000 - 400) / (p_size + 1000) * 100 * 10 + 0.5) / 10 AS percent, CASE WHEN p_partkey % 3 = 0 THEN floor((p_size + 1000 - 900) / (p_size + 1000) * 100 * 10 + 0.5) / 10 END AS whole_percent, 'r' AS rules FROM part""")
def ratio_report(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_partkey", (F.col("p_size").cast("long") + 1000).alias("bytes_in"))
    plain = p.select("name", "bytes_in", F.lit(400).alias("bytes_out"), F.lit("r").alias("rules"))
    return O.ratio_report(plain, p.where("p_partkey % 3 = 0").select("name", "bytes_in", F.lit(900).alias("bytes_out")))


@query("SELECT DISTINCT 'script' || (s_suppkey % 40) AS script FROM supplier WHERE s_suppkey % 40 >= 25")
def missing_wiring(spark, d):
    wired = S.table(spark, d, "supplier").select(_say("script", F.col("s_suppkey") % 40).alias("script"))
    return O.missing_scripts(wired, S.table(spark, d, "nation").select(_say("script", F.col("n_nationkey")).alias("script")))


@query(f"""WITH {FACTS}, c AS (SELECT tool, project AS event, CASE WHEN bytes_out > bytes_in THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome, count(*) AS n FROM fa GROUP BY ALL UNION ALL SELECT tool, project, 'attempted', count(*) FROM fa GROUP BY ALL)
    SELECT tool, event, '  ' || rpad(tool, greatest(6, length(tool))::INT, ' ') || ' ' || rpad(event, 18, ' ') || ' ' || string_agg(outcome || ' ' || n, ', ' ORDER BY outcome) AS line FROM c GROUP BY tool, event ORDER BY tool, event""")
def diagnostics_lines(spark, d):
    e = A.facts(spark, d).select("tool", F.col("project").alias("event"), F.when(F.col("bytes_out") > F.col("bytes_in"), "skippedPoorRatio").otherwise("compressed").alias("outcome"))
    return L.diagnostics_listing(L.diagnostics(e))


@query(f"""WITH {FACTS}, t AS (SELECT tool, sum(events)::BIGINT AS n, sum(bytes_in)::BIGINT AS i, sum(bytes_out)::BIGINT AS o FROM fa GROUP BY tool),
    z AS (SELECT *, row_number() OVER (ORDER BY i - o DESC, tool) AS pos FROM t), s AS (SELECT sum(i) AS i, sum(o) AS o, greatest(0, floor(sum(i - o) / 3 + 0.5))::BIGINT AS tok FROM t)
    SELECT 0 AS part, 0::BIGINT AS pos, 'skein savings (all):' AS line UNION ALL
    SELECT 1, pos, '  ' || rpad(tool, greatest(12, length(tool))::INT, ' ') || ' ' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, ' ') || ' calls  ' || CASE WHEN i >= 1048576 THEN printf('%.1fMB', i / 1048576) WHEN i >= 1024 THEN printf('%.1fKB', i / 1024) ELSE i || 'B' END || ' -> ' || CASE WHEN o >= 1048576 THEN printf('%.1fMB', o / 1048576) WHEN o >= 1024 THEN printf('%.1fKB', o / 1024) ELSE o || 'B' END || '  (' || floor((i - o) / i * 100 + 0.5)::BIGINT || '% smaller)' FROM z UNION ALL
    SELECT 2, 0, '  total  ' || CASE WHEN i >= 1048576 THEN printf('%.1fMB', i / 1048576) WHEN i >= 1024 THEN printf('%.1fKB', i / 1024) ELSE i || 'B' END || ' -> ' || CASE WHEN o >= 1048576 THEN printf('%.1fMB', o / 1048576) WHEN o >= 1024 THEN printf('%.1fKB', o / 1024) ELSE o || 'B' END || ' | ~' || format('{{:,}}', tok) || ' tokens saved' FROM s""")
def savings_text(spark, d):
    return O.savings_text(L.by_tool(A.facts(spark, d)), "savings (all)")


@query("""WITH t AS (SELECT 'Name' AS a, 'Size' AS b UNION ALL SELECT n_name, n_nationkey::VARCHAR FROM nation), w AS (SELECT max(length(a)) AS x, max(length(b)) AS y FROM t)
    SELECT rtrim(rpad(a, x::INT, ' ') || '  ' || lpad(b, y::INT, ' ')) AS line FROM t, w""")
def padded_table(spark, d):
    return O.padded_rows(S.table(spark, d, "nation").select(F.col("n_name").alias("Name"), F.col("n_nationkey").alias("Size")), right=("Size",))


@query(f"WITH {FACTS} SELECT tool, sum(events)::BIGINT AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(bytes_in - bytes_out)::BIGINT AS bytes_saved FROM fa WHERE session_id = 's1' GROUP BY tool")
def named_ledger(spark, d):
    return L.by_tool(L.named_session(A.facts(spark, d), "../s 1!"))


@query(f"{_GREP_OUT} SELECT 'Grep' AS tool, count(*) AS events, sum(length(text))::BIGINT AS bytes_in, sum(length(small))::BIGINT AS bytes_out, sum(length(text) - length(small))::BIGINT AS bytes_saved FROM o WHERE outcome = 'compressed'")
def ledger_of_results(spark, d):
    """Outcomes of events as facts of the ledger."""
    done = tools.grep_results(_grep_events(spark, d)).where("outcome = 'compressed'")
    return L.by_tool(done.select(F.col("bucket").alias("tool"), F.lit(1).cast("long").alias("events"), F.col("size_in").alias("bytes_in"), F.col("size_out").alias("bytes_out")))


@query(f"{_GREP_OUT} SELECT 'Grep' AS tool, 'PostToolUse' AS event, outcome, count(*) AS n FROM (SELECT outcome FROM o UNION ALL SELECT 'attempted' FROM o) GROUP BY outcome")
def outcomes_of_results(spark, d):
    return L.diagnostics(tools.grep_results(_grep_events(spark, d)).select(F.lit("Grep").alias("tool"), F.lit("PostToolUse").alias("event"), "outcome"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'structured' WHEN 1 THEN 'context' WHEN 2 THEN 'context' WHEN 3 THEN 'structured' ELSE 'structured' END AS target, CASE WHEN s_suppkey % 5 IN (1, 2, 3, 4) THEN 'context' ELSE 'structured' END AS by_home FROM supplier")
def runtime_targets(spark, d):
    k = F.col("s_suppkey") % 5
    forced, turn = F.when(k == 0, "structured").when(k == 1, "context").when(k == 3, "nonsense"), F.when(k.isin(0, 2), "t1").when(k == 4, "")
    rows = S.table(spark, d, "supplier")
    return rows.select(F.col("s_suppkey").alias("id"), O.target(forced, turn, {}).alias("target"), O.target(forced, turn, {"context_home": "x"}).alias("by_home"))


@query("SELECT arg_max(doc_id, (strlen(text), doc_id::VARCHAR))::VARCHAR AS name FROM documents")
def largest_text(spark, d):
    return O.largest(S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "text"))


@query("""SELECT n_name AS id, '{"hookSpecificOutput":{"hookEventName":"PreToolUse","additionalContext":"' || n_name || ' is long"}}' AS record FROM nation""")
def advice_records(spark, d):
    return S.table(spark, d, "nation").select(F.col("n_name").alias("id"), O.advice_record(F.lit("PreToolUse"), _say(F.col("n_name"), " is long")).alias("record"))


@query("SELECT n_nationkey AS id, NULL::VARCHAR AS text FROM nation")
def git_without_summary(spark, d):
    """What git says of a push, fetch, add or commit is short and stays."""
    sub = F.element_at(F.array(*map(F.lit, K.QUIET_GIT)), (F.col("n_nationkey") % len(K.QUIET_GIT) + 1).cast("int"))
    about = F.struct(F.array(F.lit("git"), sub).alias("tokens"), F.lit("git").alias("binary"), sub.alias("subcommand"))
    return S.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), C.git(_say("## done ", F.col("n_name")), about)["text"].alias("text"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'keep ' || c_custkey WHEN 1 THEN '' WHEN 2 THEN 'skip all' END AS text, CASE c_custkey % 4 WHEN 0 THEN 'custom:first' WHEN 1 THEN 'custom:second' WHEN 2 THEN 'custom:third' END AS rule FROM customer""")
def filters_in_order(spark, d):
    """The first filter that takes a command decides, its empty result included."""
    config = Config(filters=(
        Filter("^make a", "first", strip_ansi=True, strip_lines_matching="^skip", max_lines=1), Filter("^make", "second", strip_lines_matching=".", on_empty="drop"), Filter("(a+)+", "never"),
        Filter("^npm", "third", strip_lines_matching=".", on_empty="keep"), Filter("^pip", "fourth", strip_lines_matching="."),
    ))
    key = F.col("c_custkey")
    command = F.element_at(F.array(*map(F.lit, ("make all", "make x", "npm x", "pip x"))), (key % 4 + 1).cast("int"))
    text = F.when(key % 4 == 0, _say("\x1b[1mkeep ", key, "\x1b[0m\nskip this\nmore")).otherwise("skip all")
    made, _ = C.custom(text, command, config)
    return S.table(spark, d, "customer").select(key.alias("id"), made["text"].alias("text"), made["rule"].alias("rule"))


#: Shell results of all commands of ``adapters.shell_results``: each family with its own summary, or the chain written as islands of lines.
BASH = f"""WITH {CHAIN}, {RUNNER}, {FAILING},
  st AS (SELECT 'status' || n_nationkey AS id, '## main...origin/' || lower(n_name) || coalesce(chr(10) || files, '') AS text FROM nation LEFT JOIN (SELECT s_nationkey AS id, string_agg([' M', '??', 'A ', 'MM'][s_suppkey % 4 + 1] || ' src/s' || s_suppkey, chr(10) ORDER BY s_suppkey) AS files FROM supplier GROUP BY 1) f ON f.id = n_nationkey),
  pk AS (SELECT 'pkg' || (key % 25) AS id, string_agg(CASE WHEN key % 4 = 0 THEN 'npm warn deprecated x' || (key % 3) WHEN key % 50 = 49 THEN 'added ' || key || ' packages in 2s' ELSE 'timing step ' || key END, chr(10) ORDER BY key) AS text FROM p GROUP BY key % 25),
  lt AS (SELECT 'lint' || (key % 20) AS id, string_agg(CASE WHEN key % 17 = 0 THEN 'nothing to see' ELSE 'src/a' || (key % 3) || '.ts(' || key || ',1): error TS' || (key % 2 + 1000) || ': message ' || (key % 5) END, chr(10) ORDER BY key) AS text FROM p GROUP BY key % 20),
  df AS (SELECT 'diff' || (o_custkey % 40) AS id, 'diff --git a/f' || (o_custkey % 40) || ' b/f' || (o_custkey % 40) || chr(10) || 'index 1..2 100644' || chr(10) || string_agg(CASE WHEN o_orderkey % 9 = 0 THEN '+added ' WHEN o_orderkey % 13 = 0 THEN '-removed ' ELSE ' context ' END || o_orderkey, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey % 40),
  tb AS (SELECT 'table' || r_regionkey AS id, 'NAME   STATUS    AGE' || string_agg(chr(10) || n_name || '   Running    ' || n_nationkey || 'd  ', '' ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey),
  te AS (SELECT *, row_number() OVER (PARTITION BY id, skip, CASE WHEN skip THEN k % 2 END ORDER BY ts, event_id) AS nth_e, count(*) OVER (PARTITION BY id, skip, CASE WHEN skip THEN k % 2 END) AS total_e,
    'Traceback (most recent call last):' || chr(10) || '  File "a' || (k % 2) || '.py", line 3' || chr(10) || '    run()' AS head, chr(10) || 'ValueError: bad ' || (k % 2) AS tail FROM cl),
  tp AS (SELECT *, CASE WHEN skip THEN head || chr(10) || '  File "a' || (k % 2) || '.py", line 3' || chr(10) || '    run()' || tail ELSE line END AS whole,
    CASE WHEN skip AND nth_e = 1 THEN head || chr(10) || '[skein: 2 repeated frames]' || tail || CASE WHEN total_e > 1 THEN chr(10) || '[skein: stack trace repeated ' || total_e || ' times]' ELSE '' END WHEN skip THEN NULL WHEN n < 4 OR nth = 1 THEN line WHEN nth = 2 THEN '[skein: ' || (n - 1) || ' more similar lines collapsed]' END AS piece FROM te),
  tt AS (SELECT 'trace' || id AS id, string_agg(whole, chr(10) ORDER BY ts, event_id) AS text, string_agg(piece, chr(10) ORDER BY ts, event_id) AS small, bool_or(NOT skip AND n >= 4) AS c, bool_or(skip) AS t FROM tp GROUP BY id),
  tr AS (SELECT id, text, strlen(small) * 10 < strlen(text) AS restored, small, CASE WHEN c AND t THEN 'collapseRepeatedLines,dedupStackTraces' WHEN c THEN 'collapseRepeatedLines' WHEN t THEN 'dedupStackTraces' ELSE '' END AS rules FROM tt),
  fx AS (SELECT 'fail' || id AS id, string_agg(line, chr(10) ORDER BY key) AS text, bool_or(line LIKE 'FAIL %' OR line LIKE 'Tests  1 failed%') AS bad FROM fl GROUP BY fl.id),
  sp AS (SELECT 'status' || id AS id, text AS small, 'gitStatus' AS rule FROM ({_ORACLES["git_status_counts"]}) UNION ALL SELECT 'pkg' || id, text, 'packageManagerSummary' FROM ({_ORACLES["package_summary"]}) UNION ALL SELECT 'lint' || id, text, 'linterDiagnostics' FROM ({_ORACLES["linter_text"]})
    UNION ALL SELECT 'diff' || id, text, 'gitDiff' FROM ({_ORACLES["git_diff_context"]}) UNION ALL SELECT 'table' || id, text, 'kubectlTable' FROM ({_ORACLES["container_table"]}) UNION ALL SELECT 'run' || id, text, 'testRunnerSummary' FROM ({_ORACLES["runner_summary"]})),
  al AS (SELECT id, text, text AS kept, '' AS rules, false AS bad FROM (SELECT * FROM st UNION ALL SELECT * FROM pk UNION ALL SELECT * FROM lt UNION ALL SELECT * FROM df UNION ALL SELECT * FROM tb UNION ALL SELECT 'run' || id, text FROM rx)
    UNION ALL SELECT id, text, text, '', bad FROM fx UNION ALL SELECT id, text, CASE WHEN restored THEN text ELSE small END, CASE WHEN restored THEN '' ELSE rules END, false FROM tr
    UNION ALL SELECT 'log' || id, text, CASE WHEN strlen(small) * 10 < strlen(text) THEN text ELSE small END, CASE WHEN small <> text AND strlen(small) * 10 >= strlen(text) THEN 'collapseRepeatedLines' ELSE '' END, false FROM chained),
  fm AS (SELECT al.id, al.text, bad, coalesce(sp.small, kept) AS small, CASE WHEN sp.small IS NOT NULL THEN rule ELSE rules END AS rules FROM al LEFT JOIN sp ON al.id = sp.id),
  ou AS (SELECT *, small || CASE WHEN rules <> '' THEN chr(10) || '[skein: ' || replace(rules, ',', ', ') || ']' ELSE '' END AS out FROM fm),
  oc AS (SELECT *, CASE WHEN length(text) < 500 THEN 'skippedBelowThreshold' WHEN bad THEN 'skippedFailure' WHEN strlen(out) * 10 > strlen(text) * 9 THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome FROM ou)
  SELECT id, CASE WHEN outcome = 'compressed' THEN out ELSE text END AS out_stdout, CASE WHEN outcome = 'compressed' THEN rules ELSE '' END AS rules, strlen(text) AS bytes_in, CASE WHEN outcome = 'compressed' THEN strlen(out) ELSE strlen(text) END AS bytes_out, outcome = 'compressed' AND small <> text AS lossy, outcome FROM oc"""
ORACLES["bash_end_to_end"] = BASH
