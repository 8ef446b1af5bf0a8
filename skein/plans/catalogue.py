"""All queries of the engine over the test tables, by name, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import Config, Filter, RewriteOptions
from skein.functions import fixed as K
from skein.functions import folds, jsontext
from skein.functions import text as T
from skein.functions.commands import described
from skein.operators import compressors as C
from skein.operators import ledger as L
from skein.operators import lines as R
from skein.operators import pipeline as P
from skein.operators import reads as D
from skein.operators import segments as G
from skein.operators import transcripts as X
from skein.plans import adapters as A
from skein.plans import tool_queries
from skein.plans.oracles import ORACLES as _ORACLES
from skein.sources.files import file_blocks
from skein.sources.tables import scratch, table
from skein.streaming.state import read_cache_stream, run_to_table

__all__ = ["ORACLES", "QUERIES"]

AS_OF = dt.date(2024, 1, 30)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(tool_queries.QUERIES)
ORACLES: dict[str, str] = {**_ORACLES, **tool_queries.ORACLES}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


# ---- documents: lines, dedup, gates ----


@query
def doc_line_scan(spark, d):
    return R.explode_lines(docs(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("pos").alias("last_pos"))


@query
def doc_nonblank_lines(spark, d):
    return docs(spark, d).select("id", F.size(T.solid_lines(F.col("text"))).alias("n_solid"))


@query
def doc_exact_dedup(spark, d):
    rows = R.first_occurrences(R.explode_lines(docs(spark, d)))
    return R.joined(rows.where("kept"))


def _savings(spark, d):
    out = F.array_join(R.dedup_lines(T.lines(F.col("text"))), "\n")
    df = docs(spark, d).withColumn("out", out)
    return df.select("id", "source", F.octet_length("text").cast("long").alias("bytes_in"), F.octet_length("out").cast("long").alias("bytes_out"), P.size_gate(F.col("text")).alias("big"))


def _outcomes(spark, d):
    outcome = F.when(~F.col("big"), "skippedBelowThreshold").when(T.poor_ratio(F.col("bytes_in"), F.col("bytes_out")), "skippedPoorRatio").otherwise("compressed")
    return _savings(spark, d).withColumn("outcome", outcome)


@query
def doc_dedup_savings(spark, d):
    return _outcomes(spark, d).select("id", "bytes_in", "bytes_out", "outcome")


@query
def savings_by_source_top(spark, d):
    ok = _outcomes(spark, d).where("outcome = 'compressed'")
    return ok.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")).withColumn("bytes_saved", L.saved()).orderBy(F.desc("bytes_saved"), "source").limit(10)


@query
def size_gate(spark, d):
    return docs(spark, d).where(P.size_gate(F.col("text"))).select("id", T.units(F.col("text")).alias("units"))


@query
def ratio_gate(spark, d):
    return _savings(spark, d).where(~T.poor_ratio(F.col("bytes_in"), F.col("bytes_out"))).select("id", T.reduction_percent(F.col("bytes_in"), F.col("bytes_out")).alias("percent"))


@query
def outcome_counts(spark, d):
    return L.diagnostics(_outcomes(spark, d).select(F.lit("Doc").alias("tool"), F.lit("scan").alias("event"), "outcome"))


@query
def dup_document_reads(spark, d):
    reads = docs(spark, d).select(F.col("lang").alias("session_id"), F.col("source").alias("path"), F.col("id").alias("seq"), F.lit("Read").alias("op"), F.lit(False).alias("bounded"), F.lit(False).alias("failed"), F.coalesce("text", F.lit("")).alias("content"))
    return D.read_cache(reads, Config(min_chars=0)).select("session_id", "path", "seq", "hit", F.substring("hash", 1, 12).alias("hash12"))


@query
def head_tail_truncate(spark, d):
    return docs(spark, d).select("id", T.head_tail(F.col("text"), 800, 3, 4).alias("text"))


@query
def read_guard_advice(spark, d):
    files = docs(spark, d).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), "text")
    return D.read_guard(files, Config(read_guard_lines=12))


@query
def exact_run_islands(spark, d):
    rows = A.event_rows(spark, d).select("id", "event_id", F.col("event_type").alias("line")).withColumnRenamed("event_id", "pos")
    return R.exact_runs(rows).where("size >= 2").select("id", "first_pos", "size", "line")


# ---- shell logs ----


@query
def line_fingerprint(spark, d):
    return A.event_rows(spark, d).select("event_id", T.fingerprint(F.col("line")).alias("fp"))


@query
def doc_fingerprint_counts(spark, d):
    rows = R.explode_lines(docs(spark, d)).where(F.col("line").rlike("[0-9]"))
    return rows.select(F.regexp_replace("line", "[^\\x00-\\x7F]", "x").alias("line")).groupBy(T.fingerprint(F.col("line")).alias("fp")).agg(F.count(F.lit(1)).alias("n"))


@query
def similar_run_collapse(spark, d):
    fold = folds.text_udf(folds.collapse_runs)
    return A.logs(spark, d).select("id", fold(F.col("text")).alias("text"))


@query
def strip_ansi(spark, d):
    return A.ansi_logs(spark, d).select("id", T.strip_ansi(F.col("text")).alias("text"))


@query
def strip_progress(spark, d):
    return A.progress_logs(spark, d).select("id", T.strip_progress(F.col("text")).alias("text"))


@query
def failure_gate(spark, d):
    texts = A.failing_text(spark, d).unionByName(A.runner_text(spark, d).withColumn("id", F.col("id") + 1000)).unionByName(A.logs(spark, d).withColumn("id", F.col("id") + 100000))
    return texts.select("id", T.has_failure(F.col("text")).alias("failed"))


@query
def test_output_detect(spark, d):
    texts = A.runner_text(spark, d).unionByName(A.logs(spark, d).withColumn("id", F.col("id") + 100000))
    return texts.select("id", T.is_test_output(F.col("text")).alias("is_test"))


@query
def test_summary_pass(spark, d):
    return A.runner_text(spark, d).select("id", T.passing_summary(F.col("text")).alias("text"))


@query
def test_summary_fail(spark, d):
    return A.failing_text(spark, d).select("id", folds.text_udf(folds.failing_summary)(F.col("text")).alias("text"))


@query
def stacktrace_dedup(spark, d):
    return A.trace_text(spark, d).select("id", folds.text_udf(folds.dedup_traces)(F.col("text")).alias("text"))


def _in_blocks(fold, texts):
    """A fold over blocks of ten lines, which gives what the fold over whole texts gives."""
    return G.whole(fold(G.blocks(texts, 10)))


@query
def similar_run_blocks(spark, d):
    return _in_blocks(G.collapsed_blocks, A.logs(spark, d))


@query
def test_summary_blocks(spark, d):
    return _in_blocks(G.failing_blocks, A.failing_text(spark, d))


@query
def stacktrace_blocks(spark, d):
    return _in_blocks(G.trace_blocks, A.trace_text(spark, d))


for _blocks, _texts in (("similar_run_blocks", "similar_run_collapse"), ("test_summary_blocks", "test_summary_fail"), ("stacktrace_blocks", "stacktrace_dedup")):
    ORACLES[_blocks] = ORACLES[_texts]
ORACLES["file_block_lines"] = """WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
    SELECT lang, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY lang"""
ORACLES["read_guard_folder"] = """WITH s AS (SELECT doc_id % 7 AS part, sum(strlen(text) + 1)::BIGINT AS size, sum(len(string_split(text, chr(10))))::BIGINT + 1 AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT part, size, CASE WHEN size <= 5242880 THEN n END AS n_lines, size > 5242880 AS capped, floor(size / 3 + 0.5)::BIGINT AS tokens FROM s WHERE n > 12 OR size > 5242880"""


@query
def file_block_lines(spark, d):
    """Text files of documents read by ranges of a few kB: lines and characters by language."""
    base = scratch(spark, "files")
    table(spark, d, "documents").where("text is not null").select(F.col("lang"), "text").write.partitionBy("lang").text(base, lineSep="\n")
    lang = F.regexp_extract("id", "lang=([^/]*)/", 1)
    rows = file_blocks(spark, base, "*.txt", 5000).select(lang.alias("lang"), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)).alias("line"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query
def read_guard_folder(spark, d):
    """Advice on files in a folder, of which only the first 5 MiB are read: one file for each source of documents."""
    base = scratch(spark, "guarded")
    rows = table(spark, d, "documents").where("text is not null").withColumn("part", F.col("doc_id") % 7)
    rows.select("part", "text").repartition(1, "part").write.partitionBy("part").text(base, lineSep="\n")
    found = D.read_guard_files(spark, base, "*.txt", Config(read_guard_lines=12))
    part = F.regexp_extract("path", "part=([^/]*)/", 1).cast("long")
    return found.select(part.alias("part"), "size", F.when(~F.col("capped"), F.col("n_lines")).alias("n_lines"), "capped", "tokens")


@query
def generic_chain(spark, d):
    out = P.generic_chain(A.ansi_logs(spark, d))
    return out.select("id", "reduced", F.array_join("rules", ",").alias("rules"))


# ---- listings ----


@query
def grep_dedup(spark, d):
    rows = R.first_occurrences(A.grep_rows(spark, d))
    return rows.groupBy("id").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_omitted"))


@query
def grep_match_collapse(spark, d):
    return R.collapse_matches(A.grep_rows(spark, d))


@query
def glob_group(spark, d):
    return R.glob_groups(A.glob_names(spark, d))


# ---- JSON ----


@query
def array_homogeneous(spark, d):
    df = A.json_arrays(spark, d)
    keys = F.transform(F.from_json("text", "array<map<string,string>>"), lambda m: F.array_join(F.array_sort(F.map_keys(m)), ","))
    return df.select("id", "n", ((F.size(keys) > K.ARRAY_MIN) & (F.size(F.array_distinct(keys)) == 1)).alias("homogeneous"), keys[0].alias("keys"))


@query
def array_collapse(spark, d):
    return A.json_arrays(spark, d).select("id", jsontext.reduce_json_arrays(F.col("text")).alias("text"))


@query
def json_minify(spark, d):
    return A.json_arrays(spark, d).select("id", jsontext.minify_json(F.col("text")).alias("text"))


@query
def base64_truncate(spark, d):
    blob = F.repeat(F.lit("QUJD"), (F.col("doc_id") % 400 + 80).cast("int"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("img data:image/png;base64,"), blob, F.lit(" end"))).otherwise(F.concat(F.lit("raw "), blob, F.lit("QQ== end")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), jsontext.truncate_base64(text).alias("text"))


# ---- command outputs ----


@query
def git_status_counts(spark, d):
    return A.status_text(spark, d).select("id", C.git_status(F.col("text"))["text"].alias("text"))


@query
def git_log_subjects(spark, d):
    return R.log_subjects(A.log_rows(spark, d))


@query
def git_log_text(spark, d):
    texts = A.lines_text(A.log_rows(spark, d), "pos")
    return texts.select("id", C.git_log(F.col("text"), F.array(F.lit("git"), F.lit("log")))["text"].alias("text"))


@query
def git_diff_context(spark, d):
    return R.diff_context(A.diff_rows(spark, d))


def _about(binary: str, sub: str = "", *tokens: str):
    return F.struct(F.array(*map(F.lit, tokens or (binary,))).alias("tokens"), F.lit(binary).alias("binary"), F.lit(sub).alias("subcommand"))


@query
def package_summary(spark, d):
    return A.package_text(spark, d).select("id", C.packages(F.col("text"), _about("npm", "install"))["text"].alias("text"))


@query
def go_json_summary(spark, d):
    return A.go_text(spark, d).select("id", C.go_json(F.col("text"))["text"].alias("text"))


@query
def runner_summary(spark, d):
    return A.runner_text(spark, d).select("id", C.tests(F.col("text"), _about("jest"))["text"].alias("text"))


@query
def linter_dedup(spark, d):
    return R.lint_dedup(A.lint_rows(spark, d)).where(F.col("nth") <= K.DIAGNOSTIC_SHOWN).select("id", "pos", "rule", "nth", "total")


@query
def linter_text(spark, d):
    return A.lines_text(A.lint_rows(spark, d), "pos").select("id", C.linters(F.col("text"), _about("tsc"))["text"].alias("text"))


@query
def container_table(spark, d):
    return A.table_text(spark, d).select("id", C.containers(F.col("text"), _about("kubectl", "get"))["text"].alias("text"))


def _commands(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, A.COMMANDS)), (F.col("conv_id") % 8 + 1).cast("int")).alias("command"))


@query
def command_family(spark, d):
    return described(_commands(spark, d)).groupBy(F.col("about.family").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query
def command_meta(spark, d):
    return described(_commands(spark, d)).select("conv_id", "turn", "about.binary", "about.subcommand")


@query
def rewrite_command(spark, d):
    return described(_commands(spark, d), config=Config(rewrite=RewriteOptions(docker_build=True))).where("about.rewritten is not null").groupBy("command", "about.rewritten", "about.rewrite_rule").agg(F.count(F.lit(1)).alias("n"))


@query
def custom_filter(spark, d):
    config = Config(filters=(Filter("^node ", "quiet", strip_lines_matching="^skip", max_lines=5),))
    made, _ = C.custom(F.col("text"), F.lit("node worker.js"), config)
    return A.logs(spark, d).select("id", made["text"].alias("text"), made["rule"].alias("rule"))


@query
def bash_end_to_end(spark, d):
    return P.bash_results(A.shell_results(spark, d)).select("id", "out_stdout", F.array_join("rules", ",").alias("rules"), "bytes_in", "bytes_out", "lossy", "outcome")


# ---- ledger ----


@query
def ledger_by_tool(spark, d):
    return L.by_tool(A.facts(spark, d))


@query
def session_summary(spark, d):
    return L.session_summary(A.facts(spark, d))


@query
def token_cost(spark, d):
    total = L.by_tool(A.facts(spark, d)).withColumn("est_tokens", T.est_tokens(F.col("bytes_saved")))
    return total.select("tool", "est_tokens", T.half_up(T.cost_usd(F.col("est_tokens")) * 1000000).alias("micro_usd"), T.human_size(F.col("bytes_in")).alias("size_in"))


@query
def history_marginals(spark, d):
    return L.marginals(A.facts(spark, d)).withColumn("day", F.col("day").cast("string"))


def _history(spark, d):
    return L.marginals(A.facts(spark, d))


@query
def period_daily(spark, d):
    return L.period_report(_history(spark, d), "daily", AS_OF)


@query
def period_weekly(spark, d):
    return L.period_report(_history(spark, d), "weekly", AS_OF)


@query
def period_monthly(spark, d):
    return L.period_report(_history(spark, d), "monthly", AS_OF, "project")


@query
def retention_90d(spark, d):
    return L.retained(_history(spark, d), dt.date(2024, 4, 14)).groupBy("dim").agg(F.countDistinct("day").alias("days"), F.min("day").cast("string").alias("first_day"), F.sum("events").alias("events"))


@query
def top_commands(spark, d):
    return L.top_commands(_history(spark, d), "all", AS_OF, 3)


@query
def day_graph(spark, d):
    return L.day_graph(L.day_rows(_history(spark, d), "all", AS_OF), 20).withColumn("day", F.col("day").cast("string"))


@query
def csv_days(spark, d):
    return L.csv_rows(L.day_rows(_history(spark, d), "all", AS_OF))


@query
def project_report(spark, d):
    return L.project_report(_history(spark, d), "p3", "weekly", AS_OF)


@query
def diagnostics_table(spark, d):
    e = A.facts(spark, d).select("tool", F.col("project").alias("event"), F.when(F.col("bytes_out") > F.col("bytes_in"), "skippedPoorRatio").otherwise("compressed").alias("outcome"))
    return L.diagnostics_pivot(L.diagnostics(e), ["attempted", "compressed", "skippedPoorRatio"]).na.fill(0)


@query
def latest_ledger(spark, d):
    return L.latest_session(A.facts(spark, d).withColumn("updated_at", F.col("ts")))


@query
def status_line(spark, d):
    f = A.facts(spark, d).withColumn("model", F.when(F.col("session_id") != "s1", F.lit("m1"))).withColumn("context_percent", F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 97).cast("int")))
    return L.status_line(f)


@query
def tee_retention(spark, d):
    f = A.facts(spark, d)
    r = f.select("session_id", F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("use_id"), F.col("event_id").alias("seq"), F.repeat(F.lit("x"), (F.col("event_id") % 3 * 4096).cast("int")).alias("original"), (F.col("event_id") % 5 != 0).alias("lossy"), F.lit(False).alias("failed"))
    return L.recovery_rows(r, 4).select("session_id", "use_id", "nth", L.recovery_path(F.col("session_id"), F.concat(F.col("use_id"), F.lit(".a b"))).alias("path"))


# ---- transcripts ----


def _pairs(spark, d):
    return X.pairs(X.recent(X.tool_blocks(A.transcripts(spark, d)), dt.datetime(2024, 1, 30)))


@query
def transcript_pairs(spark, d):
    return _pairs(spark, d).select("file", "line_no", "use_id", "command", F.octet_length("output").cast("long").alias("bytes"))


def _section(name):
    return lambda spark, d: X.section(X.costs(_pairs(spark, d)), name, 4)


QUERIES["discover_families"] = _section("all")
QUERIES["discover_sinks"] = _section("sink")
QUERIES["discover_opportunities"] = _section("rewritable")


# ---- repeated reads ----


@query
def read_cache_batch(spark, d):
    return D.read_cache(A.reads(spark, d)).select("session_id", "path", "seq", "op", "hit", "source", F.coalesce("header_lines", F.lit(0)).alias("header_lines"), "outcome")


@query
def read_cache_savings(spark, d):
    return D.stubs(D.read_cache(A.reads(spark, d))).groupBy("bucket").agg(F.count(F.lit(1)).alias("events"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))


@query
def read_cache_stream_run(spark, d):
    base = scratch(spark, "reads")
    A.reads(spark, d).repartition(4).write.parquet(f"{base}/in")
    events = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    run_to_table(read_cache_stream(events), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("header_lines", F.coalesce("header_lines", F.lit(0)))
