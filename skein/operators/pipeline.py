"""The generic chain, gates and outcomes of tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from skein.config import Config
from skein.functions import fixed as K
from skein.functions import folds
from skein.functions import text as T
from skein.functions.commands import described
from skein.operators.compressors import compress, fold, is_folded
from skein.operators.lines import settled
from skein.sources.tables import LONG_ROWS, bounded_batches, stored


def generic_chain(df: DataFrame, text: str = "text", tables: bool = False) -> DataFrame:
    """Adds ``reduced`` and ``rules``: escapes, progress, similar runs, test runs, traces, long texts; ends with the near-empty guard.

    ``tables``: its parts before, in and behind Python hand on tables, so that a task holds a long text in one of them only.
    """
    handed = (lambda df, what: stored(df, what, LONG_ROWS)) if tables else (lambda df, what: settled(df))
    # a row holds a text as it came and as it is so far; that a step changed it is kept as a flag
    df = settled(df.withColumn("_1", T.strip_ansi(F.coalesce(F.col(text), F.lit("")))))
    df = settled(df.withColumn("_2", T.strip_progress(F.col("_1"))))
    df = df.withColumn("_ansi", F.coalesce(F.col(text), F.lit("")) != F.col("_1")).withColumn("_progress", F.col("_1") != F.col("_2")).drop("_1")
    # texts that a gate or a summary took are null and cost the fold nothing
    df = settled(handed(df, "plain").withColumn("_f", folds.chained(F.when(F.col(text).isNotNull(), F.col("_2")))))
    done = lambda name: F.coalesce(F.col(f"_f.{name}"), F.lit(False))
    df = df.select("*", F.coalesce(F.col("_f.text"), F.col("_2")).alias("_5"), *(done(name).alias(f"_{name}") for name in ("collapsed", "summed", "traced"))).drop("_f", "_2")
    df = settled(handed(df, "chained").withColumn("_6", T.head_tail(F.col("_5"))))
    df = df.withColumn("_cut", F.col("_5") != F.col("_6")).drop("_5")
    steps = [("stripAnsi", "_ansi"), ("stripProgressNoise", "_progress"), ("collapseRepeatedLines", "_collapsed"), ("summarizeTestRunners", "_summed"), ("dedupStackTraces", "_traced"), ("headTailTruncate", "_cut")]
    rules = F.array_compact(F.array(*(F.when(F.col(changed), F.lit(name)) for name, changed in steps)))
    whole = F.coalesce(F.col(text), F.lit(""))
    n_in, n_out = F.octet_length(whole), F.octet_length("_6")
    restored = (whole != "") & ((F.col("_6") == "") | ((n_out * 10 < n_in) & ~T.is_test_output(whole)))
    df = settled(df.withColumn("_restored", restored))
    df = df.withColumn("reduced", F.when(F.col("_restored"), whole).otherwise(F.col("_6")))
    df = df.withColumn("rules", F.when(F.col("_restored"), F.array().cast("array<string>")).otherwise(rules))
    return df.drop("_restored", "_6", *(changed for _, changed in steps))


def with_marker(text: Column, rules: Column) -> Column:
    """A last line that names the rules."""
    return F.when(F.size(rules) > 0, F.concat(T.chomp(text), F.lit("\n"), T.mark(F.array_join(F.array_distinct(rules), ", ")))).otherwise(text)


def size_gate(text: Column, config: Config = Config()) -> Column:
    return T.units(text) >= config.min_chars


def observed_failure(exit_code: Column, bad_out: Column, bad_err: Column, binary: Column) -> Column:
    """The exit code where one was seen; else failure records on stderr or, but for linters, stdout."""
    linter = F.coalesce(binary.isin(K.LINTERS), F.lit(False))
    return F.coalesce(exit_code != 0, bad_err | (~linter & bad_out))


def bash_results(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Reduces shell results (id, command, stdout, stderr, exit_code, is_image).

    Adds out_stdout, out_stderr, rules, bytes_in, bytes_out, lossy and outcome;
    whatever a gate turns down passes through unchanged.

    Between any two steps in Python lies a table, so that a task holds a long text in one of them only.
    """
    bounded_batches(events.sparkSession)
    untyped = [c for c in events.columns if isinstance(events.schema[c].dataType, NullType)]  # no table holds them
    kinds = {"exit_code": "int", "is_image": "boolean"}
    df = events.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in untyped})
    df = df.withColumn("stdout", F.coalesce("stdout", F.lit(""))).withColumn("stderr", F.coalesce("stderr", F.lit("")))
    df = described(settled(df), "command", config, beside=("stdout", "stderr"))
    df = settled(df.withColumn("_bad_out", T.has_failure(F.col("stdout"))).withColumn("_bad_err", T.has_failure(F.col("stderr"))))
    failed = observed_failure(F.col("exit_code"), F.col("_bad_out"), F.col("_bad_err"), F.col("about.binary"))
    gate = (
        F.when(F.lit(config.disabled("Bash")), F.lit("disabled"))
        .when(F.coalesce(F.col("is_image"), F.lit(False)), F.lit("skippedImage"))
        .when(T.units(F.col("stdout")) + T.units(F.col("stderr")) < config.min_chars, F.lit("skippedBelowThreshold"))
        .when(failed, F.lit("skippedFailure"))
    )
    df = stored(df.withColumn("gate", gate), "gated", LONG_ROWS)
    asked = F.col("gate").isNull() & F.coalesce(is_folded(F.col("about")), F.lit(False))
    # only texts that a fold takes go to Python, so their bytes bound its batches
    folded = settled(df.where(asked).withColumn("_folded", fold(F.col("stdout"), F.col("about"))))
    rest = df.where(~asked).withColumn("_folded", F.lit(None).cast("string"))
    special = F.when(F.col("gate").isNull(), compress(F.col("stdout"), F.col("about"), F.col("command"), F.lit(False), config, F.col("_bad_out"), F.col("_folded")))
    df = folded.unionByName(rest).withColumn("_special", special).drop("_folded", "_bad_out", "_bad_err", "about")
    df = stored(df, "special", LONG_ROWS)
    plain = F.col("gate").isNull() & F.col("_special").isNull()
    kept = df.where(~plain).withColumn("_text", F.coalesce("_special.text", F.lit(""))).withColumn("_rules", F.when(F.col("_special").isNotNull(), F.array(F.col("_special.rule"))).otherwise(F.array().cast("array<string>"))).drop("_special")
    chained = generic_chain(df.where(plain).drop("_special"), "stdout", tables=True).withColumnsRenamed({"reduced": "_text", "rules": "_rules"})
    df = settled(kept.unionByName(chained))
    err = T.strip_progress(T.strip_ansi(F.col("stderr")), True)
    err_rules = F.array_compact(F.array(F.when(T.strip_ansi(F.col("stderr")) != F.col("stderr"), F.lit("stripAnsi")), F.when(err != T.strip_ansi(F.col("stderr")), F.lit("stripProgressNoise"))))
    df = df.withColumn("_out", with_marker(F.col("_text"), F.col("_rules"))).withColumn("_err", with_marker(err, err_rules)).withColumn("_lossy", F.col("_text") != T.strip_ansi(F.col("stdout"))).drop("_text")
    df = settled(df)
    n_in = F.octet_length("stdout") + F.octet_length("stderr")
    n_out = F.octet_length("_out") + F.octet_length("_err")
    df = df.withColumn("outcome", F.coalesce(F.col("gate"), F.when(T.poor_ratio(n_in, n_out), F.lit("skippedPoorRatio")).otherwise(F.lit("compressed"))))
    done = F.col("outcome") == "compressed"
    lossy = done & F.col("_lossy")
    return df.select(
        *[F.lit(None).alias(c) if c in untyped else c for c in events.columns if c not in ("stdout", "stderr")],
        F.when(done, F.col("_out")).otherwise(F.col("stdout")).alias("out_stdout"),
        F.when(done, F.col("_err")).otherwise(F.col("stderr")).alias("out_stderr"),
        F.when(done, F.col("_rules")).otherwise(F.array().cast("array<string>")).alias("rules"),
        n_in.cast("long").alias("bytes_in"),
        F.when(done, n_out).otherwise(n_in).cast("long").alias("bytes_out"),
        lossy.alias("lossy"),
        "outcome",
    )
