"""Tool results by tool: search listings, file listings, JSON of other tools, file reads and changes.

Events are rows (id, session_id, seq, tool_name, tool_input, tool_response), the
last two JSON texts.  Every event gets one outcome; what a gate turns down passes
through unchanged, with no record.  Sizes of listings are UTF-16 units, all others
bytes of UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import Config
from skein.functions import fixed as K
from skein.functions import jsontext
from skein.functions import text as T
from skein.operators import lines as R
from skein.operators import reads
from skein.operators.lines import settled
from skein.sources.tables import located_text


def _gate(tool: str, text: Column, config: Config) -> Column:
    """What stops a text before anything is tried; null for none."""
    return F.when(F.lit(config.disabled(tool)), "disabled").when(text.isNull(), "unsupportedShape").when(T.units(text) < config.min_chars, "skippedBelowThreshold")


def _too_little(n_in: Column, n_out: Column) -> Column:
    """Whether less than a tenth is saved, by units."""
    return (n_in - n_out) * 10 < n_in


def _finished(df: DataFrame, tool: str, keep: list[str], sizes: tuple[Column, Column]) -> DataFrame:
    """The given columns, bucket, outcome, sizes and the record of rows with ``gate`` and the reduced text ``small``."""
    poor = _too_little(T.units(F.col("text")), T.units(F.col("small")))
    outcome = F.coalesce("gate", F.when(F.col("small").isNull(), "failedOpen").when(poor, "skippedPoorRatio").otherwise("compressed"))
    df = settled(df.withColumn("outcome", outcome))
    done = F.col("outcome") == "compressed"
    record = jsontext.write_back(F.when(done, F.col("tool_response")), F.col("shape"), F.col("small"))
    return df.select(*keep, F.lit(tool).alias("bucket"), "outcome", F.when(done, sizes[0]).cast("long").alias("size_in"), F.when(done, sizes[1]).cast("long").alias("size_out"), record.alias("record"))


def grep_results(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Search listings: equal lines once, long runs of one file folded."""
    text, shape = located_text("tool_response", listing=True)
    df = events.withColumn("text", text).withColumn("shape", shape).withColumn("gate", _gate("Grep", F.col("text"), config))
    df = R.with_collapsed_matches(settled(df), F.when(F.col("gate").isNull(), F.col("text")), "small")
    return _finished(df, "Grep", ["id"], (T.units(F.col("text")), T.units(F.col("small"))))


def glob_results(events: DataFrame, config: Config = Config()) -> DataFrame:
    """File listings of more than GLOB_MIN_NAMES names: one line for each folder in place of the names.

    A response without an array of names has no outcome: it counts as attempted only.
    """
    missing = F.col("tool_response").isNull() | (F.col("tool_response") == "")
    names = F.from_json(F.try_variant_get(F.try_parse_json("tool_response"), "$.filenames", "string"), "array<string>")
    df = events.withColumn("names", names).withColumn("whole", F.to_json("names"))
    small = F.when(F.size("names") <= K.GLOB_MIN_NAMES, "skippedBelowThreshold")
    df = settled(df.withColumn("gate", F.coalesce(F.when(F.lit(config.disabled("Grep")), "disabled"), F.when(missing, "unsupportedShape"), F.when(T.units(F.col("whole")) < config.min_chars, "skippedBelowThreshold"), small)))
    df = R.with_folder_lines(df, F.when(F.col("gate").isNull(), F.col("names")), "lines")
    df = settled(df.withColumn("less", F.to_json("lines")))
    n_in, n_out = T.units(F.col("whole")), T.units(F.col("less"))
    outcome = F.coalesce("gate", F.when(_too_little(n_in, n_out), "skippedPoorRatio").when(F.col("names").isNotNull(), "compressed"))
    df = settled(df.withColumn("outcome", outcome))
    done = F.coalesce(F.col("outcome") == "compressed", F.lit(False))
    return df.select("id", F.lit("Grep").alias("bucket"), "outcome", F.when(done, n_in).cast("long").alias("size_in"), F.when(done, n_out).cast("long").alias("size_out"), F.when(done, F.col("lines")).alias("filenames"), jsontext.with_names(F.when(done, F.col("tool_response")), F.col("lines")).alias("record"))


def json_results(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Results of other tools: JSON without white space, blobs cut, and, where the settings say so, long arrays of like objects folded."""
    text, shape = located_text("tool_response")
    df = events.withColumn("text", text).withColumn("shape", shape)
    df = settled(df.withColumn("gate", _gate("MCP", F.col("text"), config)))
    shorter = jsontext.reduce_json_arrays if config.fold_arrays else jsontext.reduce_json
    df = settled(df.withColumn("small", shorter(F.when(F.col("gate").isNull(), F.col("text")))))
    return _finished(df, "MCP", ["id"], (F.octet_length("text"), F.octet_length("small")))


def file_events(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Reads, edits and writes as the read cache takes them, with what stops an event before the cache (``gate``).

    ``content_after`` holds a file's text after an edit or write.
    """
    text, shape = located_text("tool_response")
    given, back = F.try_parse_json("tool_input"), F.try_parse_json("tool_response")
    held = lambda v, path: F.try_variant_get(v, path, "string")
    wrong = lambda path: F.coalesce(~held(back, path).isin("false", "", "0"), F.lit(False))
    is_read, is_change = F.col("tool_name") == "Read", F.col("tool_name").isin("Edit", "Write")
    df = events.withColumn("shape", shape).withColumn("text", text)
    df = df.withColumn("path", F.coalesce(held(given, "$.file_path"), held(back, "$.file.filePath")))
    df = df.withColumn("failed", F.coalesce(F.col("is_error"), F.lit(False)) | wrong("$.is_error") | wrong("$.error"))
    df = settled(df.withColumn("bounded", held(given, "$.offset").isNotNull() | held(given, "$.limit").isNotNull() | F.col("path").isNull()))
    gate = (
        F.when(is_read, _gate("Read", F.col("text"), config))
        .when(F.lit(config.disabled("Edit")), "disabled")
        .when(~is_change, "unsupportedTool")
        .when(F.col("failed"), "toolFailed")
        .when(F.col("path").isNull(), "missingPath")
        .when(F.col("content_after").isNull(), "failedOpen")
    )
    return df.withColumn("gate", gate).withColumn("op", F.col("tool_name")).withColumn("content", F.when(is_read, F.col("text")).otherwise(F.col("content_after")))


def file_results(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Outcomes of reads, edits and writes; a repeated read gets a stub in place of the text it would show again."""
    df = file_events(events, config)
    # rows that a gate stops don't reach the cache; the others carry all they need through it, so no row is looked up by its id
    keep = ["id", "session_id", "path", "seq", "op", "bounded", "failed", "content", "tool_name", "tool_response", "shape"]
    live = reads.with_stub(reads.read_cache(df.where(F.col("gate").isNull()).select(*keep), config))
    live = live.select(*keep, "outcome", F.when(F.col("hit"), F.col("stub")).alias("stub"), F.when(F.col("hit"), F.col("bucket")).alias("bucket"))
    none = F.lit(None).cast("string")
    df = settled(live.unionByName(df.where(F.col("gate").isNotNull()).select(*keep, F.col("gate").alias("outcome"), none.alias("stub"), none.alias("bucket"))))
    n_in, n_out = F.octet_length("content"), F.octet_length("stub")
    return df.select("id", "tool_name", "bucket", "outcome", F.when(F.col("stub").isNotNull(), n_in).cast("long").alias("size_in"), n_out.cast("long").alias("size_out"), jsontext.write_back(F.when(F.col("stub").isNotNull(), F.col("tool_response")), F.col("shape"), F.col("stub")).alias("record"))
