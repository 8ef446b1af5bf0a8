"""Readers and writers: tables, tool events, files, transcripts, histories and reports."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.commands import described

EVENT_SCHEMA = "hook_event_name string, session_id string, tool_use_id string, turn_id string, cwd string, tool_name string, tool_input string, tool_response string, seq long, _corrupt_record string"
#: What Spark says of a missing folder and of files that are no whole Parquet files.
NO_HISTORY = ("PATH_NOT_FOUND", "is not a Parquet file", "PARQUET_COLUMN_DATA_TYPE_MISMATCH", "CANNOT_READ_FILE_FOOTER")
HISTORY_SCHEMA = "day date, dim string, key string, events long, bytes_in long, bytes_out long"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; where that is unset, a local one for a session on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "skein-checkpoints")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Sizes looked at after every row, so that a few rows of many MB don't wait for the hundredth; they are read in such groups again.
LONG_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def stored(df: DataFrame, what: str, options: dict[str, int] | None = None) -> DataFrame:
    """The rows written to a fresh path of the shared folder and read again: what follows reads them, and doesn't make them anew."""
    path = scratch(df.sparkSession, what)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the batches that pass to Python by bytes, where the session doesn't yet."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def tool_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines tool events; lines that aren't JSON objects are left out."""
    rows = spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col("tool_name").isNotNull()).drop("_corrupt_record")


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole files under a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def transcript_lines(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """(file, line_no, raw) of all *.jsonl under a folder; files are split, only the numbering shuffles their lines.

    ``project`` selects the folder named by its slug, or else all whose path
    contains the slug in any case; the scan lists only matching files, as the
    condition is on their path and stands below the numbering.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    if project is not None:
        slug, path = re.sub("[^A-Za-z0-9]", "-", project), F.col("_metadata.file_path")
        exact = path.rlike(f"/{slug}/[^/]*$")
        some = rows.where(exact).limit(1).count() > 0  # a line at most reaches the driver
        rows = rows.where(exact if some else F.lower(path).contains(slug.lower()))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1
    return rows.select("file", number.alias("line_no"), "raw").where(T.bare(F.col("raw")) != "")


def located_text(response: str = "tool_response", listing: bool = False) -> tuple[Column, Column]:
    """(text, shape) of a response: plain text, or JSON that is a string, holds one text block, or an object.

    Objects give file.content, content, output or text, the first that is a string.  A search listing (``listing``)
    gives the content of its content mode first (shape grep) and has no file.
    """
    raw = F.col(response)
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    blocks = F.filter(F.from_json(raw, "array<struct<type: string, text: string>>"), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    held = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    got = lambda path: F.try_variant_get(v, path, "string")
    is_object, mode = kind.startswith("OBJECT"), F.coalesce(got("$.mode") == "content", F.lit(False))
    shape = F.when(raw.isNotNull() & v.isNull(), "plain").when(kind == "STRING", "string").when(kind.startswith("ARRAY") & (F.size(blocks) == 1), "blocks")
    text = F.when(shape == "plain", raw).when(shape == "string", got("$")).when(shape == "blocks", F.try_element_at(blocks, F.lit(1))["text"])
    places = [("grep", "$.content", mode)] if listing else [("file", "$.file.content", F.lit(True))]
    for name, path, more in (*places, *((k, f"$.{k}", F.lit(True)) for k in ("content", "output", "text"))):
        here = is_object & more & F.coalesce(held(path), F.lit(False))
        shape, text = shape.when(here, name), text.when(here, got(path))
    return text, shape


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Daily marginals, with command keys reduced to their families; a missing or damaged history counts as empty.

    Any other failure, such as a refused or a lost read, is raised: a history taken for empty would be written over.
    """
    try:
        rows = spark.read.schema(HISTORY_SCHEMA).parquet(path)
        rows.agg(*(F.count(c) for c in rows.columns)).collect()
    except (PySparkException, Py4JJavaError) as e:
        if not any(sign in str(e) for sign in NO_HISTORY):
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)
    commands = described(rows.where("dim = 'command'"), "key").withColumn("key", F.col("about.family")).drop("about")
    return merge_history(rows.where("dim <> 'command'"), commands)


def merge_history(history: DataFrame, more: DataFrame) -> DataFrame:
    """Marginals with further deltas added (columns of HISTORY_SCHEMA)."""
    both = history.unionByName(more)
    return both.groupBy("day", "dim", "key").agg(*(F.sum(c).alias(c) for c in ("events", "bytes_in", "bytes_out")))


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def replacement(results: DataFrame, target: str = "structured") -> DataFrame:
    """Output records: a structured replacement, or a stop reason with additional context."""
    shown = F.to_json(F.struct(F.col("out_stdout").alias("stdout"), F.col("out_stderr").alias("stderr"), F.coalesce("interrupted", F.lit(False)).alias("interrupted"), F.coalesce("is_image", F.lit(False)).alias("isImage")))
    whole = F.concat_ws("\n", F.when(F.col("out_stdout") != "", F.col("out_stdout")), F.when(F.col("out_stderr") != "", F.col("out_stderr")))
    record = shown if target == "structured" else F.to_json(F.struct(F.lit("output was reduced").alias("stopReason"), whole.alias("additionalContext")))
    return results.select("id", F.when(F.col("outcome") == "compressed", record).alias("record"))
