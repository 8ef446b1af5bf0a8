"""Repeated file reads: content-hash dedup over a session's reads, edits and writes, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import Config
from skein.functions import fixed as K
from skein.functions import text as T
from skein.sources.files import line_counts


def with_facts(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds hash, n_lines and whether the event can touch the cache.

    ``events``: session_id, path, seq, op (Read, Edit, Write), bounded, failed,
    content (after the edit for Edit and Write).
    """
    n_lines = F.size(T.lines(F.col("content")))
    read = (F.col("op") == "Read") & ~F.col("bounded") & (T.units(F.col("content")) >= config.min_chars)
    change = F.col("op").isin("Edit", "Write") & ~F.col("failed") & (n_lines <= config.read_default_lines)
    return events.withColumn("hash", F.sha2("content", 256)).withColumn("n_lines", n_lines).withColumn("can_touch", read | change)


def read_cache(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds hit, source (last setter), header_lines and outcome; one shuffle by (session, path)."""
    df = with_facts(events, config)
    before = Window.partitionBy("session_id", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seeded = F.coalesce(F.max((F.col("can_touch") & (F.col("op") != "Edit")).cast("int")).over(before), F.lit(0)) == 1
    df = df.withColumn("touches", F.col("can_touch") & ((F.col("op") != "Edit") | seeded))
    df = df.withColumn("old_hash", F.last(F.when(F.col("touches"), F.col("hash")), True).over(before))
    df = df.withColumn("hit", (F.col("op") == "Read") & F.col("touches") & F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False)))
    setter = F.col("touches") & ~F.col("hit")
    df = df.withColumn("source", F.last(F.when(setter, F.col("op")), True).over(before)).withColumn("header_lines", F.last(F.when(setter, F.col("n_lines")), True).over(before))
    change = F.col("op").isin("Edit", "Write")
    outcome = (
        F.when(F.col("hit"), "deduped")
        .when(change & F.col("failed"), "toolFailed")
        .when((F.col("op") == "Edit") & ~seeded, "skippedNoPriorRead")
        .when(change & ~F.col("can_touch"), "skippedOversized")
        .when(change, "updated")
        .when(T.units(F.col("content")) < config.min_chars, "skippedBelowThreshold")
        .otherwise("skippedFirstRead")
    )
    return df.withColumn("outcome", outcome)


def with_stub(cached: DataFrame) -> DataFrame:
    """Adds the stub that stands for a hit's text, and the bucket its saving goes to."""
    edited = F.col("source").isin("Edit", "Write")
    since = F.when(edited, F.lit("your last Edit/Write")).otherwise(F.lit("previous read"))
    stub = F.concat(F.lit(K.MARK), F.lit(" "), F.col("path"), F.lit(" unchanged since "), since, F.lit(" in this session ("), F.col("header_lines").cast("string"), F.lit(" lines, sha256:"), F.substring("hash", 1, 12), F.lit("); read with offset/limit for the content]"))
    return cached.withColumn("stub", stub).withColumn("bucket", F.when(edited, "Edit").otherwise("Read"))


def stubs(cached: DataFrame) -> DataFrame:
    """(session_id, path, seq, bucket, stub, bytes_in, bytes_out) of each hit."""
    found = with_stub(cached.where("hit"))
    return found.select("session_id", "path", "seq", "bucket", "stub", F.octet_length("content").cast("long").alias("bytes_in"), F.octet_length("stub").cast("long").alias("bytes_out"))


def read_guard(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Advice on unbounded reads of long files: (path, text), with size, lines, capped and tokens."""
    head = F.substring(F.encode("text", "UTF-8"), 1, K.COUNT_CAP_BYTES)
    # counted on bytes (one character each in this character set), as the cut may fall inside a character
    n = F.regexp_count(F.decode(head, "ISO-8859-1"), F.lit("\n")) + 1
    return guard_advice(files.withColumn("size", F.octet_length("text").cast("long")).withColumn("n_lines", n), config).drop("text")


def read_guard_files(spark: SparkSession, path: str, pattern: str = "*", config: Config = Config()) -> DataFrame:
    """The same for the files of a folder, of each of which the first 5 MiB at most are read."""
    return guard_advice(line_counts(spark, path, pattern).drop("bytes_read"), config)


def guard_advice(facts: DataFrame, config: Config = Config()) -> DataFrame:
    """Advice from (path, size, n_lines), where n_lines counts the first 5 MiB only."""
    df = facts.withColumn("capped", F.col("size") > K.COUNT_CAP_BYTES)
    df = df.withColumn("tokens", T.half_up(F.col("size") / F.lit(K.CHARS_PER_TOKEN))).where(F.col("capped") | (F.col("n_lines") > config.read_guard_lines))
    shown = F.concat(F.when(F.col("capped"), F.lit(">")).otherwise(F.lit("")), F.col("n_lines").cast("string"))
    return df.withColumn("advice", F.concat(F.lit(K.MARK + " "), F.col("path"), F.lit(" is "), shown, F.lit(" lines (~"), F.col("tokens").cast("string"), F.lit(" tokens); read it with offset/limit]")))
