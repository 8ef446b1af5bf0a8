"""Output records and reports beside the ledger: targets, advice, recovery lines, tables, wiring checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T


def target(forced: Column, turn_id: Column, roots: dict[str, str | None]) -> Column:
    """Which kind of host an event came from: a forced one, one known by its turn id, or by the environment."""
    by_env = "context" if roots.get("context_home") and not roots.get("structured_root") else "structured"
    return F.when(forced.isin("structured", "context"), forced).when(F.coalesce(turn_id, F.lit("")) != "", F.lit("context")).otherwise(F.lit(by_env))


def advice_record(event: Column, advice: Column) -> Column:
    """A record that lets a tool call go on and adds a note."""
    return F.to_json(F.struct(F.struct(event.alias("hookEventName"), advice.alias("additionalContext")).alias("hookSpecificOutput")))


def rewrite_record(event: Column, command: Column, rule: Column) -> Column:
    """A record that allows a tool call with another command."""
    changed = F.struct(command.alias("command"))
    return F.when(command.isNotNull(), F.to_json(F.struct(F.struct(event.alias("hookEventName"), F.lit("allow").alias("permissionDecision"), rule.alias("permissionDecisionReason"), changed.alias("updatedInput")).alias("hookSpecificOutput"))))


def with_recovery(text: Column, path: Column) -> Column:
    """A last line that says where the original is kept; nothing else is touched."""
    return F.when(path.isNotNull(), F.concat(T.chomp(text), F.lit("\n"), T.mark("full: ", path))).otherwise(text)


def grep_write_back(response: Column, text: Column) -> Column:
    """A grep response of content mode with its text replaced and its lines counted again."""
    return response.withField("content", text).withField("numLines", F.size(T.lines(text)))


def ratio_report(plain: DataFrame, whole: DataFrame) -> DataFrame:
    """(name, bytes_in, percent, whole_percent, rules): pipeline figures beside end-to-end ones, where there are any."""
    end = whole.select("name", T.reduction_percent(F.col("bytes_in"), F.col("bytes_out")).alias("whole_percent"))
    return plain.join(end, "name", "left").select("name", "bytes_in", T.reduction_percent(F.col("bytes_in"), F.col("bytes_out")).alias("percent"), "whole_percent", "rules").orderBy("name")


def markdown_cell(x: Column) -> Column:
    """A value that can't break a Markdown table."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"([\\|])", r"\\$1"), r"\r?\n", " ")


def markdown_rows(df: DataFrame) -> DataFrame:
    """Rows of a table as Markdown lines."""
    cells = [markdown_cell(F.col(c)) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def largest(texts: DataFrame) -> DataFrame:
    """The longest text's name."""
    return texts.agg(F.max_by("name", F.struct(F.octet_length("text"), "name")).alias("name"))


def missing_scripts(wired: DataFrame, present: DataFrame) -> DataFrame:
    """Wired scripts that aren't there."""
    return wired.join(present, "script", "left_anti").select("script").distinct()


def savings_text(by_tool: DataFrame, title: str) -> DataFrame:
    """(part, pos, line): the report on savings as lines, tools by what they saved; one row for each tool, so the window is small."""
    size = T.human_size
    percent = F.when(F.col("bytes_in") == 0, F.lit(0).cast("long")).otherwise(T.half_up(F.col("bytes_saved") / F.col("bytes_in") * 100))
    wide = lambda x, n, pad: pad(x, F.greatest(F.lit(n), F.length(x)), F.lit(" "))
    line = F.concat(F.lit("  "), wide(F.col("tool"), 12, F.rpad), F.lit(" "), wide(F.col("events").cast("string"), 4, F.lpad), F.lit(" calls  "), size(F.col("bytes_in")), F.lit(" -> "), size(F.col("bytes_out")), F.lit("  ("), percent.cast("string"), F.lit("% smaller)"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bytes_saved"), "tool")).cast("long")
    tools = by_tool.select(F.lit(1).alias("part"), place.alias("pos"), line.alias("line"))
    sums = by_tool.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes_in", "bytes_out", "bytes_saved")))
    total = sums.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("  total  "), size(F.col("bytes_in")), F.lit(" -> "), size(F.col("bytes_out")), F.lit(" | ~"), F.format_number(T.est_tokens(F.col("bytes_saved")), 0), F.lit(" tokens saved")).alias("line"))
    head = sums.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(f"skein {title}:").alias("line"))
    return head.unionByName(tools).unionByName(total)


def padded_rows(df: DataFrame, right: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a small report as lines of aligned columns under their names; ``right`` names the columns aligned right."""
    cells = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    widths = cells.agg(*(F.greatest(F.lit(len(c)), F.max(F.length(c))).alias(c) for c in df.columns)).first()  # one row
    width = {c: int(widths[c] or len(c)) for c in df.columns}
    padded = [(F.lpad if c in right else F.rpad)(F.col(c), width[c], " ") for c in df.columns]
    heads = df.sparkSession.createDataFrame([tuple(df.columns)], cells.schema)
    return heads.unionByName(cells).select(F.rtrim(F.concat_ws("  ", *padded)).alias("line"))
