"""Session transcripts: tool uses paired with their results, and what they cost."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.config import Config
from skein.functions import fixed as K
from skein.functions import text as T
from skein.functions.commands import described


def _pieces(node: object) -> Iterator[str]:
    """Texts of a result's content: a string, a block's text or content, or those of a list in turn."""
    match node:
        case str():
            yield node
        case list():
            for part in node:
                yield from _pieces(part)
        case {"text": str(own)} | {"content": str(own)}:
            yield own


def _blocks(root: object) -> list[tuple[str, str | None, str | None, str | None]]:
    """(kind, id, command, output) of all tool blocks at any depth, in document order; nothing inside one is read."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
            continue
        if not isinstance(node, dict):
            continue
        kind = node.get("type")
        if kind == "tool_use":
            if "Bash" in (node.get("name"), node.get("tool_name")):
                given = node.get("input")
                command = (given.get("command") if isinstance(given, dict) else None) or node.get("command")
                out.append(("use", node.get("id") or node.get("tool_use_id"), command if isinstance(command, str) else None, None))
        elif kind == "tool_result":
            body = node.get("content") if node.get("content") is not None else node.get("output")
            out.append(("result", node.get("tool_use_id") or node.get("id"), None, "".join(_pieces(body))))
        else:
            todo += reversed(list(node.values()))
    return out


def _parse(line: str | None) -> tuple[str | None, list]:
    try:
        root = json.loads(line or "")
    except (ValueError, RecursionError):
        return None, []
    stamp = None
    if isinstance(root, dict):
        message = root.get("message")
        stamp = root.get("timestamp") or root.get("created_at") or (message.get("timestamp") if isinstance(message, dict) else None)
    return (str(stamp) if stamp else None), [b for b in _blocks(root) if b[1]]


def tool_blocks(lines: DataFrame) -> DataFrame:
    """(file, line_no, block_no, stamp, kind, use_id, command, output) from rows (file, line_no, raw)."""
    @F.pandas_udf("struct<stamp: string, blocks: array<struct<kind: string, use_id: string, command: string, output: string>>>")
    def parsed(raw: pd.Series) -> pd.DataFrame:
        rows = [_parse(x) for x in raw]
        return pd.DataFrame({"stamp": [r[0] for r in rows], "blocks": [[dict(zip(("kind", "use_id", "command", "output"), (b[0], str(b[1]), b[2], b[3]))) for b in r[1]] for r in rows]})

    found = lines.withColumn("p", parsed("raw"))
    return found.select("file", "line_no", F.col("p.stamp").alias("stamp"), F.posexplode("p.blocks").alias("block_no", "b")).select("file", "line_no", "block_no", "stamp", "b.*")


def recent(blocks: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Blocks without a readable timestamp, or of the last ``days`` days (0 stands for 30)."""
    at = F.coalesce(F.try_to_timestamp("stamp"), F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))
    return blocks.where(at.isNull() | (at >= F.lit(as_of - dt.timedelta(days=days or 30))))


def pairs(blocks: DataFrame) -> DataFrame:
    """Each result with the latest earlier use of its id in the same file: an as-of join in one window, no self-join."""
    w = Window.partitionBy("file", "use_id").orderBy("line_no", "block_no").rowsBetween(Window.unboundedPreceding, -1)
    command = F.last(F.when(F.col("kind") == "use", F.col("command")), True).over(w)
    found = blocks.withColumn("ran", command).where((F.col("kind") == "result") & F.col("ran").isNotNull())
    return found.select("file", "line_no", "block_no", "use_id", F.col("ran").alias("command"), F.coalesce("output", F.lit("")).alias("output"))


def costs(paired: DataFrame, config: Config = Config()) -> DataFrame:
    """(command, bytes, tokens, occurrences) by command family, once over all, over unreduced and over rewritable results."""
    df = described(paired, "command", config)
    size = F.octet_length("output").cast("long")
    raw = ~F.col("output").contains(K.MARK)
    quiet = raw & F.col("about.rewritten").isNotNull()
    agg = []
    for name, flag in (("all", F.lit(True)), ("sink", raw), ("rewritable", quiet)):
        agg += [F.sum(F.when(flag, size)).alias(f"{name}_bytes"), F.count_if(flag).alias(f"{name}_occurrences")]
    return df.groupBy(F.col("about.family").alias("command")).agg(*agg)


def section(report: DataFrame, name: str, n: int = K.TOP_DISCOVER) -> DataFrame:
    """The n costliest commands of one section (all, sink, rewritable)."""
    rows = report.where(F.col(f"{name}_occurrences") > 0).select("command", F.col(f"{name}_bytes").alias("bytes"), T.half_up(F.col(f"{name}_bytes") / F.lit(K.CHARS_PER_TOKEN)).alias("tokens"), F.col(f"{name}_occurrences").alias("occurrences"))
    return rows.orderBy(F.desc("tokens"), F.expr("command COLLATE UNICODE")).limit(max(1, n))
