"""Savings and diagnostics: roll-ups, periods, retention and reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import fixed as K
from skein.functions import text as T


def _sums() -> list[Column]:
    return [F.sum("events").alias("events"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")]


def saved() -> Column:
    return F.col("bytes_in") - F.col("bytes_out")


def by_tool(facts: DataFrame, *keys: str) -> DataFrame:
    """Events and bytes by (keys, tool); facts: session_id, day, tool, command, project, bytes_in, bytes_out, events."""
    return facts.groupBy(*keys, "tool").agg(*_sums()).withColumn("bytes_saved", saved())


def session_summary(facts: DataFrame) -> DataFrame:
    """By session and tool, and in total (tool null), with tokens and cost; one pass by rollup."""
    both = facts.rollup("session_id", "tool").agg(*_sums(), F.grouping_id().alias("level")).where("level < 3").drop("level").withColumn("bytes_saved", saved())
    return both.withColumn("est_tokens", T.est_tokens(F.col("bytes_saved"))).withColumn("est_usd", T.cost_usd(F.col("est_tokens")))


def marginals(facts: DataFrame) -> DataFrame:
    """(day, dim, key, events, bytes_in, bytes_out): three independent daily marginals from one scan."""
    dims = ("tool", "command", "project")
    each = facts.select("day", "bytes_in", "bytes_out", F.when(F.coalesce("events", F.lit(0)) == 0, 1).otherwise(F.col("events")).alias("events"), F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in dims))).alias("x"))
    return each.groupBy("day", F.col("x.dim").alias("dim"), F.col("x.key").alias("key")).agg(*_sums())


def in_period(day: Column, period: str, as_of: dt.date) -> Column:
    """daily, weekly (seven days up to as_of), monthly (calendar month) or all."""
    if period == "daily":
        return day == F.lit(as_of)
    if period == "weekly":
        return day >= F.lit(as_of - dt.timedelta(days=6))
    if period == "monthly":
        first = as_of.replace(day=1)  # as a range of plain dates it reaches the scan
        return (day >= F.lit(first)) & (day < F.lit((first + dt.timedelta(days=31)).replace(day=1)))
    return F.lit(True)


def retained(history: DataFrame, as_of: dt.date, days: int = K.RETENTION_DAYS) -> DataFrame:
    return history.where(F.col("day") >= F.lit(as_of - dt.timedelta(days=days - 1)))


def day_rows(history: DataFrame, period: str, as_of: dt.date, project: str | None = None) -> DataFrame:
    """(day, bytes_in, bytes_out, bytes_saved, events) of a period, of one project if given."""
    part = F.col("dim") == ("tool" if project is None else "project")
    part = part if project is None else part & (F.col("key") == project)
    days = history.where(in_period(F.col("day"), period, as_of)).groupBy("day")
    own = lambda c: F.coalesce(F.sum(F.when(part, F.col(c))), F.lit(0)).alias(c)
    return days.agg(own("bytes_in"), own("bytes_out"), own("events")).withColumn("bytes_saved", saved())


def period_report(history: DataFrame, period: str, as_of: dt.date, dim: str = "tool") -> DataFrame:
    rows = history.where((F.col("dim") == dim) & in_period(F.col("day"), period, as_of))
    return rows.groupBy("key").agg(*_sums()).withColumn("bytes_saved", saved()).withColumn("est_tokens", T.est_tokens(F.col("bytes_saved")))


def project_report(history: DataFrame, project: str, period: str, as_of: dt.date) -> DataFrame:
    """(section, key, ...): the project's own rows, and commands of all projects beside them."""
    own = history.where((F.col("dim") == "project") & (F.col("key") == project))
    rows = own.unionByName(history.where(F.col("dim") == "command")).where(in_period(F.col("day"), period, as_of))
    return rows.groupBy(F.col("dim").alias("section"), "key").agg(*_sums()).withColumn("bytes_saved", saved())


def top_commands(history: DataFrame, period: str, as_of: dt.date, n: int = K.TOP_COMMANDS) -> DataFrame:
    return period_report(history, period, as_of, "command").orderBy(F.desc("bytes_saved"), "key").limit(n)


def day_graph(days: DataFrame, n: int = K.GRAPH_DAYS) -> DataFrame:
    """The last n recorded days with a bar of up to twenty blocks; one row a day, so the window is small."""
    last = days.orderBy(F.desc("day")).limit(n)
    most = F.greatest(F.lit(1), F.max("bytes_saved").over(Window.partitionBy(F.lit(0))))
    return last.withColumn("bar", F.repeat(F.lit("█"), F.greatest(F.lit(0), T.half_up(F.col("bytes_saved") / most * 20)).cast("int"))).select("day", "bytes_saved", "bar")


def diagnostics(events: DataFrame) -> DataFrame:
    """Counts by tool, event and outcome; every event also counts as attempted."""
    both = events.select("tool", "event", F.explode(F.array(F.lit("attempted"), F.col("outcome"))).alias("outcome"))
    return both.groupBy("tool", "event", "outcome").agg(F.count(F.lit(1)).alias("n"))


def diagnostics_pivot(counts: DataFrame, outcomes: list[str]) -> DataFrame:
    return counts.groupBy("tool", "event").pivot("outcome", outcomes).agg(F.sum("n"))


def latest_session(facts: DataFrame) -> DataFrame:
    return facts.agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))


def status_line(facts: DataFrame) -> DataFrame:
    """(session_id, line): model, context share and saved tokens; parts without a value are left out."""
    total = facts.groupBy("session_id").agg(F.first("model").alias("model"), F.max("context_percent").alias("ctx"), F.sum(saved()).alias("s"))
    tokens = T.est_tokens(F.col("s"))
    short = F.when(tokens >= 1000, F.concat(T.one_decimal(tokens, 1000), F.lit("k"))).otherwise(tokens.cast("string"))
    parts = F.concat_ws(" | ", F.col("model"), F.when(F.col("ctx").isNotNull(), F.concat(F.lit("ctx "), F.col("ctx").cast("string"), F.lit("%"))), F.when(tokens > 0, F.concat(F.lit("skein -"), short, F.lit(" tok"))))
    return total.select("session_id", parts.alias("line"))


def recovery_rows(results: DataFrame, max_files: int, mode: str = "lossy", min_bytes: float = K.TEE_MIN_BYTES) -> DataFrame:
    """Originals that are worth keeping, the newest ``max_files`` of each session.

    ``results``: session_id, use_id, seq, original, lossy, failed.
    """
    if mode == "never" or max_files <= 0:
        return results.limit(0)
    worth = results.where(F.col("lossy") & (F.octet_length("original") >= min_bytes))
    worth = worth.where("failed") if mode == "failures" else worth
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"), F.desc("use_id"))
    return worth.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max_files)


def recovery_path(session: Column, use: Column) -> Column:
    """Percent-encoded path of a kept original: as in URI components, and dots too."""
    changes = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), (".", "%2E"))
    enc = lambda c: reduce(lambda x, change: F.replace(x, F.lit(change[0]), F.lit(change[1])), changes, F.url_encode(c))
    return F.concat(enc(session), F.lit("/"), enc(use), F.lit(".log"))


def csv_rows(days: DataFrame) -> DataFrame:
    """Rows of the day report as CSV lines, with a header that sorts first."""
    line = F.concat_ws(",", F.col("day").cast("string"), "bytes_in", "bytes_out", "bytes_saved", "events")
    return days.select(F.col("day").cast("string").alias("at"), line.alias("line"))


def diagnostics_listing(counts: DataFrame) -> DataFrame:
    """(tool, event, line): the counters of each tool and event as one line, to be shown in the order of tool and event."""
    some = counts.where("n > 0").groupBy("tool", "event").agg(F.array_sort(F.collect_list(F.struct("outcome", "n"))).alias("all"))
    values = F.array_join(F.transform("all", lambda x: F.concat(x["outcome"], F.lit(" "), x["n"].cast("string"))), ", ")
    return some.select("tool", "event", F.concat(F.lit("  "), F.rpad("tool", F.greatest(F.lit(6), F.length("tool")), F.lit(" ")), F.lit(" "), F.rpad("event", F.greatest(F.lit(18), F.length("event")), F.lit(" ")), F.lit(" "), values).alias("line")).orderBy("tool", "event")


def named_session(facts: DataFrame, name: str) -> DataFrame:
    """Facts of one session, by a name that may hold more than an id can."""
    return facts.where(F.col("session_id") == F.regexp_replace(F.lit(name), "[^A-Za-z0-9_-]", ""))
