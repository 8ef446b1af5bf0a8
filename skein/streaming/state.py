"""Streaming twins: the read cache as keyed state, the ledger as an idempotent merge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.config import Config
from skein.operators.reads import with_facts
from skein.streaming.history import History

OUT = "session_id string, path string, seq long, op string, hit boolean, source string, header_lines int"
STATE = "version int, hash string, header_lines int, source string"
VERSION = 1


def valid(held: tuple) -> bool:
    """Whether a state is of this version and whole; any other counts as none."""
    return len(held) == 4 and held[0] == VERSION and isinstance(held[1], str) and held[3] in ("Read", "Edit", "Write")


def follower(keep_ms: int = 0):
    """Events of one (session, path) in the order of seq; the state is the last setter, dropped ``keep_ms`` after the last event (0: never)."""

    def follow(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists and valid(tuple(state.get)) else None
        rows = []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            touches = e.can_touch and (e.op != "Edit" or held is not None)
            hit = bool(touches and e.op == "Read" and held is not None and held[1] == e.hash)
            rows.append((key[0], key[1], e.seq, e.op, hit, held[3] if held else None, held[2] if held else None))
            if touches and not hit:
                held = (VERSION, e.hash, int(e.n_lines), e.op)
        if held is not None:
            state.update(tuple(held))
            if keep_ms:
                state.setTimeoutDuration(keep_ms)
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(rows, columns=["session_id", "path", "seq", "op", "hit", "source", "header_lines"])
        frame["header_lines"] = frame["header_lines"].astype("Int32")
        yield frame

    return follow


def read_cache_stream(events: DataFrame, config: Config = Config(), keep_ms: int = 0) -> DataFrame:
    """The read cache over an unbounded stream of events; one small state for each (session, path)."""
    facts = with_facts(events, config).select("session_id", "path", "seq", "op", "hash", "n_lines", "can_touch")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return facts.groupBy("session_id", "path").applyInPandasWithState(follower(keep_ms), OUT, STATE, "append", timeout)


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works off what is there and stops; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


class LedgerMerge:
    """A foreachBatch sink that adds daily marginals to a history; a batch that comes again adds nothing.

    ``compact`` folds the batches so far into one base; it deletes nothing, ``history.expire`` does.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.history = History(spark, folder)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.history.add(batch, "merge", batch_id)

    def read(self) -> DataFrame:
        """The marginals so far; none before the first batch."""
        return self.history.read()

    def compact(self, as_of: dt.date | None = None) -> None:
        """One base in place of the batches, of the days that are still kept at ``as_of``."""
        self.history.compact(as_of)


def daily_windows(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily tumbling sums by tool over a stream with a ``ts``; in update or append mode days older than ``late`` leave the state."""
    return facts.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "tool").agg(F.count(F.lit(1)).alias("events"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")).select(F.to_date("w.start").alias("day"), "tool", "events", "bytes_in", "bytes_out")


def windows_to_table(windows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the sums that a batch changed to a folder of the batch; a batch that comes again writes it anew."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """The sums of each day and tool as the last batch that changed them left them."""
    rows = spark.read.parquet(out)
    sums = F.struct("events", "bytes_in", "bytes_out")
    return rows.groupBy("day", "tool").agg(F.max_by(sums, "batch").alias("s")).select("day", "tool", "s.*")
