"""The read cache as state of a session: a map of its paths, seeded from a table and read back as one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from skein.config import Config
from skein.operators.reads import read_cache, with_facts
from skein.streaming.state import OUT, STATE, VERSION, valid

SETTINGS = {"provider": "spark.sql.streaming.stateStore.providerClass", "empty_batches": "spark.sql.streaming.noDataMicroBatches.enabled"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the paths of a session are dealt to, so that the reads of a busy session have several tasks.
SLOTS = 16
HELD = "session_id string, path string, hash string, header_lines int, source string"


def _slot(slots: int) -> Column:
    return F.pmod(F.hash("path"), F.lit(slots)).alias("slot")


class _Paths(StatefulProcessor):
    """Events of some paths of a session; what was last set is held for each path, ``keep_ms`` from then on (0: for ever)."""

    def __init__(self, keep_ms: int = 0) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("reads", "path string", STATE, self.keep_ms or None)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.held.updateValue((r.path,), (VERSION, r.hash, int(r.header_lines), r.source))

    def _value(self, path: str) -> tuple | None:
        found = tuple(self.held.getValue((path,))) if self.held.containsKey((path,)) else None
        return found if found and valid(found) else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now: dict[str, tuple | None] = {}  # the state of the paths of this batch, written once at its end
        changed, out = set(), []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if e.path not in now:
                now[e.path] = self._value(e.path)
            held = now[e.path]
            touches = e.can_touch and (e.op != "Edit" or held is not None)
            hit = bool(touches and e.op == "Read" and held is not None and held[1] == e.hash)
            out.append((key[0], e.path, e.seq, e.op, hit, held[3] if held else None, held[2] if held else None))
            if touches and not hit:
                now[e.path] = (VERSION, e.hash, int(e.n_lines), e.op)
                changed.add(e.path)
        for path in changed:
            self.held.updateValue((path,), now[path])
        frame = pd.DataFrame(out, columns=["session_id", "path", "seq", "op", "hit", "source", "header_lines"])
        frame["header_lines"] = frame["header_lines"].astype("Int32")
        yield frame


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for a while; a stream keeps those that stand when it starts."""
    names = {SETTINGS[k]: v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def last_set(events: DataFrame, config: Config = Config()) -> DataFrame:
    """(session_id, path, hash, header_lines, source) that reads after these events are compared with; columns of HELD."""
    setters = read_cache(events, config).where("touches and not hit")
    last = F.max_by(F.struct("hash", F.col("n_lines").alias("header_lines"), F.col("op").alias("source")), "seq").alias("x")
    return setters.groupBy("session_id", "path").agg(last).select("session_id", "path", "x.*")


def session_reads(events: DataFrame, config: Config = Config(), keep_ms: int = 0, seed: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """The read cache over a stream of events, from the state ``seed`` (columns of HELD) on.

    Events of a path must come in the order of seq from batch to batch; within a batch any order will do.
    ``slots`` belongs to the checkpoint and can't be changed later.  The facts of a slot in one batch are sorted in memory:
    bound the batches (maxFilesPerTrigger, maxBytesPerTrigger) where a session is busy.
    """
    facts = with_facts(events, config).select("session_id", _slot(slots), "path", "seq", "op", "hash", "n_lines", "can_touch")
    first = None if seed is None else seed.select("session_id", _slot(slots), "path", "hash", "header_lines", "source").groupBy("session_id", "slot")
    return facts.groupBy("session_id", "slot").transformWithStateInPandas(_Paths(keep_ms), OUT, "Append", "ProcessingTime" if keep_ms else "None", first)


def session_reads_to_table(reads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Works off what is there and stops; a restart goes on from the checkpoint.

    Maps need the state store on disk.  With a time to live Spark asks for a batch without rows after each batch, so that
    a run never ends; such batches are off here, and what is past its time counts as none without them.
    """
    with _set(reads.sparkSession, provider=ROCKS, empty_batches="false"):
        return reads.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def held_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state that a stream of session reads left in its checkpoint (columns of HELD): a seed for another, or a table to look into."""
    with _set(spark, provider=ROCKS):
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "reads").load()
    value = F.col("user_map_value.value") if "value" in rows.schema["user_map_value"].dataType.names else F.col("user_map_value")
    return rows.select(F.col("key.session_id"), F.col("user_map_key.path"), value["hash"].alias("hash"), value["header_lines"].alias("header_lines"), value["source"].alias("source"))
