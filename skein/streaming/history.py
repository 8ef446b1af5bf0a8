"""The history of savings as snapshots: a commit is one manifest, which names the folders whose rows count."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.ledger import marginals, retained
from skein.sources.tables import HISTORY_SCHEMA, merge_history


class History:
    """Daily marginals that several writers add to while others read.

    Rows are written to a folder of their own, which counts once a manifest names it.  Manifests are numbered, and each is
    moved to a name that must not exist yet: of two writers one wins, the other makes its manifest anew from the winner's.
    A reader keeps to the manifest it began with.  Only ``expire`` deletes, and only what no kept manifest names.

    The file system must refuse to move a file onto another (HDFS, local disks); on an object store that doesn't, use one writer.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.fs = spark, spark._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        where = self.fs.Path(folder)
        self.files = where.getFileSystem(self.conf)
        self.folder = self.files.makeQualified(where).toString().rstrip("/")

    def _path(self, name: str):
        return self.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """The kept manifests by number; none before the first commit."""
        log = self._path("log")
        names = [s.getPath().getName() for s in self.files.listStatus(log)] if self.files.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict:
        """The folders of a version (``parts``) and the last batch of each writer in it (``done``)."""
        if not version:
            return {"parts": [], "done": {}}
        stream = self.files.open(self._path(f"log/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _placed(self, version: int, manifest: dict) -> bool:
        """Whether the manifest became this version; False if another was there first."""
        draft, final = self._path(f"log/.draft-{uuid.uuid4().hex}"), self._path(f"log/{version:020d}.json")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self.files.getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                plain = self.spark.sparkContext._gateway.new_array(self.fs.Options.Rename, 0)
                self.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(draft, final, plain)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if not self.files.exists(final) or "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self.files.delete(draft, False)
        return True

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Applies a change to the newest manifest until it stands or isn't called for any more; the version then."""
        while True:
            version = max(self.versions(), default=0)
            new = change(self.manifest(version))
            if new is None:
                return version
            if self._placed(version + 1, new):
                return version + 1

    def _written(self, rows: DataFrame) -> str:
        part = f"data/{uuid.uuid4().hex}"
        rows.select(*(c.split()[0] for c in HISTORY_SCHEMA.split(", "))).write.parquet(f"{self.folder}/{part}")
        return part

    def add(self, rows: DataFrame, writer: str = "", batch: int | None = None) -> int:
        """Adds marginals; a batch of a writer that is in already, or comes before one that is, adds nothing."""
        done = lambda m: batch is not None and batch <= m["done"].get(writer, -1)
        now = max(self.versions(), default=0)
        if done(self.manifest(now)):
            rows.write.format("noop").mode("overwrite").save()  # a stream's state goes on only with rows that are worked off
            return now
        part = self._written(rows)

        def change(m: dict) -> dict | None:
            if done(m):
                return None
            return {"parts": [*m["parts"], part], "done": m["done"] if batch is None else {**m["done"], writer: batch}}

        version = self._commit(change)
        if part not in self.manifest(version)["parts"]:  # another run of the same batch was first
            self.files.delete(self._path(part), True)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The marginals of a version (the newest), whatever is added or compacted after this call."""
        parts = self.manifest(max(self.versions(), default=0) if version is None else version)["parts"]
        empty = self.spark.createDataFrame([], HISTORY_SCHEMA)
        return merge_history(self.spark.read.schema(HISTORY_SCHEMA).parquet(*(f"{self.folder}/{p}" for p in parts)), empty) if parts else empty

    def compact(self, as_of: dt.date | None = None) -> int:
        """One folder in place of all there are now, of the days still kept at ``as_of``; what comes in meanwhile stays beside it.

        Where another compaction is first, this one changes nothing.
        """
        version = max(self.versions(), default=0)
        old = self.manifest(version)["parts"]
        if not old:
            return version
        rows = self.read(version)
        part = self._written(rows if as_of is None else retained(rows, as_of))

        def change(m: dict) -> dict | None:
            return {**m, "parts": [part, *(p for p in m["parts"] if p not in set(old))]} if set(old) <= set(m["parts"]) else None

        version = self._commit(change)
        if part not in self.manifest(version)["parts"]:
            self.files.delete(self._path(part), True)
        return version

    def expire(self, keep: int = 2) -> None:
        """Forgets all but the newest ``keep`` versions; their folders go where no kept version names them.

        Folders go before the manifests that name them, so what a lost driver leaves is found by the next call.
        """
        versions = self.versions()
        kept = {p for v in versions[-max(keep, 1) :] for p in self.manifest(v)["parts"]}
        for v in versions[: -max(keep, 1)]:
            for part in set(self.manifest(v)["parts"]) - kept:
                self.files.delete(self._path(part), True)
            self.files.delete(self._path(f"log/{v:020d}.json"), False)


def once_each(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """Facts (event_id, ts, ...) that may be delivered again within ``late`` of each other, once each.

    State is kept for ``late`` only.  Facts without an id are all taken; those without a time are left out.
    """
    named = facts.where("ts is not null").withColumn("delivery", F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("-"), F.uuid())))
    return named.withWatermark("ts", late).dropDuplicatesWithinWatermark(["delivery"]).drop("delivery")


def ledger_stream(facts: DataFrame, history: History, checkpoint: str, late: str = "1 day", writer: str = "stream") -> StreamingQuery:
    """A stream of facts into the history, each event once: repeated events by their ids, repeated batches by their numbers.

    ``writer`` names the checkpoint; a stream with a new checkpoint needs a new name.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        history.add(marginals(batch), writer, batch_id)

    return once_each(facts, late).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
