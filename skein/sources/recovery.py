"""Recovery copies: originals of reduced texts, the newest of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import TeeOptions
from skein.operators.ledger import recovery_path, recovery_rows
from skein.sources.tables import stored

STORED = "session_id string, use_id string, seq long, original string, path string"
PART = "bucket int"


class RecoveryStore:
    """A table partitioned by buckets of sessions, of which an addition rewrites only the buckets that it touches.

    One writer at a time.  The touched buckets are staged whole before they are put in place; a writer that was lost in
    between is made good by the next one, from what it had staged.  ``buckets`` belongs to the table and can't be changed
    later; a folder for each session would make as many small files as there are sessions.
    """

    def __init__(self, spark: SparkSession, folder: str, options: TeeOptions = TeeOptions(), buckets: int = 64) -> None:
        self.spark, self.folder, self.options, self.buckets = spark, folder.rstrip("/"), options, buckets
        self.staged = f"{self.folder}/_staged"

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _table(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{STORED}, {PART}").parquet(folder)

    def put_staged(self) -> None:
        """Puts in place what stands staged whole, if anything does."""
        if not self._there(f"{self.staged}/_SUCCESS"):
            return
        rows = self._table(self.staged)
        rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.staged)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def read(self) -> DataFrame:
        """What is kept (columns of STORED); nothing before the first addition."""
        return (self._table(self.folder) if self._there(self.folder) else self.spark.createDataFrame([], f"{STORED}, {PART}")).drop("bucket")

    def add(self, results: DataFrame) -> DataFrame:
        """Keeps the originals worth it and drops a session's oldest beyond ``max_files``; (session_id, use_id, path) of the new ones that stay.

        ``results``: session_id, use_id, seq, original, lossy, failed.  Rows without a session or a use have no path and
        aren't kept; of several with one path the one of the greatest seq is, the newly added one where that ties.
        """
        self.put_staged()  # of a writer that was lost
        t = self.options
        named = results.where("session_id <> '' and use_id <> ''")
        worth = recovery_rows(named, t.max_files if t.enabled else 0, t.mode, t.min_bytes).drop("nth")
        path = recovery_path(F.col("session_id"), F.col("use_id"))
        new = worth.select("session_id", "use_id", "seq", "original", path.alias("path"), F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int").alias("bucket"), F.lit(True).alias("fresh"))
        if not self._there(self.folder):
            both = new
        else:
            touched = F.broadcast(new.select("bucket").distinct())  # at most ``buckets`` rows
            both = new.unionByName(self._table(self.folder).join(touched, "bucket", "left_semi").withColumn("fresh", F.lit(False)))
        last = Window.partitionBy("path").orderBy(F.desc("seq"), F.desc("fresh"))
        newest = Window.partitionBy("session_id").orderBy(F.desc("seq"), F.desc("use_id"))
        one = both.withColumn("nth", F.row_number().over(last)).where("nth = 1")
        kept = one.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= t.max_files).drop("nth")
        kept.write.mode("overwrite").parquet(self.staged)
        staged = self.spark.read.schema(f"{STORED}, {PART}, fresh boolean").parquet(self.staged)
        paths = stored(staged.where("fresh").select("session_id", "use_id", "path"), "recovery-paths")
        self.put_staged()
        return paths
