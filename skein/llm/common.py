"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000  # ids of a list that may be broadcast; a longer one is shuffled
BATCH_BYTES = 8 << 20  # of the rows that pass to Python at once
HEAP_SHARE = 0.5  # of the driver's heap that may be taken before a step's garbage is collected


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests) gets a local folder; on
    a cluster that is an error, as executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        ctx = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = ctx.get() if ctx.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "skein-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []  # folders that cut() made and tidy() hasn't deleted


def cut(df: DataFrame, what: str = "step", **options: str) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads them again.

    A lost executor then costs a re-read of files that all machines see.  ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Collects the driver's garbage once its heap has taken its share.

    The plans, task metrics and shuffles behind a written table are garbage, but
    a heap rather grows to its limit than collects them; collected, it shrinks
    again, and Spark deletes the files of their shuffles.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def written() -> int:
    """A mark for ``sweep``: how many tables stand by now."""
    return len(_written)


def folders_read(df: DataFrame) -> Iterator[str]:
    """The folders that the leaves of a plan read; their files, which may be a great many, stay unlisted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for k in range(leaves.size()):
        if leaves.apply(k).getClass().getSimpleName() == "LogicalRelation":
            relation = leaves.apply(k).relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                roots = relation.location().rootPaths()
                yield from (roots.apply(j).toString().rstrip("/") for j in range(roots.size()))


def sweep(result: DataFrame, since: int) -> None:
    """Deletes the tables written since a mark, but for those that ``result`` reads.

    What it reads has been written whole by then, so nothing that is deleted
    would be needed again if an executor were lost.
    """
    own, _written[since:] = _written[since:], []
    read = {path.rsplit("/", 1)[-1] for path in folders_read(result)} if own else set()
    for path in own:
        if path.rsplit("/", 1)[1] in read:
            _written.append(path)
        else:
            delete(result.sparkSession, path)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deletes the tables that an operator wrote on its way and its result doesn't read."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        since = written()
        result = operator(*args, **kwargs)
        sweep(result, since)
        return result

    return run


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle that this code deals out itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions of a shuffle whose tasks hold their rows: never over ``most`` each on average, however many rows there
    are, and a tenth of that as long as so many smaller tasks stay in the thousands."""
    each = min(most, max(most // 10, rows // 10_000))
    return max(partitions(spark), -(-rows // each))


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """Rows of a written table with the greatest counts, ``most`` at most: all above a bound that a histogram gives.

    Counts go to some hundred classes of a like size each, and whole classes are taken; no task merges the
    first rows of all others, as a sort with a limit would.
    """
    size = F.floor(F.log2(F.col(column).cast("double")) * 32)
    found, left = None, most
    for k, n in sorted(((r["k"], r["n"]) for r in counts.groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        found = k
    return counts.where(F.lit(False)) if found is None else counts.where(size >= found)


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows whose doc_id has the least hashes.

    Of many rows those beyond a hash that some four times as many stay under go first, so the sort gets few from each partition.
    """
    n, key = rows.count(), F.xxhash64("doc_id")
    if n > 8 * most:
        rows = rows.where(key < int(-(2**63) + 2**64 * 4 * most / n))
    return rows.orderBy(key, "doc_id").limit(most)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes, so that long texts don't add up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of all rows, whatever else the table holds."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keep_rows(docs: DataFrame, mask: Callable[[pa.Array], np.ndarray], limit: int = 2 << 20) -> DataFrame:
    """The rows of a table, all columns, whose text ``mask`` keeps; nothing is shuffled."""
    from skein.llm.textops import by_size

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", limit):
            yield b.filter(pa.array(mask(b.column(b.schema.get_field_index("text"))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def looked_up(rows: DataFrame, table: DataFrame, key: str, most: int = BROADCAST_IDS, how: str = "left") -> DataFrame:
    """Rows joined with a written table that has one row for each key.

    A table of at most ``most`` rows is broadcast, so a key with very many rows goes nowhere.  Beyond it both sides are
    plain exchanges, and adaptive execution splits the partition of such a key.
    """
    return rows.join(F.broadcast(table) if table.count() <= most else table.hint("merge"), key, how)


NO_ID = -(2**63)  # stands for a null doc_id in joins


def text_key(docs: DataFrame) -> list[Column]:
    """What tells rows apart: doc_id, and xxhash64 of the text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(docs["text"].cast("string"))]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a table whose (doc_id, xxhash64 of the text) isn't in ``gone`` (columns id, raw)."""
    gone = cut(gone.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "raw").distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    own, raw = text_key(docs)
    return docs.join(F.broadcast(gone) if small else gone, (own == gone["id"]) & (raw == gone["raw"]), "left_anti")


def one_row_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The table with one row only of each (doc_id, xxhash64 of the text) that ``repeated`` (columns id, raw) names.

    All other rows pass without a shuffle, and where nothing is repeated the table stays as it is.
    """
    named = cut(repeated.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "raw").distinct(), "repeated")
    n = named.count()
    if not n:
        return docs
    own, raw = text_key(docs)
    side = F.broadcast(named) if n <= BROADCAST_IDS else named
    same = (own == named["id"]) & (raw == named["raw"])
    some = docs.join(side, same, "left_semi")
    # each partition keeps one row of a key before rows meet
    columns = [F.first(some[c]).alias(c) for c in some.columns]
    taken = {c.lower() for c in docs.columns}
    free = [next(name for n in range(len(taken) + 1) if (name := f"_key{i}_{n}") not in taken) for i in (0, 1)]  # names that no column has
    one = some.groupBy(*(k.alias(name) for name, k in zip(free, text_key(some)))).agg(*columns).drop(*free)
    return docs.join(side, same, "left_anti").unionByName(one.select(*(f"`{c}`" for c in docs.columns)))
