"""A Python data source that reads files by ranges of bytes.

``skein_line_counts`` counts the newlines of each file's first bytes and stops
there; ``skein_blocks`` gives a file as blocks of whole lines, of any size: large
ranges of bytes are read by a task of their own, small ones many to a task.  Files are found through pyarrow's file
systems (local, HDFS, S3, GCS by URI); a list of paths, not the files, passes
through the driver.  Register them with ``register(spark)``.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions import fixed as K

STEP = 64 * 1024  # bytes read at once
TASK_BYTES = 64 << 20  # that the files of one task may take; a file is read by one task at most this far
TASK_FILES = 1000
BLOCK_BYTES = 16 << 20
TASKS = 64  # at least, where ranges are read many to a task and there are as many
TOGETHER = 1 << 20  # bytes of blocks that leave a task together


def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if not urlsplit(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path within the file system, size) of all files under a folder, or of one file, in order."""
    from pyarrow import fs

    where, root = file_system(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
    own = [(f.path, f.size) for f in found if f.type == fs.FileType.File]
    return sorted((p, n) for p, n in own if fnmatch(posixpath.basename(p), pattern) and not posixpath.basename(p).startswith(("_", ".")))


@dataclass
class Files(InputPartition):
    """Files for a task."""

    files: list[tuple[str, int]]


@dataclass
class Ranges(InputPartition):
    """(path, size, first, end) for a task: ranges of a file by their numbers, ``end`` left out."""

    files: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")

    def files(self) -> list[tuple[str, int]]:
        return listed(self.path, self.pattern)


class _Counts(_Reader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.most = int(options.get("maxbytes", K.COUNT_CAP_BYTES))

    def partitions(self) -> list[Files]:
        """Small files are read many to a task, by the bytes that are read of them."""
        out: list[Files] = []
        room = 0
        for path, size in self.files():
            if not out or room < min(size, self.most) or len(out[-1].files) >= TASK_FILES:
                out.append(Files([]))
                room = TASK_BYTES
            out[-1].files.append((path, size))
            room -= min(size, self.most)
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(self.path)
        rows = []
        for path, size in partition.files:
            done = newlines = 0
            with where.open_input_file(path) as f:
                while done < min(size, self.most):
                    got = f.read(min(STEP, self.most - done))
                    if not got:
                        break
                    done += len(got)
                    newlines += got.count(b"\n")
            rows.append((path, size, newlines + 1, done))
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["path", "size", "n_lines", "bytes_read"])


class _Blocks(_Reader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.size = max(1, int(options.get("blockbytes", BLOCK_BYTES)))

    def partitions(self) -> list[Ranges]:
        """As many ranges to a task as make up a large block, fewer where that leaves few tasks."""
        files = self.files()
        each = max(1, min(BLOCK_BYTES, sum(n for _, n in files) // TASKS) // self.size)
        out: list[Ranges] = []
        room = 0
        for path, size in files:
            n, at = -(-size // self.size), 0
            while at < n:
                if not room:
                    out.append(Ranges([]))
                    room = each
                end = min(n, at + room)
                out[-1].files.append((path, size, at, end))
                room -= end - at
                at = end
        return out or [Ranges([])]

    def block(self, f, first: int, last: int) -> bytearray | None:
        """The lines that begin in the range: from behind its first newline (that of the byte before counts) to the end of its last line."""
        at = max(0, first - 1)
        f.seek(at)
        got = bytearray()
        while at + len(got) < last:
            more = f.read(min(STEP, last - at - len(got)))
            if not more:
                break
            got += more
        start = got.find(b"\n", 0, last - 1 - at) + 1 if first else 0
        if first and not start:  # no line begins in the range
            return None
        while not got.endswith(b"\n"):  # the last line may end in a later range
            more = f.read(STEP)
            if not more:
                got += b"\n"  # the file's end ends its last line
                break
            stop = more.find(b"\n")
            got += more if stop < 0 else more[: stop + 1]
            if stop >= 0:
                break
        return got[start:]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(self.path)
        rows: list[tuple[str, int, str]] = []
        held = 0
        for path, size, begin, end in partition.files:
            with where.open_input_file(path) as f:
                for k in range(begin, end):
                    got = self.block(f, k * self.size, min(size, (k + 1) * self.size))
                    if got is None:
                        continue
                    rows.append((path, k, got.decode("utf-8", "replace")))
                    held += len(got)
                    if held >= TOGETHER:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["id", "seq", "text"])


class LineCounts(DataSource):
    """(path, size, n_lines, bytes_read): newlines and one in the first ``maxBytes`` of each file."""

    @classmethod
    def name(cls) -> str:
        return "skein_line_counts"

    def schema(self) -> str:
        return "path string, size long, n_lines long, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _Counts({k.lower(): v for k, v in self.options.items()})


class Blocks(DataSource):
    """(id, seq, text): files as blocks of whole lines of about ``blockBytes``; ``id`` is the path."""

    @classmethod
    def name(cls) -> str:
        return "skein_blocks"

    def schema(self) -> str:
        return "id string, seq long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Blocks({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    for source in (LineCounts, Blocks):
        spark.dataSource.register(source)


def line_counts(spark: SparkSession, path: str, pattern: str = "*", most: int = K.COUNT_CAP_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format(LineCounts.name()).option("pattern", pattern).option("maxBytes", most).load(path)


def file_blocks(spark: SparkSession, path: str, pattern: str = "*", size: int = BLOCK_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format(Blocks.name()).option("pattern", pattern).option("blockBytes", size).load(path)
