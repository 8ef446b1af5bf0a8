"""Exact dedup by a cuckoo-filter index over live digests.

Texts are equal when identical after lower-casing A-Z only; the digest is the
SHA-256 of that text in UTF-8.  Among equal texts the row with the largest
doc_id stays; a null doc_id is less than all others, and where a group has no
other id its rows without one stay.  Rows with null text count as the empty text,
so all of them are copies of each other.  Rows sharing a doc_id and a text are
all reported, and are ``kept`` together when their doc_id is the group's largest;
``unique_documents`` leaves one of them.  An empty table gives an empty result.
Extra columns of the input are ignored by the report and kept by
``unique_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, cut, looked_up, one_row_each, tasks_for, texts, tidy, without
from skein.llm.textops import LOWER, by_size, text_bytes

SLOTS = 4  # of a bucket
KICKS = 128  # moves before the index counts as full
LIVE = 250_000  # digests that a task holds
BROADCAST_GROUPS = 200_000  # groups of equal texts that may be broadcast


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints beside the bucketed full keys.

    The filter answers most absent keys from its fingerprints alone.  A
    fingerprint hit is only a hint: it is verified against the full keys stored
    for the same bucket slot.  Keys can be inserted and deleted; when an
    insertion finds no place after ``KICKS`` moves the table doubles and is
    filled again from the stored keys.
    """

    def __init__(self, buckets: int = 64) -> None:
        self._make(buckets)
        self.size = 0
        self.resizes = 0
        self.false_hits = 0

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[] for _ in range(buckets)]
        self.content: list[list[tuple[bytes, object]]] = [[] for _ in range(buckets)]

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> object | None:
        """The value stored with the key, after verification; else None."""
        mark, one, two = self._place(key)
        for bucket in (one, two):
            prints = self.prints[bucket]
            if mark in prints:
                for k, value in self.content[bucket]:
                    if k == key:
                        return value
                self.false_hits += 1
        return None

    def delete(self, key: bytes) -> bool:
        """Takes a live key out; False if it isn't there."""
        mark, one, two = self._place(key)
        for bucket in (one, two):
            for slot, (k, _) in enumerate(self.content[bucket]):
                if k == key:
                    del self.content[bucket][slot], self.prints[bucket][slot]
                    self.size -= 1
                    return True
        return False

    def insert(self, key: bytes, value: object) -> None:
        """Adds a key that isn't in the index; doubles the table when it is full."""
        entry = self._try(key, value)
        while entry is not None:
            entry = self._grow(entry)
        self.size += 1

    def _try(self, key: bytes, value: object) -> tuple[bytes, object] | None:
        mark, one, two = self._place(key)
        for bucket in (one, two):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(mark)
                self.content[bucket].append((key, value))
                return None
        bucket = two
        for k in range(KICKS):
            slot = k % SLOTS
            old_mark, old = self.prints[bucket][slot], self.content[bucket][slot]
            self.prints[bucket][slot], self.content[bucket][slot] = mark, (key, value)
            mark, (key, value) = old_mark, old
            bucket = self._other(bucket, mark)
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(mark)
                self.content[bucket].append((key, value))
                return None
        return key, value

    def _grow(self, homeless: tuple[bytes, object]) -> tuple[bytes, object] | None:
        stored = [*self.items(), homeless]
        buckets = 2 * (self.mask + 1)
        while True:
            self._make(buckets)
            self.resizes += 1
            if all(self._try(*entry) is None for entry in stored):
                return None
            if buckets > 4096 * len(stored):
                raise ValueError("keys of a cuckoo index must be digests: too many of these begin alike")
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All live keys with their values."""
        for bucket in self.content:
            yield from bucket


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, "text"):
        raw, offs = text_bytes(b.column(1))
        low = np.take(LOWER, raw).tobytes()
        at = offs.tolist()
        found = [hashlib.sha256(low[at[k] : at[k + 1]]).digest() for k in range(b.num_rows)]
        yield pa.record_batch([b.column(0), pa.array(found, pa.binary()), *b.columns[2:]], ["doc_id", "digest", *b.schema.names[2:]])


def _index(most: int | None = None):
    """Rows (digest, keep_id, group_size) of live digests: partial groups in, merged groups out.

    With ``most`` an index that holds so many digests is written out and begun anew,
    which is enough where the groups meet once more.
    """

    def rows(live: CuckooIndex) -> Iterator[pa.RecordBatch]:
        found = live.items()
        while part := list(islice(found, 20_000)):
            yield pa.record_batch(
                [pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
                ["digest", "keep_id", "group_size"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for b in batches:
            for key, doc, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                held = live.find(key)
                if held is not None:  # the superseded digest leaves the index, its successor enters
                    live.delete(key)
                    doc = held[0] if doc is None else doc if held[0] is None else max(doc, held[0])
                    n += held[1]
                elif most and live.size >= most:
                    yield from rows(live)
                    live = CuckooIndex()
                live.insert(key, (doc, n))
        yield from rows(live)

    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, digest) that are live after changes (doc_id, digest, raw, removed), which come in order."""
    live = CuckooIndex()
    for b in batches:
        for doc, digest, removed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            key = hashlib.sha256(digest + (b"" if doc is None else doc.to_bytes(8, "little", signed=True))).digest()
            if removed:
                live.delete(key)
            elif live.find(key) is None:
                live.insert(key, (doc, digest))
    found = live.items()
    while part := [v for _, v in islice(found, 20_000)]:
        yield pa.record_batch([pa.array([d for d, _ in part], pa.int64()), pa.array([x for _, x in part], pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, xxhash64 of the text as it stands) of every row."""
    return texts(docs).withColumn("raw", F.xxhash64("text")).mapInArrow(_digest, "doc_id long, digest binary, raw long")


def groups(digested: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size), one row for each distinct text.

    Each input partition first merges its own rows in a cuckoo index, so a hot
    group sends at most a few rows from each partition; the partial groups then
    meet by digest in a second index.  There are as many of those as the rows need.
    """
    schema = "digest binary, keep_id long, group_size long"
    rows = digested.select("digest", "doc_id", F.lit(1).cast("long").alias("n"))
    local = rows.mapInArrow(_index(LIVE), schema)
    n = tasks_for(digested.sparkSession, digested.count(), LIVE)
    return local.repartition(n, "digest").mapInArrow(_index(), schema)


def _decided(docs: DataFrame) -> DataFrame:
    seen = cut(digests(docs), "digests")
    shared = cut(groups(seen).where("group_size > 1"), "groups")  # any other text is its own group
    met = looked_up(seen, shared, "digest", BROADCAST_GROUPS)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    met = met.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return met.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


@tidy
def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@tidy
def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows, all columns, that stay: one of each group, also of rows that share doc_id and text or have no doc_id."""
    decided = cut(_decided(docs).select(F.col("doc_id").alias("id"), "raw", "digest", "kept"), "decided")
    # of kept rows that differ in the case of letters alone, or in nothing, one stays
    kept = decided.where("kept").groupBy("digest").agg(F.min(F.struct("id", "raw")).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = cut(kept, "kept")
    rivals = decided.where("kept").join(kept.hint("merge"), "digest").where(F.col("raw") != F.col("one.raw")).select("id", "raw")
    gone = decided.where("not kept").select("id", "raw").unionByName(rivals)
    return one_row_each(without(docs, gone), kept.select("one.id", "one.raw"))


@tidy
def live_groups(changes: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) of the texts that are live after ``changes``.

    ``changes`` has doc_id, text, seq (the order of changes) and removed (boolean; null: false).  A removed row
    takes its digest out of the index; what isn't there can't be removed; a row that is added twice is there once.
    Rows are dealt out by digest and doc_id, so the copies of a hot text spread over all tasks.
    """
    bounded_batches(changes.sparkSession)
    rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("seq").cast("long").alias("raw"), F.coalesce(F.col("removed"), F.lit(False)).alias("removed"))
    seen = cut(rows.mapInArrow(_digest, "doc_id long, digest binary, raw long, removed boolean"), "changes")
    n = tasks_for(changes.sparkSession, seen.count(), LIVE)
    live = seen.repartition(n, "digest", "doc_id").sortWithinPartitions("raw").mapInArrow(_live, "doc_id long, digest binary")
    return groups(cut(live, "live")).select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")
