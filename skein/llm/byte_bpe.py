"""Byte-level BPE: ids of whole texts by a table of ranks, and back.

A text is split by a pattern; a match that is a token is that token, any other
is merged pair by pair, always the pair of the least rank and of equals the
leftmost.  The pairs wait in a rank queue: a bucket for each rank holds places
of a linked list over the match's bytes, two levels of bitmaps tell by
find-first-set which bucket is next, and an entry whose pair has changed since
is skipped when it comes up.  A match of n bytes takes some n log n steps and
about 60 bytes of memory a byte, so matches of megabytes are no special case.

Null texts are empty and have no ids.  Rows stay one for one, repeated ones and
null doc_ids included.  Ids are kept as little-endian unsigned 32-bit integers in
one binary; ``id_arrays`` gives them as arrays.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from skein.llm.common import bounded_batches, texts
from skein.llm.textops import by_size

REMEMBERED = 250_000  # matches of a generation whose ids a worker remembers
REMEMBERED_CHARS = 40  # of the longest of them
LONG = 1 << 18  # characters of a text from which its matches are made a share at a time
SHARE = 1 << 16  # matches
TEXT_BYTES = 2 << 20  # of texts that a worker holds at once
BIT = [1 << k for k in range(1 << 13)]  # for two million ranks


def _join(buckets: dict, rank: int, place: int) -> None:
    """Adds a place to a bucket that has one."""
    bucket = buckets[rank]
    if bucket.__class__ is int:
        buckets[rank] = [bucket, place] if bucket < place else [place, bucket]
    else:
        heappush(bucket, place)


class Vocabulary(dict):
    """Ids of a match's text, as bytes; a dict that remembers two generations of short matches, each of bounded number."""

    def __init__(self, raw: bytes) -> None:
        """``raw`` is a rank file: a line for each token, base64 and rank."""
        pairs = (line.split() for line in raw.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes, so some texts would have no ids")
        most = max(self.ranks.values())
        self.tokens: list[bytes | None] = [None] * (most + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.two = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.leaf = [0] * (most // 256 + 1)  # bitmaps of the ranks that have a bucket; all zero between matches
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.merged(piece.encode())
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> bytes:
        """Ids of one match."""
        rank_of, leaf, n = self.ranks.get, self.leaf, len(piece)
        own = rank_of(piece)
        if own is not None:
            return own.to_bytes(4, "little")
        kind = (lambda r: array("i", r)) if n > 4096 else list
        after, before = kind(range(1, n + 1)), kind(range(-1, n - 1))  # tokens as a linked list over their first bytes
        pair = kind([-1]) * n  # rank of the pair that begins at a token, as it stands now
        buckets: dict[int, int | list[int]] = {}  # by rank one place, or a heap of places
        top, two = 0, self.two  # a bit for each leaf that isn't zero
        for i in range(n - 1):
            rank = two[piece[i]][piece[i + 1]]
            if rank >= 0:
                pair[i] = rank
                if rank in buckets:
                    _join(buckets, rank, i)
                else:
                    buckets[rank] = i
                    leaf[rank >> 8] |= BIT[rank & 255]
                    top |= BIT[rank >> 8]
        while top:
            at = (top & -top).bit_length() - 1
            bits = leaf[at]
            least = at << 8 | (bits & -bits).bit_length() - 1
            i = buckets[least]
            if i.__class__ is int or len(i) == 1:
                if i.__class__ is list:
                    i = i[0]
                del buckets[least]
                leaf[at] = bits = bits & bits - 1
                if not bits:
                    top &= top - 1
            else:
                i = heappop(i)
            if pair[i] != least:
                continue  # stale
            j = after[i]
            after[i] = k = after[j]
            pair[j] = pair[i] = -1
            if k < n:  # the pair that the new token begins
                before[k] = i
                rank = rank_of(piece[i : after[k]])
                if rank is not None:
                    pair[i] = rank
                    if rank in buckets:
                        _join(buckets, rank, i)
                    else:
                        buckets[rank] = i
                        leaf[rank >> 8] |= BIT[rank & 255]
                        top |= BIT[rank >> 8]
            i = before[i]
            if i >= 0:  # the pair that it ends
                rank = rank_of(piece[i:k])
                if rank is None:
                    pair[i] = -1
                else:
                    pair[i] = rank
                    if rank in buckets:
                        _join(buckets, rank, i)
                    else:
                        buckets[rank] = i
                        leaf[rank >> 8] |= BIT[rank & 255]
                        top |= BIT[rank >> 8]
        out, i = array("I"), 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encoded(self, text: str, pattern: regex.Pattern) -> bytes:
        """Ids of a text: those of each match of the pattern."""
        if len(text) < LONG:
            return b"".join(map(self.__getitem__, pattern.findall(text)))
        matches, out = (m.group() for m in pattern.finditer(text)), bytearray()
        while share := list(islice(matches, SHARE)):
            out += b"".join(map(self.__getitem__, share))
        return bytes(out)

    def decoded(self, ids: bytes) -> bytes | None:
        """The bytes of ids; None where one is no token."""
        numbers, out = np.frombuffer(ids, "<u4"), bytearray()
        try:
            for first in range(0, len(numbers), SHARE):
                out += b"".join(map(self.tokens.__getitem__, numbers[first : first + SHARE].tolist()))
        except (IndexError, TypeError):
            return None
        return bytes(out)


@lru_cache(maxsize=2)
def _vocabulary(raw: bytes) -> Vocabulary:
    """One for a worker's life, so that matches stay remembered between tasks."""
    return Vocabulary(raw)


def _shared_ranks(df: DataFrame, path: str):
    """The rank file, read on the driver and broadcast; its size is that of the vocabulary, whatever the input."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text by the rank file at ``path`` (one the driver can open)."""
    shared = _shared_ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = _vocabulary(shared.value), regex.compile(pattern)
        for b in by_size(batches, "text", TEXT_BYTES):
            ids = (vocabulary.encoded(t.as_py() or "", split) for t in b.column(1))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns and ``decoded``: the bytes of the ids, null where ids are null or not of the vocabulary."""
    shared = _shared_ranks(encoded, path)
    bounded_batches(encoded.sparkSession)
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for b in batches:
            back = (None if not x.is_valid else vocabulary.decoded(x.as_py()) for x in b.column(at))
            yield pa.record_batch([*b.columns, pa.array(back, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def id_arrays(encoded: DataFrame) -> DataFrame:
    """The rows with ``ids`` as an array of longs."""
    bounded_batches(encoded.sparkSession)
    at, names = encoded.columns.index("ids"), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [None if not x.is_valid else np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array(lists, pa.list_(pa.int64()))
            yield pa.record_batch(columns, names)

    kinds = ", ".join(f"`{f.name}` {'array<long>' if f.name == 'ids' else f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, kinds)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text encoded and decoded again."""
    rows = decode(encode(docs, path, pattern), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
