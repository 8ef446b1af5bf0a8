"""Packing documents into token sequences: shortest-pack-first over the length histogram.

Each document is tokenised, closed with an end id and cut into full pieces of
``limit`` ids and one rest.  The histogram of piece lengths - at most ``limit``
rows, whatever the corpus holds - is packed on the driver: lengths go longest
first into the pack with the most room left, and only counts of packing
patterns are kept.  Patterns come back to pieces by rank within the length.
Null text counts as empty (its only id is the end id); repeated rows each get
their own place; an empty table gives an empty result; extra columns are
ignored.  Each id lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, texts, tidy
from skein.llm.textops import by_size, hash_spans, lowered, text_bytes, word_spans

LIMIT = 4096
END = 2
SALTS = 512  # parts of one length in which ranks are counted apart
TOGETHER = 10_000  # words that the tokenizer reads at once
CACHE = 250_000  # words whose ids a worker keeps

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Ids of texts from the ids of their words.

    The tokenizer lower-cases, turns white space into one space and never joins
    across it, so the ids of a text are those of its words in turn; a full stop
    or comma right behind an ASCII letter is always a token of its own.
    """

    def __init__(self, path: str) -> None:
        # workers share the machine already, and threads of a tokenizer keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.marks = {m: self._ids([m])[0] for m in (".", ",")}
        if any(len(v) != 1 for v in self.marks.values()):
            raise ValueError("the tokenizer splits a full stop or comma")
        self.clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _thin(self) -> None:
        """Keeps the more used half of the words."""
        keep = np.zeros(len(self.keys), bool)
        keep[np.argsort(-self.uses, kind="stable")[: CACHE // 2]] = True
        count = self.count[keep]
        first = np.cumsum(count) - count
        self.flat = self.flat[np.repeat(self.first[keep] - first, count) + np.arange(int(count.sum()))]
        self.keys, self.first, self.count, self.uses = self.keys[keep], first, count, self.uses[keep] // 2

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        counts, flats = [], [self.flat]
        for k in range(0, len(texts), TOGETHER):  # the tokenizer's own records of a word are large
            found = self._ids(texts[k : k + TOGETHER])
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            flats.append(np.fromiter((i for ids in found for i in ids), np.uint32, int(counts[-1].sum())))
        count = np.concatenate(counts)
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate(flats)
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count, self.uses = (np.insert(a, spot, b) for a, b in ((self.keys, keys), (self.first, first), (self.count, count), (self.uses, 0)))

    def of(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed with ``end``, and the row pointer."""
        raw, offs = text_bytes(col)
        low = lowered(raw)
        s, e, ptr = word_spans(low, offs)
        last, before = low[e - 1] if len(e) else low[:0], low[np.maximum(e - 2, 0)] if len(e) else low[:0]
        stop = ((last == 46) | (last == 44)) & (e - s >= 2) & (before >= 97) & (before <= 122)
        e = e - stop
        h = hash_spans(low, s, e)
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:  # between batches only, so that a batch finds all its words
            self._thin()
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == keys[inside]
        if not known.all():
            data = low.tobytes()
            new = np.flatnonzero(~known)
            self._learn(keys[new], [data[a:b].decode() for a, b in zip(s[at[new]].tolist(), e[at[new]].tolist())])
            spot = np.searchsorted(self.keys, keys)
        self.uses[spot] += 1
        first, count = self.first[spot][inverse], self.count[spot][inverse]
        total = count + stop
        # the end id takes one place behind each text
        docs = len(ptr) - 1
        sizes = np.add.reduceat(np.concatenate([total, [0]]), ptr[:-1]) if docs else np.zeros(0, np.int64)
        sizes = np.where(np.diff(ptr) > 0, sizes, 0) + 1
        out_ptr = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(out_ptr[-1]), np.uint32)
        out[out_ptr[1:] - 1] = end
        doc = np.repeat(np.arange(docs), np.diff(ptr))
        begin = np.concatenate([[0], np.cumsum(total)[:-1]]) + doc if len(total) else np.zeros(0, np.int64)
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum())) if len(count) else np.zeros(0, np.int64)
        source = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum())) if len(count) else np.zeros(0, np.int64)
        out[place] = self.flat[source]
        if stop.any():
            out[begin[stop] + count[stop]] = np.where(last[stop] == 46, self.marks["."][0], self.marks[","][0])
        return out, out_ptr


_LOADED: dict[str, WordIds] = {}


def _words_of(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _pieces(path: str, limit: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _words_of(path)
        for b in by_size(batches, "text", 2 << 20):
            ids, ptr = coder.of(b.column(1), end)
            data, step = memoryview(ids.astype("<u4").tobytes()), 4
            sizes = np.diff(ptr)
            per = -(-sizes // limit)
            row = np.repeat(np.arange(len(sizes)), per)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * limit
            length = np.minimum(limit, sizes[row] - start)
            first = (ptr[:-1][row] + start) * step
            crc = [zlib.crc32(data[a : a + n]) for a, n in zip(first.tolist(), (length * step).tolist())]
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    rows = texts(docs)
    return rows.mapInArrow(_pieces(tokenizer, limit, end), PIECES)


def pack_histogram(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (number of packs, [(length, repeats), ...]) for a length histogram.

    Lengths go longest first; each goes into the packs with the most room left,
    and opens new packs only when none has room.  Only counts of patterns are
    kept, so the work depends on the number of different lengths, not on rows.
    """
    packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (-room, tie, count, items)
    tie = 0
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, count, items = heapq.heappop(packs)
                take = min(left, count)
                tie += 1
                heapq.heappush(packs, (room + length, tie, take, _with(items, length, 1)))
                if take < count:
                    tie += 1
                    heapq.heappush(packs, (room, tie, count - take, items))
                left -= take
                continue
            each = limit // length
            full, rest = divmod(left, each)
            for number, repeats in ((full, each), (1 if rest else 0, rest)):
                if number:
                    tie += 1
                    heapq.heappush(packs, (-(limit - repeats * length), tie, number, [(length, repeats)]))
            left = 0
    return [(count, items) for _, _, count, items in sorted(packs, key=lambda p: p[1])]


def _with(items: list[tuple[int, int]], length: int, repeats: int) -> list[tuple[int, int]]:
    if items and items[-1][0] == length:
        return [*items[:-1], (length, items[-1][1] + repeats)]
    return [*items, (length, repeats)]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence, repeats in a pack and first offset of each pattern that holds it."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for count, items in patterns:
        offset = 0
        for length, repeats in items:
            rank = ranks.get(length, 0)
            found.setdefault(length, []).append((rank, base, repeats, offset))
            ranks[length] = rank + count * repeats
            offset += length * repeats
        base += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in found.items()}


def _place(slots: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                size = int(length[part[0]])
                ranks, base, repeats, offset = slots[size]
                k = np.searchsorted(ranks, rank[part], "right") - 1
                inside = rank[part] - ranks[k]
                seq[part] = base[k] + inside // repeats[k]
                off[part] = offset[k] + inside % repeats[k] * size
            yield pa.record_batch([*(b.column(k) for k in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


@tidy
def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """One row per piece with its place: sequence_id and offset."""
    pieces = cut(token_pieces(docs, tokenizer, limit, end), "pieces").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    # at most `limit` rows come to the driver
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(pack_histogram(histogram, limit))
    parts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")  # rows that tie in all are alike
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(parts, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("own")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(slots), PIECES + ", sequence_id long, offset long")
