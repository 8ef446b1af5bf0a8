"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Symbols are words: lower-cased (A-Z), without ASCII punctuation at their ends.
A document is contaminated by an item of L words when some stretch of it has word
edit distance of at most L * (100 - percent) // 100 to the item.

1. CGK.  Random walks read the words of a window: at each step a random function
   of step and word says whether the walk moves on.  Small edit distance becomes
   small Hamming distance between what two walks read.  In an item-sized window a
   walk begins anew every ``Shape.stride`` words and takes ``Shape.steps`` steps, so an
   edit spoils the walks around it only.  A walk from some word of a document is
   part of all windows that hold it, whatever their size, so it is made once.
2. LSH.  ``KEYS`` keys of a walk sample some of its steps each; ``WALKS`` walks
   repeat that.  All words of all documents send keys; a key that an item's window
   has too makes a candidate (document, item, place).  Nothing else selects
   candidates.  Items of fewer than five words must occur as they are: their key
   is the whole window.
3. Candidates of one document and item whose windows overlap are verified together
   by exact edit distance, over the window and as many words around it as the
   bound allows.

The benchmark is the stated query set: it is taken in blocks (``BLOCK_ITEMS``
items, ``BLOCK_BYTES`` of text), one at a time, each broadcast.  ``min_words``
leaves out shorter items (1: none).  Null texts count as empty and match nothing,
as do items without words, text or id; equal items share their keys and each get
their rows; repeated rows give repeated results; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, keep_rows, texts, tidy, without
from skein.llm.textops import by_size, hash_spans, lowered, mix, text_bytes, word_spans

WALKS = 6
KEYS = 4
CHUNK = 1 << 15  # words from which walks are made together
LISTED = 512  # windows of a text that are listed at once
ITEMS_AT_ONCE = 256  # of a text with more of them
BLOCK_ITEMS = 10_000
BLOCK_BYTES = 4 << 20
MIN_WORDS = 1
PERCENT = 80

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Shape:
    """Walks for items of ``least`` to ``most`` words: their steps, how many of them a key samples (0: all words of the
    window), and the words from one walk of a window to the next."""

    least: int
    most: int
    steps: int
    bits: int
    stride: int


SHAPES = (*(Shape(n, n, n, 0, 1) for n in range(1, 5)), Shape(5, 9, 6, 3, 1), Shape(10, 1 << 40, 18, 6, 2))


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes without punctuation at the ends, and the row pointer."""
    raw, offs = text_bytes(col)
    low = lowered(raw)
    s, e, ptr = word_spans(low, offs)
    first, last = s.copy(), e.copy()
    live = np.arange(len(s))
    while len(live):
        live = live[(first[live] < last[live]) & _PUNCTUATION[low[np.minimum(first[live], len(low) - 1)]]]
        first[live] += 1
    live = np.arange(len(s))
    while len(live):
        live = live[(first[live] < last[live]) & _PUNCTUATION[low[last[live] - 1]]]
        last[live] -= 1
    bare = first < last  # a word of punctuation alone stays as it is
    return hash_spans(low, np.where(bare, first, s), np.where(bare, last, e)), ptr


def bound(size: int, percent: int) -> int:
    """Greatest edit distance that counts."""
    return size * (100 - percent) // 100


def sampled_steps(shape: Shape, seed: int) -> np.ndarray:
    """The steps that each key of a walk samples, one from each equal part of the walk: KEYS rows of ``bits`` steps."""
    rng = np.random.default_rng(1000 * shape.least + seed)
    edge = np.linspace(0, shape.steps, shape.bits + 1).astype(int)
    return np.stack([rng.integers(a, z, KEYS) for a, z in zip(edge[:-1], edge[1:])], 1)


def walk_keys(h: np.ndarray, first: int, last: int, shape: Shape) -> Iterator[np.ndarray]:
    """Keys of all walks that begin at words first to last - 1, one row of keys at a time; words behind the end are like no other."""
    near = h[first : last + shape.steps]
    near = np.concatenate([near, np.arange(last + shape.steps - first - len(near)).astype(np.uint64) * np.uint64(_ODD)])
    n = last - first
    if not shape.bits:
        key = np.full(n, shape.least, np.uint64)
        for j in range(shape.steps):
            key = mix(key * np.uint64(_ODD) + near[j : j + n])
        yield key
        return
    for seed in range(WALKS):
        steps = sampled_steps(shape, seed)
        odd = np.random.default_rng(seed).integers(0, 2**63, steps.shape).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        # bit j of a word's hash says whether the walk moves on from it at step j; the hash also stands for the word
        own = mix(near + np.uint64((seed + 1) * _ODD % 2**64))
        keys = np.zeros((KEYS, n), np.uint64)
        at = np.arange(n)
        for j in range(int(steps.max()) + 1):
            read = own[at]
            for k, i in zip(*np.nonzero(steps == j)):
                keys[k] += read * odd[k, i]
            at += ((read >> np.uint64(j)) & np.uint64(1)).view(np.int64)
        for k in range(KEYS):
            yield keys[k] + np.uint64((shape.least << 16) + (seed << 8) + k)


def _scores(item: np.ndarray, text: np.ndarray, anywhere: bool) -> list[int]:
    """Edit distance of the item to the text up to each of its words, from the text's first word or from anywhere in it, by bit vectors."""
    masks: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, out = full, 0, n, []
    for y in text.tolist():
        eq = masks.get(y, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(x | up) & full
        hn = up & x
        score += bool(hp & top) - bool(hn & top)
        out.append(score)
        hp = (hp << 1 | (not anywhere)) & full
        hn = hn << 1 & full
        v = eq | down
        up = hn | ~(v | hp) & full
        down = hp & v
    return out


def best_stretch(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """(distance, start) of the stretch of a text nearest to the item, the first of equals; None beyond ``most``."""
    scores = _scores(item, text, True)
    d = min(scores, default=most + 1)
    if d > most:
        return None
    end = scores.index(d) + 1
    return d, end - 1 - _scores(item[::-1], text[:end][::-1], False).index(d)


class ItemIndex:
    """LSH keys of the windows of one block of items."""

    def __init__(self, ids: list[int], item_texts: list[str], percent: int, min_words: int) -> None:
        h, ptr = symbols(pa.array(item_texts, pa.string()))
        self.percent = percent
        found: dict[bytes, list[int]] = {}
        for i, a, z in zip(ids, ptr[:-1].tolist(), ptr[1:].tolist()):
            if z - a >= max(1, min_words):
                found.setdefault(h[a:z].tobytes(), []).append(i)
        self.items = [(own, np.frombuffer(x, np.uint64)) for x, own in found.items()]
        self.sizes = np.array([len(x) for _, x in self.items], np.int64)
        self.most = self.sizes * (100 - percent) // 100
        self.reach = int((self.sizes + self.most).max(initial=0)) + 1
        self.vocabulary, self.spelled = np.unique(np.concatenate([x for _, x in self.items] or [np.zeros(0, np.uint64)]), return_inverse=True)
        self.spelled_at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.by_item: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sieves: dict[Shape, tuple[np.ndarray, np.uint64]] = {}
        self.tables: list[tuple[Shape, np.ndarray, np.ndarray, np.ndarray]] = []
        for shape in SHAPES:
            keys, holder, offset = [], [], []
            for k, (_, x) in enumerate(self.items):
                if shape.least <= len(x) <= shape.most:
                    starts = np.arange(0, max(1, len(x) - shape.steps // 2 + 1) if shape.bits else 1, shape.stride)  # a walk passes half as many words as it takes steps
                    for row in walk_keys(x, 0, int(starts[-1]) + 1, shape):
                        keys.append(row[starts])
                        holder.append(np.full(len(starts), k, np.int32))
                        offset.append(starts.astype(np.int32))
            if keys:
                key = np.concatenate(keys)
                order = np.argsort(key, kind="stable")
                self.tables.append((shape, key[order], np.concatenate(holder)[order], np.concatenate(offset)[order]))

    def _sieve(self, shape: Shape, keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """Which upper parts of mixed keys occur: most keys of other texts stop here."""
        if shape not in self.sieves:
            bits = max(10, min(26, len(keys).bit_length() + 5))
            shift = np.uint64(64 - bits)
            out = np.zeros(1 << bits, bool)
            out[((keys * np.uint64(_ODD)) >> shift).view(np.int64)] = True
            self.sieves[shape] = out, shift
        return self.sieves[shape]

    def _entries(self, table: int) -> tuple[np.ndarray, np.ndarray]:
        """A table's entries by item, and where each item's begin."""
        if table not in self.by_item:
            holder = self.tables[table][2]
            order = np.argsort(holder, kind="stable")
            self.by_item[table] = order, np.searchsorted(holder[order], np.arange(len(self.items) + 1))
        return self.by_item[table]

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Rows (place, table, first and last entry) of the walks that share a key with an item, by place; the entries stay unlisted."""
        found = [np.zeros((0, 4), np.int32)]
        for t, (shape, keys, _, _) in enumerate(self.tables):
            sieve, shift = self._sieve(shape, keys)
            for first in range(0, len(h), CHUNK):
                last = min(first + CHUNK, len(h))
                for row in walk_keys(h, first, last, shape):
                    some = np.flatnonzero(sieve[((row * np.uint64(_ODD)) >> shift).view(np.int64)])
                    if not len(some):
                        continue
                    lo, hi = np.searchsorted(keys, row[some], "left"), np.searchsorted(keys, row[some], "right")
                    met = hi > lo
                    found.append(np.stack([first + some[met], np.full(int(met.sum()), t), lo[met], hi[met]], 1).astype(np.int32))
        out = np.concatenate(found)
        return out[np.argsort(out[:, 0], kind="stable")]

    def _missing(self, words: np.ndarray) -> np.ndarray:
        """Words of each item, with repeats, that don't occur among these; no edit makes up for one of them."""
        at = np.searchsorted(self.vocabulary, words)
        inside = at < len(self.vocabulary)
        at, words = at[inside], words[inside]
        absent = np.ones(len(self.vocabulary), bool)
        absent[at[self.vocabulary[at] == words]] = False
        return np.add.reduceat(absent[self.spelled].astype(np.int32), self.spelled_at)

    def windows(self, h: np.ndarray, hits: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (item, word at which the window begins) for the hits of one text, sorted and without repeats.

        A few are listed at once.  Where items share passages, hits times holders
        would be many: the text falls into the stretches that the hits reach, items
        that lack more words in a stretch than their bound are out, and the keys of
        the others meet the hits item by item, in bounded pieces.
        """
        if int((hits[:, 3] - hits[:, 2]).sum()) <= LISTED:
            parts = []
            for t in np.unique(hits[:, 1]).tolist():
                _, _, holder, offset = self.tables[t]
                own = hits[hits[:, 1] == t].astype(np.int64)
                n = own[:, 3] - own[:, 2]
                spot = np.repeat(own[:, 2] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                parts.append(np.stack([holder[spot], np.repeat(own[:, 0], n) - offset[spot]], 1))
            yield np.unique(np.concatenate(parts), axis=0)
            return
        place = hits[:, 0].astype(np.int64)
        cut = np.flatnonzero(np.diff(place) > 2 * self.reach) + 1
        inside: list[np.ndarray] = []
        for own in np.split(hits, cut):
            lo, hi = max(0, int(own[0, 0]) - self.reach), int(own[-1, 0]) + self.reach
            allowed = np.flatnonzero(self._missing(np.unique(h[lo:hi])) <= self.most)
            for first in range(0, len(allowed), ITEMS_AT_ONCE):
                inside.append(self._met(own, allowed[first : first + ITEMS_AT_ONCE]))
        rows = np.unique(np.concatenate(inside), axis=0) if inside else np.zeros((0, 2), np.int64)
        yield rows

    def _met(self, hits: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """The rows of ``windows`` for some items, by their own keys."""
        parts = [np.zeros((0, 2), np.int64)]
        for t in np.unique(hits[:, 1]).tolist():
            _, _, holder, offset = self.tables[t]
            order, at = self._entries(t)
            entries = np.concatenate([order[a:z] for a, z in zip(at[allowed].tolist(), at[allowed + 1].tolist())])
            own = hits[hits[:, 1] == t].astype(np.int64)
            own = own[np.argsort(own[:, 2], kind="stable")]
            start, first = np.unique(own[:, 2], return_index=True)  # ranges of equal keys don't overlap
            upto = np.append(first[1:], len(own))
            k = np.searchsorted(start, entries, "right") - 1
            met = (k >= 0) & (entries < own[first[k], 3])
            entries, k = entries[met], k[met]
            n = upto[k] - first[k]
            spot = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            parts.append(np.unique(np.stack([np.repeat(holder[entries], n), own[spot, 0] - np.repeat(offset[entries], n)], 1), axis=0))
        return np.unique(np.concatenate(parts), axis=0)

    def matches(self, col: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item id, start, distance) of the best stretch for each item in each text of a column."""
        if not self.tables or not len(col):
            return []
        h, ptr = symbols(col)
        hits = self.hits(h)
        edge = np.searchsorted(hits[:, 0], ptr)
        out = []
        for row in np.flatnonzero(np.diff(edge)).tolist():
            a, z = int(ptr[row]), int(ptr[row + 1])
            own = hits[edge[row] : edge[row + 1]].copy()
            own[:, 0] -= a
            for met in self.windows(h[a:z], own):
                out += [(row, i, start, d) for item, start, d in self._verified(h[a:z], met) for i in self.items[item][0]]
        return out

    def _verified(self, text: np.ndarray, met: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, distance) of the best stretch of a text for each item that has one, from its windows."""
        size, most = self.sizes[met[:, 0]], self.most[met[:, 0]]
        lo, hi = np.maximum(met[:, 1] - most, 0).tolist(), np.minimum(met[:, 1] + size + most, len(text)).tolist()
        items, most = met[:, 0].tolist(), most.tolist()
        k = 0
        while k < len(items):
            item, best = items[k], None
            while k < len(items) and items[k] == item:
                first, last, limit = lo[k], hi[k], most[k]
                k += 1
                while k < len(items) and items[k] == item and lo[k] <= last:  # windows that overlap are verified together
                    last = max(last, hi[k])
                    k += 1
                stretch = best_stretch(self.items[item][1], text[first:last], limit)
                if stretch and (best is None or stretch[0] < best[0]):
                    best = stretch[0], first + stretch[1]
            if best:
                yield item, best[1], best[0]


def _scan(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", 2 << 20):
            rows = index.matches(b.column(1))
            if rows:
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch([b.column(0).take(at), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3)), b.column(2).take(at)], ["doc_id", "item_id", "start_word", "distance", "raw"])

    return run


def _blocks(items: DataFrame, percent: int, min_words: int) -> tuple[int, Iterator[ItemIndex]]:
    """The number of blocks of items, and their indexes, made one at a time."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_BYTES))

    def made() -> Iterator[ItemIndex]:
        for k in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
            yield ItemIndex(own["item_id"].to_pylist(), own["text"].to_pylist(), percent, min_words)

    return blocks, made()


def _found(docs: DataFrame, items: DataFrame, percent: int, min_words: int) -> DataFrame:
    rows = texts(docs).withColumn("raw", F.xxhash64("text"))
    blocks, indexes = _blocks(items, percent, min_words)
    found = []
    for index in indexes:
        one = rows.mapInArrow(_scan(index), "doc_id long, item_id long, start_word long, distance long, raw long")
        found.append(one if blocks == 1 else cut(one, "leaks"))  # with more blocks each is done before the next is made
    return reduce(DataFrame.unionByName, found)


@tidy
def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, distance): the best stretch for each item in each document that has one."""
    return _found(docs, items, percent, min_words).drop("raw")


@tidy
def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows, all columns, of documents without any item's passage."""
    blocks, indexes = _blocks(items, percent, min_words)
    if blocks > 1:
        return without(docs, _found(docs, items, percent, min_words).select(F.col("doc_id").alias("id"), "raw"))
    index = next(indexes)

    def mask(col: pa.Array) -> np.ndarray:
        ok = np.ones(len(col), bool)
        ok[[r[0] for r in index.matches(col)]] = False
        return ok

    return keep_rows(docs, mask)
