"""N-gram Jaccard join with set-relation skipping, and the components of its links.

A text's set holds its distinct word shingles (a text with fewer words has its
whole sequence as one, a text without words has the empty set and links with
nothing).  Two texts link when 100 * |A & B| >= percent * |A | B|.

Method.  Equal sets fall together first.  Sets order their shingles rare first
and post only their prefix, so that any linked pair meets in some index list.
* Index level: the entries of a list are sorted by position and cut into blocks;
  a pair of blocks whose best positions can't give the needed overlap is skipped
  whole, and a pair of entries is checked by size and position before it counts.
* Sets in long lists are posted a second time among themselves, in the order of
  their own shingles' frequency, so that what a group shares comes last.
* Answer level: each set's candidates name a representative, the one with the most
  partners, and the set is compared with it on whole sets.  What either has more is
  kept.  The answers of all sets that are similar to one representative are then
  derived from these few differences: the intersection of two of them is the
  representative's size, less what either lacks, and what both lack or both add once
  more.  Whole sets meet only where two have no representative in common.
* In a list that is still long each set is first compared with the most typical set
  only.  The links found make families of highly similar sets; the list is then
  joined only between families, since a link inside one can't change the components.
All candidate pairs are decided exactly, so components are exact (up to 64-bit
hashes of shingles and sets: about n * n / 4e19 odds for n sets).

Counts of all shingles are taken; the ``FREQUENT`` most frequent (8 bytes each)
are broadcast and steer the order, and any order is right.  Null texts count as empty; repeated rows
share their set; a null doc_id is told apart by its text, is no one's
component_id where there is another, and its row counts like any; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_IDS, NO_ID, cut, looked_up, most_frequent, one_row_each, partitions, tasks_for, text_key, texts, tidy, without
from skein.llm.components import components
from skein.llm.textops import by_size, mix, shingles, words

FREQUENT = 200_000  # entries of the table of frequent shingles, at most
BATCH = 2 << 20  # bytes of text in memory at once
COUNTED = 4_000_000  # shingles counted together
TOLD = 16_000_000  # shingles (4 bytes each) that a task counts
LISTED = 2_000_000  # prefix entries (33 bytes each) that a task holds
SHORT = 16  # entries of a list that is joined at once
SALTED = 4096  # entries of a list that one task takes
BLOCK = 64  # entries of a block


def text_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    _, _, _, ptr, h = words(col)
    sh, sp = shingles(h, ptr, width)
    out, at = [], sp.tolist()
    for k in range(len(at) - 1):
        x = np.sort(sh[at[k] : at[k + 1]])
        if len(x) > 1:
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        out.append(x)
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set as a signed integer."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    mixed = mix(flat * np.uint64(0xD6E8FEB86659FD93))
    mixed[-1] = 0
    total = np.add.reduceat(mixed, first) if len(sets) else np.zeros(0, np.uint64)
    total = np.where(size > 0, total, np.uint64(0))
    return mix(total + size.astype(np.uint64)).view(np.int64)


def sketch(x: np.ndarray) -> bytes | None:
    """Shingles of a set by the first byte of their hash; None when a count passes a byte."""
    n = np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256)
    return None if n.max() > 255 else n.astype(np.uint8).tobytes()


def _profile(width: int):
    """(doc_id, set id, size, sketch, xxhash64 of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", BATCH):
            sets = text_sets(b.column(1), width)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.record_batch([b.column(0), pa.array(set_ids(sets)), pa.array(size), pa.array([sketch(x) for x in sets], pa.binary()), b.column(2)], ["doc_id", "node", "n", "sketch", "raw"])

    return run


ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("rare", "<i4"), ("dealt", "u1")])


def need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def _prefixes(width: int, percent: int, tokens: np.ndarray, counts: np.ndarray, buckets: int):
    """Prefix entries of all distinct sets of a batch, as one block for each bucket of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", BATCH):
            sets = text_sets(b.column(0), width)
            node = set_ids(sets)
            _, first = np.unique(node, return_index=True)
            rows = []
            for k in first.tolist():
                x = sets[k]
                n = len(x)
                if not n:
                    continue
                weight = np.zeros(n, np.int64)
                if len(tokens):
                    key = (x >> np.uint64(32)).astype(np.uint32)
                    spot = np.minimum(np.searchsorted(tokens, key), len(tokens) - 1)
                    weight = np.where(tokens[spot] == key, counts[spot], 0)
                long = n - -(-percent * n // 100) + 1
                rare = int((weight == 0).sum())
                order = np.lexsort((x, weight)) if rare < long else np.flatnonzero(weight == 0)[:long]
                part = np.empty(long, ENTRY)
                part["token"], part["node"], part["n"], part["pos"], part["rare"] = x[order[:long]], node[k], n, np.arange(long), rare
                rows.append((part, weight[order[:long]]))
            if not rows:
                continue
            entries, weight = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            # a list that may be too long for one task is dealt out in parts, anew for each shingle
            parts = np.maximum(1, weight // SALTED).astype(np.uint64)
            entries["dealt"] = parts > 1
            salt = mix(entries["node"].view(np.uint64) ^ mix(entries["token"])) % parts
            bucket = (mix(entries["token"] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = [*edge[1:].tolist(), len(bucket)]
            blocks = [entries[a:z].tobytes() for a, z in zip(edge.tolist(), ends)]
            yield pa.record_batch([pa.array(bucket[edge]), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return run


def block_pairs(n: np.ndarray, pos: np.ndarray, percent: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of list entries that sizes and positions allow, by blocks of entries sorted by position.

    With ``group`` only pairs of different groups count.
    """
    order = np.lexsort((n, pos))
    n, pos = n[order], pos[order]
    group = None if group is None else group[order]
    left = n - pos  # what is left of a set from its entry on
    first = np.arange(0, len(n), BLOCK)
    most = np.maximum.reduceat(left, first)
    least_n, most_n = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
    xs, ys = [], []
    for i in range(len(first)):
        a = slice(first[i], min(first[i] + BLOCK, len(n)))
        others = np.arange(i, len(first))
        fits = np.minimum(most[i], most[others]) >= need(least_n[i], least_n[others], percent)
        fits &= (100 * most_n[others] >= percent * least_n[i]) & (100 * most_n[i] >= percent * least_n[others])
        for j in others[fits].tolist():
            b = slice(first[j], min(first[j] + BLOCK, len(n)))
            p, q = n[a][:, None], n[b][None, :]
            ok = np.minimum(left[a][:, None], left[b][None, :]) >= need(p, q, percent)
            ok &= (100 * np.minimum(p, q)) >= percent * np.maximum(p, q)
            if group is not None:
                ok &= group[a][:, None] != group[b][None, :]
            if i == j:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            xs.append(order[x + first[i]])
            ys.append(order[y + first[j]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


def _pairs_batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(x, y), np.maximum(x, y)
    zero = pa.array(np.zeros(len(low), np.int32))
    return pa.record_batch([pa.array(np.zeros(len(low), np.int32)), pa.array(low), pa.array(high), zero, zero], ["kind", "a", "b", "n", "pos"])


def _lists(percent: int, last: bool):
    """Rows (0, a, b) of candidate pairs of short lists, and what is left of long lists.

    At first that is (1, 0, node): the sets in them are ordered anew.  At last it
    is their pairs with the most typical set, and (1, shingle, node, size,
    position) of entries that may still have a partner.  A part of a list that is
    dealt out counts as long whatever its size, as partners may be in other parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # there are as many tasks as the entries need (LISTED), and a list that may be long is dealt out over them
        blocks = [np.frombuffer(x, ENTRY) for b in batches for x in (b.column(1).to_pylist())]
        if not blocks:
            return
        e = np.concatenate(blocks)
        e = e[np.lexsort((e["node"], e["token"]))]
        same = np.zeros(len(e), bool)
        same[1:] = (e["token"][1:] == e["token"][:-1]) & (e["node"][1:] == e["node"][:-1])
        e = e[~same]
        edge = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
        size = np.diff(np.concatenate([edge, [len(e)]]))
        xs, ys, late = [], [], []
        dealt = e["dealt"][edge] > 0
        two = edge[(size == 2) & ~dealt]
        p, q = e[two], e[two + 1]
        ok = np.minimum(p["n"] - p["pos"], q["n"] - q["pos"]) >= need(p["n"].astype(np.int64), q["n"].astype(np.int64), percent)
        xs.append(p["node"][ok])
        ys.append(q["node"][ok])
        for k in np.flatnonzero((size > 2) | dealt).tolist():
            part = e[edge[k] : edge[k] + size[k]]
            n, pos = part["n"].astype(np.int64), part["pos"].astype(np.int64)
            if size[k] <= SHORT and not dealt[k]:
                i, j = block_pairs(n, pos, percent)
                xs.append(part["node"][i])
                ys.append(part["node"][j])
                continue
            if not last:
                late.append(part["node"])
                continue
            top = np.lexsort((part["node"], part["rare"]))[0]  # the set with the fewest shingles of its own
            ok = (100 * np.minimum(n, n[top]) >= percent * np.maximum(n, n[top])) & (np.arange(len(n)) != top)
            xs.append(part["node"][ok])
            ys.append(np.full(int(ok.sum()), part["node"][top]))
            # entries whose position rules out every size of partner in the list go no further
            least = 0 if dealt[k] else n.min()
            partner = np.maximum(least, -(-percent * n // 100))
            able = part[n - pos >= need(n, partner, percent)]
            if len(able) > 1 or dealt[k]:
                late.append(able)
        x, y = np.concatenate(xs), np.concatenate(ys)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        for first in range(0, len(pair), 100_000):
            yield _pairs_batch(pair[first : first + 100_000, 0], pair[first : first + 100_000, 1])
        if not last:
            again = np.unique(np.concatenate([*late, np.zeros(0, np.int64)]))
            zero = pa.array(np.zeros(len(again), np.int32))
            yield pa.record_batch([pa.array(np.ones(len(again), np.int32)), pa.array(np.zeros(len(again), np.int64)), pa.array(again), zero, zero], ["kind", "a", "b", "n", "pos"])
            return
        for part in late:
            yield pa.record_batch([pa.array(np.ones(len(part), np.int32)), pa.array(part["token"].view(np.int64)), pa.array(part["node"]), pa.array(part["n"]), pa.array(part["pos"])], ["kind", "a", "b", "n", "pos"])

    return run


def _between(percent: int):
    """Candidate pairs (a, b) between families of one part of a list; rows come sorted by token and part."""

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part = np.concatenate(rows)
        node, family, n, pos, main, lead = part.T
        i, j = block_pairs(n, pos, percent, family)
        # pairs of two entries outside the main family count in the first part only
        ok = (main[i] == 1) | (main[j] == 1) | (lead[i] == 1)
        x, y = node[i[ok]], node[j[ok]]
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        for first in range(0, len(pair), 100_000):
            yield pa.record_batch([pa.array(pair[first : first + 100_000, 0]), pa.array(pair[first : first + 100_000, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
            rest = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 8)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist()
            for first, last in zip(edge, [*edge[1:], len(key)]):
                if at is not None and tuple(key[first]) != at:
                    yield from pairs(rows)
                    rows = []
                at = tuple(key[first])
                rows.append(rest[first:last])
        if rows:
            yield from pairs(rows)

    return run


def _shingle_blocks(width: int, buckets: int):
    """All shingles of the distinct sets of a batch, as one block for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", BATCH):
            sets = text_sets(b.column(0), width)
            _, first = np.unique(set_ids(sets), return_index=True)
            # the upper half of a hash is enough for an order
            flat = (np.concatenate([sets[k] for k in first]) >> np.uint64(32)).astype(np.uint32)
            bucket = (flat % np.uint32(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            flat, bucket = flat[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = [*edge[1:].tolist(), len(bucket)]
            yield pa.record_batch([pa.array(bucket[edge]), pa.array([flat[a:z].tobytes() for a, z in zip(edge.tolist(), ends)], pa.binary())], ["bucket", "block"])

    return run


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y): keys of shingles held by more than half of SHORT sets, and how many hold them."""
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def merge() -> None:
        nonlocal keys, counts
        own, n = np.unique(np.concatenate(held), return_counts=True)
        all_keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(all_keys)).astype(np.int64)
        keys = all_keys
        held.clear()

    for b in batches:
        for x in b.column(1).to_pylist():
            held.append(np.frombuffer(x, "<u4"))
            if sum(map(len, held)) > COUNTED:
                merge()
    if held:
        merge()
    keep = counts > SHORT // 2
    yield pa.record_batch([pa.array(keys[keep].astype(np.int64)), pa.array(counts[keep])], ["x", "y"])


def _set_blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", BATCH):
            sets = text_sets(b.column(0), width)
            yield pa.record_batch([pa.array(set_ids(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "block"])

    return run


def _possible(percent: int):
    """Pairs (a, b) whose sketches allow the needed overlap: it is at most the sum of the smaller counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            ok = np.ones(b.num_rows, bool)
            rows = [k for k, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())) if x is not None and y is not None]
            if rows:
                p, q = (np.frombuffer(b"".join(b.column(c).take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, 256) for c in (4, 5))
                ok[rows] = np.minimum(p, q).sum(1, dtype=np.int64) >= need(n[rows], m[rows], percent)
            keep = pa.array(ok)
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """Number of elements of two sets of distinct elements that both hold."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(inter: int, n: int, m: int, percent: int) -> bool:
    """Whether sets of sizes n and m with such an intersection link."""
    return 100 * inter >= percent * (n + m - inter)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                keep.append(linked(shared(p, q), len(p), len(q), percent))
            ok = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


DIFFERENCES = "node long, rep long, n long, less binary, more binary"


def _differences(percent: int):
    """(node, rep, size of rep, what rep has more, what the node has more) of nodes that link with their representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, size, less, more = [], [], [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own, rep = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                gone, new = np.setdiff1d(rep, own, True), np.setdiff1d(own, rep, True)
                keep.append(linked(len(rep) - len(gone), len(own), len(rep), percent))
                size.append(len(rep))
                less.append(gone.tobytes())
                more.append(new.tobytes())
            found = pa.record_batch([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(less, pa.binary()), pa.array(more, pa.binary())], ["node", "rep", "n", "less", "more"])
            yield found.filter(pa.array(keep, pa.bool_()))

    return run


def derived(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int]:
    """(intersection, size, size) of two sets from what each lacks and adds to a third one of size n."""
    inter = n - len(a[0]) - len(b[0]) + shared(a[0], b[0]) + shared(a[1], b[1])
    return inter, n - len(a[0]) + len(a[1]), n - len(b[0]) + len(b[1])


def _derive(percent: int):
    """Pairs (a, b) that link, by their differences from a common representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, *parts in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
                one, two, three, four = (np.frombuffer(x, "<u8") for x in parts)
                keep.append(linked(*derived(n, (one, two), (three, four)), percent))
            ok = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


class JaccardJoin:
    """The steps of one join; ``links`` and ``classes`` are its results."""

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.width, self.percent = width, percent
        self.docs = texts(docs)
        profile = cut(self.docs.withColumn("raw", F.xxhash64("text")).mapInArrow(_profile(width), "doc_id long, node long, n long, sketch binary, raw long"), "sets")
        self.rows = profile.select("doc_id", "node", "n", "raw")
        self.sketches = profile.select("node", "n", "sketch")
        self.shingles = profile.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _table(self, some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Keys (the upper half) of the most frequent shingles of some texts, FREQUENT at most, in order, and their counts."""
        n = tasks_for(self.spark, self.shingles, TOLD)
        blocks = some.mapInArrow(_shingle_blocks(self.width, 4 * n), "bucket int, block binary")
        counted = cut(blocks.repartition(n, "bucket").mapInArrow(_often, "x long, y long"), "often")
        frame = most_frequent(counted, "y", FREQUENT).toArrow()
        keys, counts = frame["x"].to_numpy().astype(np.uint32), frame["y"].to_numpy()
        order = np.argsort(keys)
        return keys[order], counts[order]

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """Texts that have the given sets, one for each (rows that repeat doc_id and text bring it again, which changes no link)."""
        key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("raw").alias("raw"))
        one = looked_up(self.rows, cut(nodes, "nodes"), "node", how="left_semi").groupBy("node").agg(F.min(key).alias("one")).select("one.id", "one.raw")
        one = cut(one, "ids")
        small = one.count() <= BROADCAST_IDS  # beyond it both sides are shuffled
        own, raw = text_key(self.docs)
        return self.docs.join(F.broadcast(one) if small else one, (own == one["id"]) & (raw == one["raw"]), "left_semi").select("text")

    def _joined(self, some: DataFrame, table: tuple[np.ndarray, np.ndarray], last: bool) -> DataFrame:
        # a prefix has (100 - percent) of 100 shingles of its set, and one
        n = tasks_for(self.spark, self.shingles * (100 - self.percent) // 100 + 1, LISTED)
        blocks = some.mapInArrow(_prefixes(self.width, self.percent, *table, 4 * n), "bucket int, block binary")
        return cut(blocks.repartition(n, "bucket").mapInArrow(_lists(self.percent, last), "kind int, a long, b long, n int, pos int"), "lists")

    def _verified(self, pairs: DataFrame, what: str) -> DataFrame:
        pairs = cut(pairs.dropDuplicates(["a", "b"]), "pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = cut(asked, "asked")
        few = asked.count() <= BROADCAST_IDS
        known = cut(self.sketches.join(F.broadcast(asked) if few else asked, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        one = known.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
        two = known.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
        met = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "n", "m", "x", "y")
        pairs = cut(met.mapInArrow(_possible(self.percent), "a long, b long"), "pairs")
        reps = self._representatives(pairs)
        sets = cut(self._texts(reps.select("node")).mapInArrow(_set_blocks(self.width), "node long, block binary").dropDuplicates(["node"]), "blocks")
        left = sets.select(F.col("node").alias("a"), F.col("block").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("block").alias("y"))
        star = reps.where("rep <> node").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        near = cut(star.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_differences(self.percent), DIFFERENCES), "stars")
        # a representative differs from itself in nothing; its size is known from the differences of the others
        size = near.groupBy("rep").agg(F.first("n").alias("n"))
        none = F.lit(b"")
        own = reps.where("rep = node").join(size, "rep").select("node", "rep", "n", none.alias("less"), none.alias("more"))
        known = cut(reps.join(near.unionByName(own).drop("rep"), "node", "left"), "known")
        name = lambda side: known.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "less", "more")))
        rest = pairs.join(name("a").hint("merge"), "a").join(name("b").hint("merge"), "b").where("rep_a <> b and rep_b <> a")
        rest = rest.withColumn("same", (F.col("rep_a") == F.col("rep_b")) & F.col("n_a").isNotNull() & F.col("n_b").isNotNull())
        rest = cut(rest.select("a", "b", "same", F.when(F.col("same"), F.col("n_a")).alias("n"), *(F.when(F.col("same"), F.col(c)).alias(c) for c in ("less_a", "more_a", "less_b", "more_b"))), "rest")
        answers = rest.where("same").select("a", "b", "n", "less_a", "more_a", "less_b", "more_b").mapInArrow(_derive(self.percent), "a long, b long")
        far = rest.where("not same").select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")
        direct = far.mapInArrow(_verify(self.percent), "a long, b long")
        stars = near.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
        return cut(stars.unionByName(answers).unionByName(direct), what)

    def _representatives(self, pairs: DataFrame) -> DataFrame:
        """(node, rep): for each set of a pair the one among itself and its partners that has the most partners."""
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.node", "e.other")
        degree = cut(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
        rank = lambda node: F.struct("degree", F.bitwise_not(F.col(node)).alias("low"))  # noqa: E731  # ties: the least id
        others = ends.join(degree.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.max(rank("other")).alias("best"))
        return cut(degree.join(others, "node").select("node", F.bitwise_not(F.greatest(rank("node"), F.col("best"))["low"]).alias("rep")), "reps")

    def links(self) -> DataFrame:
        """Verified links (a, b) of sets that give all components."""
        n = partitions(self.spark)
        whole = self.docs.select("text")
        early = self._joined(whole, self._table(whole), False)
        # sets that met in long lists go again by themselves, in the order of their own shingles' frequency
        some = cut(self._texts(early.where("kind = 1").select(F.col("b").alias("node")).distinct()), "again")
        found = self._joined(some, self._table(some), True)
        first = self._verified(early.where("kind = 0").select("a", "b").unionByName(found.where("kind = 0").select("a", "b")), "links")
        late = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), "n", "pos")
        family = components(first)
        late = looked_up(late, cut(family, "families"), "node").withColumn("family", F.coalesce("component", "node"))
        late = cut(late.select("token", "node", "family", "n", "pos"), "late")
        each = late.groupBy("token", "family").agg(F.count(F.lit(1)).alias("k"))
        of = each.groupBy("token").agg(F.max_by("family", F.struct("k", "family")).alias("main"), F.count(F.lit(1)).alias("families"), F.sum("k").alias("all")).where("families > 1")
        of = cut(of, "mixed")  # lists of more than one family
        parts = (F.ceil(F.col("all") / SALTED)).cast("int")
        rows = looked_up(late, of, "token", how="inner").withColumn("is_main", (F.col("family") == F.col("main")).cast("int"))
        # the main family's entries are dealt over the parts; the few others go to each part
        spread = F.when(F.col("is_main") == 1, F.array(F.pmod(F.xxhash64("node"), parts.cast("long")))).otherwise(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))
        rows = rows.withColumn("part", F.explode(spread)).select("token", "part", "node", "family", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "is_main", (F.col("part") == 0).cast("int").alias("lead"))
        more = rows.repartition(n, "token", "part").sortWithinPartitions("token", "part").mapInArrow(_between(self.percent), "a long, b long")
        second = self._verified(more.join(first, ["a", "b"], "left_anti"), "links")
        return first.unionByName(second)

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id, label, and xxhash64 of the text (raw) for every row."""
        label = cut(components(self.links()), "components")
        rows = cut(looked_up(self.rows, label, "node").withColumn("label", F.coalesce("component", "node")), "labels")
        of = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.min(place()).alias("first"), F.count(F.lit(1)).alias("size"))
        shared = cut(of.where("size > 1").drop("size"), "least")  # any other row is its own component
        found = looked_up(rows, shared, "label")
        least = F.when((F.col("n") > 0) & F.col("first").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
        return found.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"), "raw", F.coalesce("first", place()).alias("first"))


def place() -> Column:
    """Order of the rows of a component: the least doc_id comes first, none last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("raw").alias("raw"))


@tidy
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row."""
    return JaccardJoin(docs, width, percent).classes().drop("raw", "first")


@tidy
def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns, of the document with the least doc_id of each component, one row of each; texts without words all stay."""
    found = cut(JaccardJoin(docs, width, percent).classes().where("n_shingles > 0").select(F.col("doc_id").alias("id"), "raw", place().eqNullSafe(F.col("first")).alias("stays")), "classes")
    repeated = found.where("stays").groupBy("id", "raw").count().where("count > 1")
    return one_row_each(without(docs, found.where("not stays")), repeated)
