"""Line dedup by a deletion-neighbourhood join.

A line of any length is dropped when an earlier line of the corpus equals it or
lies within one edit (a code point inserted, deleted or replaced).  Earlier means
a smaller (doc_id, row, line number).  Empty lines are always kept, and are no
one's partner.

1. Equal lines fall together first, each with its earliest place.
2. Two lines within one edit share their first or their last half; lines that
   share neither with another line can't have a partner and go no further.
3. The others emit their deletion variants as hashed keys: each variant with the
   place of the deletion (lines that share one differ in that place alone), and
   each variant beside the line itself (for an insertion or deletion).  Of lines
   with an equal key all pair with the earliest only, which decides them all, so
   a hot key gives no more pairs than lines.
4. Pairs are verified by exact edit distance.

Null texts count as empty and have one empty line.  Repeated rows count one by
one, in row order, whether they share doc_id, text or both.  A null doc_id comes
before all others.  An empty table gives
an empty result; extra columns are ignored.  Lines are identified by 128-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, tasks_for, texts, tidy
from skein.llm.textops import by_size, mix, text_bytes

BROADCAST_LINES = 500_000  # places of lines that may be broadcast
ENTRIES = 1_000_000  # variants that one task holds

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
ROWS = "row long, doc_id long, raw long, line_no int, n int, h1 long, h2 long, halves array<long>"
ENTRY = np.dtype([("key", "<u8"), ("kind", "<u1"), ("line", "<i8"), ("doc", "<i8"), ("row", "<i8"), ("no", "<i4")])


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretch of a code point sequence from running sums."""

    def __init__(self, points: np.ndarray, base: int) -> None:
        self.back = powers(pow(base, -1, 2**64), len(points))
        power = powers(base, len(points))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(base)) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in turn, and the row pointer."""
    raw, offs = text_bytes(col)
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4"), leads[offs]


class Lines:
    """The lines of all texts of a column: text, number, extent in code points and in bytes, and two hashes."""

    def __init__(self, col: pa.Array) -> None:
        raw, offs = text_bytes(col)
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        breaks = np.flatnonzero(raw == 10)
        self.per = np.bincount(np.searchsorted(offs, breaks, "right") - 1, minlength=len(col)) + 1
        self.first = np.cumsum(self.per) - self.per
        self.doc = np.repeat(np.arange(len(col)), self.per)
        self.no = np.arange(len(self.doc)) - self.first[self.doc]
        start, end = np.empty(len(self.doc), np.int64), np.empty(len(self.doc), np.int64)
        front, back = self.no == 0, self.no == self.per[self.doc] - 1
        start[front], end[back] = offs[:-1], offs[1:]
        start[~front], end[~back] = breaks + 1, breaks
        self.bytes, self.byte_start, self.byte_end = raw, start, end
        self.start, self.end = leads[start], leads[end]
        self.n = self.end - self.start
        self.one, two = Rolling(points, _BASES[0]), Rolling(points, _BASES[1])
        self.h1 = mix(self.one.of(self.start, self.end) + self.n.astype(np.uint64)).view(np.int64)
        self.h2 = two.of(self.start, self.end).view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, "text", 2 << 20):
        found = Lines(b.column(3))
        keys = []
        for size in (found.n, found.n - 1):  # as the shorter (or an equal) and as the longer line of a pair
            half = np.maximum(size, 0) // 2
            tag = size.astype(np.uint64) * np.uint64(2)
            keys += [mix(mix(found.one.of(found.start, found.start + half)) + tag), mix(mix(found.one.of(found.end - half, found.end)) + tag + np.uint64(1))]
        some = found.n > 0
        halves = np.stack(keys, 1).view(np.int64)[some].reshape(-1)
        at = np.concatenate([[0], np.cumsum(np.where(some, 4, 0))]).astype(np.int32)
        doc = pa.array(found.doc)
        yield pa.record_batch(
            [*(b.column(k).take(doc) for k in range(3)), pa.array(found.no.astype(np.int32)), pa.array(found.n.astype(np.int32)), pa.array(found.h1), pa.array(found.h2), pa.ListArray.from_arrays(pa.array(at), pa.array(halves))],
            ["row", "doc_id", "raw", "line_no", "n", "h1", "h2", "halves"],
        )


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each text, once its hashes are seen to be right."""
    for b in by_size(batches, "text", 2 << 20):
        found = Lines(b.column(0))
        want = b.column(1)
        doc = np.repeat(np.arange(b.num_rows), np.diff(want.offsets.to_numpy()))
        no, row, doc_id, h1, h2 = (want.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
        inside = no < found.per[doc]
        at = np.where(inside, found.first[doc] + no, 0)
        ok = np.flatnonzero(inside & (found.h1[at] == h1) & (found.h2[at] == h2))
        data = found.bytes.tobytes()
        line = [data[a:z].decode() for a, z in zip(found.byte_start[at[ok]].tolist(), found.byte_end[at[ok]].tolist())]
        yield pa.record_batch([pa.array(h1[ok]), pa.array(doc_id[ok]), pa.array(row[ok]), pa.array(no[ok].astype(np.int32)), pa.array(line, pa.string())], ["h1", "doc", "row", "line_no", "line"])


def _variants(buckets: int):
    """Keys of the deletion neighbourhood of each line, as blocks by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "line", 64 << 10):
            points, ptr = code_points(b.column(4))
            r = Rolling(points, _BASES[0])
            size = np.diff(ptr)
            line = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(points))
            start, end = ptr[:-1][line], ptr[1:][line]
            less = r.of(start, at) + r.of(at + 1, end) * powers(_BASES[0], int(size.max(initial=0)))[at - start]  # the line without this code point
            less = mix(less + (size[line] - 1).astype(np.uint64))
            whole = mix(r.of(ptr[:-1], ptr[1:]) + size.astype(np.uint64))
            place = mix(less + (at - start + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys = np.concatenate([place, less, whole])
            out = np.empty(len(keys), ENTRY)
            own = np.concatenate([line, line, np.arange(len(size))])
            out["key"], out["kind"] = keys, np.concatenate([np.zeros(len(line)), np.full(len(line), 1), np.full(len(size), 2)])
            for name, column in (("line", 0), ("doc", 1), ("row", 2), ("no", 3)):
                out[name] = b.column(column).to_numpy(zero_copy_only=False)[own]
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = [*edge[1:].tolist(), len(bucket)]
            yield pa.record_batch([pa.array(bucket[edge]), pa.array([out[a:z].tobytes() for a, z in zip(edge.tolist(), ends)], pa.binary())], ["bucket", "block"])

    return run


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, earlier) candidate pairs: each line with the earliest one under its key."""
    blocks = [np.frombuffer(x, ENTRY) for b in batches for x in b.column(1).to_pylist()]
    if not blocks:
        return
    e = np.concatenate(blocks)
    lines, earlier = [], []
    for kinds in ((0,), (1, 2)):
        part = e[np.isin(e["kind"], kinds)]
        if not len(part):
            continue
        part = part[np.lexsort((part["no"], part["row"], part["doc"], part["key"]))]
        new = np.concatenate([[True], part["key"][1:] != part["key"][:-1]])
        group = np.cumsum(new) - 1
        if kinds == (0,):
            lead = part["line"][np.flatnonzero(new)][group]
            lines.append(part["line"])
            earlier.append(lead)
            continue
        # the line itself (kind 2, one at most) against those that come to it by a deletion (kind 1)
        for own, other in ((1, 2), (2, 1)):
            spot = np.full(group[-1] + 1, -1)
            place = np.flatnonzero(part["kind"] == other)[::-1]
            spot[group[place]] = place  # the earliest of the other kind
            mine = np.flatnonzero(part["kind"] == own)
            them = spot[group[mine]]
            ok = (them >= 0) & (them < mine)
            lines.append(part["line"][mine[ok]])
            earlier.append(part["line"][them[ok]])
    x, y = np.concatenate(lines), np.concatenate(earlier)
    pair = np.unique(np.stack([x[x != y], y[x != y]], 1), axis=0)
    yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["line", "earlier"])


def line_rows(docs: DataFrame) -> DataFrame:
    """Every line of every row with its hashes."""
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("raw"), "text")
    return rows.mapInArrow(_lines, ROWS)


def _dropped(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1 of distinct lines with an earlier line within one edit."""
    keys = firsts.select("h1", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    alive = cut(firsts.join(keys.join(shared.hint("merge"), "key", "left_semi").select("h1").distinct().hint("merge"), "h1", "left_semi").select("h1", "h2", "n", "first"), "alive")
    size = alive.agg(F.count(F.lit(1)), F.coalesce(F.sum(2 * F.col("n") + 1), F.lit(0))).first()
    # an id that several texts share, or none, is told apart by the text's hash
    own = F.coalesce(F.col("first.doc_id"), F.lit(-(2**63))).cast("long")
    wanted = alive.select(own.alias("doc"), F.col("first.raw").alias("raw"), F.struct(F.col("first.line_no").alias("line_no"), F.col("first.row").alias("row"), own.alias("doc"), "h1", "h2").alias("place"))
    by_text = wanted.groupBy("doc", "raw").agg(F.collect_list("place").alias("want"))
    source = texts(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("doc"), F.xxhash64("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text"))
    met = source.join(F.broadcast(by_text) if size[0] <= BROADCAST_LINES else by_text, ["doc", "raw"]).select("text", "want")
    # rows that repeat doc_id and text bring the same lines again
    lines = met.mapInArrow(_asked, "h1 long, doc long, row long, line_no int, line string").dropDuplicates(["h1"])
    lines = cut(lines, "near")
    n = tasks_for(docs.sparkSession, size[1], ENTRIES)
    pairs = lines.mapInArrow(_variants(4 * n), "bucket int, block binary").repartition(n, "bucket").mapInArrow(_partners, "line long, earlier long").distinct()
    mine = lines.select(F.col("h1").alias("line"), F.col("line").alias("x"))
    theirs = lines.select(F.col("h1").alias("earlier"), F.col("line").alias("y"))
    met = pairs.join(mine, "line").join(theirs, "earlier")
    return met.where((F.levenshtein("x", "y", 1) >= 0) & (F.col("x") != F.col("y"))).select(F.col("line").alias("h1")).distinct()


def decisions(docs: DataFrame) -> DataFrame:
    """row, doc_id, line_no, kept for every line of every row."""
    rows = cut(line_rows(docs), "lines")
    place = F.struct("doc_id", "row", "line_no", "raw")
    firsts = rows.where("n > 0").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    firsts = cut(firsts, "firsts")
    gone = _dropped(docs, firsts).withColumn("gone", F.lit(True))
    known = firsts.select("h1", "h2", "first").join(gone.hint("merge"), "h1", "left")
    met = rows.select("row", "doc_id", "raw", "line_no", "n", "h1", "h2").join(known.hint("merge"), ["h1", "h2"], "left")
    kept = (F.col("n") == 0) | (F.col("gone").isNull() & F.col("first").eqNullSafe(place))
    return met.select("row", "doc_id", "line_no", kept.alias("kept"))


@tidy
def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and the numbers of the dropped lines (from 0, comma-joined) of every row."""
    found = decisions(docs).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))).alias("out"))
    return found.select("doc_id", "n_lines", "n_kept", F.array_join(F.col("out").cast("array<string>"), ",").alias("dropped_lines"))


@tidy
def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row with dropped lines left out (a text of dropped lines only becomes empty)."""
    source = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "source")
    out = decisions(source).where("not kept").groupBy("row").agg(F.collect_set("line_no").alias("out"))
    numbered = source.withColumn("row", F.monotonically_increasing_id()).join(out, "row", "left")
    lines = F.split("text", "\n")
    # the numbers that stay by a hash set, and the lines cut once for all of them: work grows with the lines of a text
    both = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "out").alias("stay")))
    left = F.transform(both, lambda b: F.array_join(F.transform(b["stay"], lambda i: b["lines"][i]), "\n"))[0]
    kept = F.when(F.col("out").isNull(), F.col("text")).otherwise(left)
    return numbered.select("doc_id", kept.alias("text"))
