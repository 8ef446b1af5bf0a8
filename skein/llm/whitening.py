"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Every entry c counts as the long x = floor(64 c) + 1000000.  The fit list is each
distinct vector once; its count n and its sums S are exact, so ``n x - S`` is an
exact integer and a centred row is that divided by n, rounded once.  Blocks of
centred rows go through QR in their partitions (TSQR), the triangles meet in a
tree of bounded fan-in, and plane rotations on the driver orthogonalise the
columns of the last triangle, whose size is the square of the dimension.  The
rotations, accumulated, are the components; the lengths of the columns over
sqrt(n) are the standard deviations.  No covariance is formed for them, so small
deviations keep their digits.

Rows whose vector is null or empty, or holds a null or non-finite entry, are left
out.  Where vectors differ in length, the length of most distinct vectors counts
(the greater of equals) and rows of other lengths are left out.  Entries whose x
is no long saturate at 2**62.  Repeated rows and null ids stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, cut, tidy

SCALE, SHIFT = 64, 1_000_000  # shifting leaves n x - S alone, so only floor(64 c) is kept
LARGEST = 2**62
FAN = 8  # triangles that meet in one task
BLOCK_BYTES = 8 << 20  # of centred rows that go through QR at once
SWEEPS = 60


def _list_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries as double, offsets, whether the row is whole: not null, not empty, all entries finite)."""
    flat, offs = col.values, np.asarray(col.offsets).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = (np.diff(offs) > 0) & (bad[offs[1:]] == bad[offs[:-1]])
    if col.null_count:
        whole &= col.is_valid().to_numpy(zero_copy_only=False)
    return values, offs, whole


def _packed(y: np.ndarray) -> list[bytes]:
    """Each row's integers in the narrowest of four widths; equal rows are equal bytes."""
    most = np.maximum(y.max(1), -(y.min(1) + 1))
    out: list[bytes] = [b""] * len(y)
    least = -1
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        limit = int(np.iinfo(kind).max)
        at = np.flatnonzero((most > least) & (most <= limit))
        for k, row in zip(at.tolist(), y[at].astype(kind)):
            out[k] = row.tobytes()
        least = limit
    return out


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values, offs, whole = _list_rows(b.column(1))
        size = np.diff(offs)
        for dim in np.unique(size[whole]).tolist():
            at = np.flatnonzero(whole & (size == dim))
            c = values[offs[at][:, None] + np.arange(dim)]
            y = np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64)
            yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array([dim] * len(at), pa.int32()), pa.array(_packed(y), pa.binary())], ["vec_id", "dim", "y"])


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, y): the whole vectors as integers, packed."""
    bounded_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_integers, "vec_id long, dim int, y binary")


def _unpacked(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers from their bytes."""
    raw = col.to_pylist()
    width = np.fromiter((len(x) // dim for x in raw), np.int64, len(raw))
    out = np.empty((len(raw), dim), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(raw[k] for k in at.tolist()), f"<i{w}").reshape(len(at), dim)
    return out


def _centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n y - S, exact: longs where they hold it, Python's integers otherwise."""
    most = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if most * n + max(map(abs, sums)) < LARGEST:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def _sums(dim: int):
    """Count and sums of the fit list by partition; key -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for b in batches:
            y = _unpacked(b.column(0), dim)
            n += len(y)
            wide = len(y) and max(int(y.max()), -int(y.min())) * len(y) >= LARGEST
            total = total + (y.astype(object) if wide else y).sum(0).astype(object)
        if n:
            yield pa.record_batch([pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], ["k", "s"])

    return run


def _triangles(n: int, sums: list[int]):
    """One triangle for the centred rows of a partition."""
    dim = len(sums)
    step = max(dim, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for b in batches:
            for first in range(0, b.num_rows, step):
                rows = (_centred(_unpacked(b.column(0).slice(first, step), dim), n, sums) / n).astype(np.float64)
                r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], ["r"])

    return run


def _met(dim: int):
    """One triangle from the few of a group."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.float64).reshape(-1, dim) for x in group["r"].to_pylist()]
        r = np.linalg.qr(np.concatenate(rows), mode="r")
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list, by a tree over its partitions."""
    dim = len(sums)
    found = fit.select("y").mapInArrow(_triangles(n, sums), "r binary")
    found = cut(found.withColumn("node", F.spark_partition_id().cast("long")), "triangles")
    top = found.agg(F.max("node")).first()[0]
    while top:  # a level for each power of the fan-in
        found = found.groupBy(F.floor(F.col("node") / FAN).alias("to")).applyInArrow(_met(dim), "node long, r binary")
        top //= FAN
    return np.frombuffer(found.first()["r"], np.float64).reshape(-1, dim)


def rotated(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, components as rows) of a one-sided Jacobi decomposition, longest first.

    A round of a sweep rotates disjoint pairs of columns, each pair once in a
    sweep as in a tournament; sweeps end when all columns are orthogonal.
    """
    dim = r.shape[1]
    m = dim + dim % 2
    a = np.zeros((m, r.shape[0]))  # columns of R as rows
    a[:dim] = r.T
    v = np.eye(m)
    seats = np.arange(m)
    eps = np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(m - 1):
            p, q = seats[: m // 2], seats[m // 2 :][::-1]
            x, y = a[p], a[q]
            alpha, beta, gamma = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            bound = np.sqrt(alpha) * np.sqrt(beta)
            off = np.divide(np.abs(gamma), bound, out=np.zeros_like(bound), where=bound > 0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > eps
            if turn.any():
                with np.errstate(over="ignore"):
                    zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                    t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = (c * t)[:, None]
                c = c[:, None]
                p, q = p[turn], q[turn]
                for of in (a, v):
                    x, y = of[p], of[q]
                    of[p], of[q] = c * x - s * y, s * x + c * y
            seats[1:] = np.roll(seats[1:], 1)
        if worst <= 8 * eps:
            break
    a, v = a[:dim], v[:dim, :dim]
    length = np.sqrt((a * a).sum(1))
    order = np.argsort(-length, kind="stable")
    return length[order], v[order]


@dataclass(frozen=True)
class Whitening:
    """What was fitted: count, exact sums of x, components as rows, standard deviations, and the check of the result."""

    n: int
    sums: list[int]
    components: np.ndarray  # dim x dim, by falling deviation
    deviations: np.ndarray
    explained: np.ndarray  # share of each component in the trace
    identity_error: float | None

    def projection(self, most: int) -> np.ndarray:
        """Columns by which a centred row is multiplied; NaN for a component without variance."""
        scale = np.where(self._flat(), np.nan, self.deviations)
        return (self.components / scale[:, None])[:most].T

    def _flat(self) -> np.ndarray:
        d = self.deviations
        return d <= len(d) * np.finfo(np.float64).eps * max(float(d.max(initial=0.0)), np.finfo(np.float64).tiny)

    def transform(self, embeddings: DataFrame, most: int = 16) -> DataFrame:
        """(vec_id, deviation, whitened) of every whole vector: the first ``most`` components.

        deviation is the sum over dimensions of (n x - S)**2, null where no long
        holds it; whitened is null for a component without variance.
        """
        rows = integer_vectors(embeddings).where(F.col("dim") == len(self.sums)).select("vec_id", "y")
        return rows.mapInArrow(_whitened(self.n, self._own_sums(), self.projection(most)), "vec_id long, deviation long, whitened array<double>")

    def _own_sums(self) -> list[int]:
        return [s - self.n * SHIFT for s in self.sums]


def _deviation(d: np.ndarray) -> list[int | None]:
    if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < LARGEST:
        return (d * d).sum(1).tolist()
    return [v if v < 2**63 else None for v in (sum(int(e) ** 2 for e in row) for row in d)]


def _whitened(n: int, sums: list[int], by: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _centred(_unpacked(b.column(1), len(sums)), n, sums)
            w = (d / n).astype(np.float64) @ by
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32()), flat)
            yield pa.record_batch([b.column(0), pa.array(_deviation(d), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return run


def _products(n: int, sums: list[int], by: np.ndarray):
    """Sums of the whitened rows (j = -1) and of their products, by partition."""
    k = by.shape[1]
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, plain = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = (_centred(_unpacked(b.column(0), len(sums)), n, sums) / n).astype(np.float64) @ by
            square += w.T @ w
            plain += w.sum(0)
        yield pa.record_batch([pa.array(np.concatenate([i, np.arange(k)]), pa.int32()), pa.array(np.concatenate([j, np.full(k, -1)]), pa.int32()), pa.array(np.concatenate([square[i, j], plain]))], ["i", "j", "s"])

    return run


def identity_error(fit: DataFrame, n: int, sums: list[int], by: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; None without a component that varies."""
    by = by[:, ~np.isnan(by).any(0)]
    k = by.shape[1]
    if not k:
        return None
    got = fit.select("y").mapInArrow(_products(n, sums, by), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    mean, square = np.zeros(k), np.zeros((k, k))
    for r in got:
        if r["j"] < 0:
            mean[r["i"]] = r["s"] / n
        else:
            square[r["i"], r["j"]] = square[r["j"], r["i"]] = r["s"] / n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(embeddings: DataFrame, checked: int = 16) -> Whitening | None:
    """Fits on each distinct vector once; None where no vector is whole.  ``checked`` components enter the identity error."""
    fit = cut(integer_vectors(embeddings).select("dim", "y").distinct(), "fit")
    size = fit.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if size is None:
        return None
    dim = size["dim"]
    fit = fit.where(F.col("dim") == dim)
    total = {r["k"]: int(r["s"]) for r in fit.select("y").mapInArrow(_sums(dim), "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    n, own = total[-1], [total[k] for k in range(dim)]
    length, components = rotated(triangle(fit, n, own))
    variance = length**2
    model = Whitening(n, [s + n * SHIFT for s in own], components, length / np.sqrt(n), variance / (variance.sum() or 1.0), None)
    error = identity_error(fit, n, own, model.projection(checked))
    return Whitening(n, model.sums, components, model.deviations, model.explained, error)


@tidy
def whitened_components(embeddings: DataFrame, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component up to ``most``."""
    spark = embeddings.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(embeddings, most)
    if model is None:
        return spark.createDataFrame([], kind)
    share = F.array(*(F.lit(float(x)) for x in model.explained[:most]))
    rows = model.transform(embeddings, most).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    error = F.lit(model.identity_error).cast("double")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), error.alias("identity_error"))
