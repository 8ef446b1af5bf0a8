"""Hashed n-gram features of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, first_by_hash, texts
from skein.llm.textops import SPACE, hash_spans, mix, text_bytes, word_spans

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def padded_bytes(col: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (mapped by ``table``) with eight zero bytes behind, and offsets."""
    raw, offs = text_bytes(col)
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = raw if table is None else np.take(table, raw)
    return out, offs


def gram_ids(padded: np.ndarray, offs: np.ndarray, n: int, bits: int, in_words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of all n-grams of characters (code points) inside each text, and their row pointer.

    With ``in_words`` an n-gram stays within a word and the white space right before and behind it.
    """
    total = int(offs[-1])
    load = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[:total]
    lead = (padded[:total] & 0xC0) != 0x80
    plain = bool(lead.all())  # one byte a character: the same ids by a shorter way
    start = np.arange(total) if plain else np.flatnonzero(lead)
    ptr = offs if plain else np.searchsorted(start, offs)
    ok = np.ones(len(start), bool)
    size = np.diff(ptr)
    for k in range(1, n):
        ok[ptr[1:][size >= k] - k] = False
    if in_words and n > 2:
        gap = np.concatenate([SPACE[padded[start]], np.zeros(n, bool)])
        for k in range(1, n - 1):
            ok &= ~gap[k : k + len(start)]
    if plain:
        ids = load & _FIRST[min(n, 8)]
        ids = ids[ok]
    else:
        edge = np.concatenate([start, np.full(n, total)])
        at = np.flatnonzero(ok)
        first, wide = edge[at], edge[at + n] - edge[at]
        ids = load[first] & _FIRST[np.minimum(wide, 8)]
        rest, back = np.flatnonzero(wide > 8), 8
        while len(rest):  # characters of several bytes
            left = wide[rest] - back
            ids[rest] = mix(ids[rest] * _ODD ^ (load[np.minimum(first[rest] + back, total - 1)] & _FIRST[np.minimum(left, 8)]))
            back += 8
            rest = rest[left > 8]
    ids *= _ODD
    ids ^= ids >> np.uint64(29)
    ids *= np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
    ids >>= np.uint64(64 - bits)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(ok)])[ptr]


def word_ids(padded: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of all words and their row pointer; a word that repeats the one before it has id 0."""
    s, e, ptr = word_spans(padded, offs)
    h = hash_spans(padded, s, e)
    ids = (h >> np.uint64(64 - bits)).astype(np.int32)
    if len(h) > 1:
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[ptr[:-1][ptr[:-1] < len(h)]] = False
        ids[again] = 0
    return ids, ptr


def row_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for rows without any."""
    if not len(values):
        return np.zeros(len(ptr) - 1)
    total = np.add.reduceat(np.concatenate([values, np.zeros(1, values.dtype)]), ptr[:-1], dtype=np.float64)
    return np.where(np.diff(ptr) > 0, total, 0.0)


def distinct_rows(ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct ids, sorted, and the new row pointer."""
    ids = ids.copy()
    at = ptr.tolist()
    for a, b in zip(at, at[1:]):
        ids[a:b].sort()
    keep = np.ones(len(ids), bool)
    if len(ids) > 1:
        keep[1:] = ids[1:] != ids[:-1]
        keep[ptr[:-1][ptr[:-1] < len(ids)]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return ids[keep], upto[ptr]


def remainder(modulus: int):
    """crc32 of the doc_id written as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from, one for each doc_id.

    Rows whose remainder modulo 5 is 0 are held out: they reach neither the
    sample nor the prior.  A doc_id marked both 0 and 1 tells nothing and falls out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(remainder(5) != 0).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return rows.where("label = most").select("doc_id", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of at most ``per_class`` training rows of each label, chosen by a hash of the doc_id, and the share of label 1.

    The chosen ids, at most twice ``per_class``, are what is broadcast.  Of rows
    that share a doc_id one text is taken.
    """
    rows = cut(training_labels(labels, target), "labels")
    share = rows.agg(F.avg("label")).first()[0]
    picked = [first_by_hash(rows.where(F.col("label") == k), per_class) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    met = texts(docs).join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    return one.select("doc_id", "text", "label"), 0.5 if share is None else float(share)


def fetched(features: DataFrame, most_bytes: int) -> pa.Table:
    """The sample's features (doc_id, label, ids, ...) in the order of a hash, as long as their ids take ``most_bytes`` at most."""
    rows = cut(features.withColumn("spot", F.xxhash64("doc_id")), "sample")
    sizes = rows.select("spot", "doc_id", F.size("ids").alias("n")).toArrow().sort_by([("spot", "ascending"), ("doc_id", "ascending")])
    fits = np.cumsum(4 * np.maximum(0, sizes["n"].to_numpy())) <= most_bytes
    if not fits.all():  # rows are whole texts or nothing
        last = sizes.slice(int(fits.sum()), 1).to_pylist()[0]
        rows = rows.where(F.struct("spot", "doc_id") < F.struct(F.lit(last["spot"]).cast("long").alias("spot"), F.lit(last["doc_id"]).cast("long").alias("doc_id")))
    return rows.drop("spot").toArrow().sort_by("doc_id")


def held_out(ids: np.ndarray, modulus: int = 5, value: int = 0) -> np.ndarray:
    """Whether each doc_id's crc32 leaves ``value``."""
    from skein.llm.textops import crc_fold

    return crc_fold(ids, modulus) == value
