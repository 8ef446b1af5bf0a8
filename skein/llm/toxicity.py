"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams, A-Z lower-cased, every
white space a plain space.
Each feature is scaled by the log of the ratio of its smoothed shares among
toxic and other labelled texts, drawn towards 0 by ``CERTAIN`` standard errors of
that log (what chance may explain counts nothing, or long texts would add up its
noise); logistic regression is trained on the scaled features in numpy, on a bounded sample of labelled rows: ``PER_CLASS`` of each
label and ``SAMPLE_BYTES`` of feature ids at most, whole texts.

Held-out rows (crc32 of the doc_id modulo 5 is 0) are never learned from, nor
counted in the share of label 1.  A doc_id with both labels is left out.

Only the text is an input of the score.  Null counts as empty; a text without
features gets the score of the bias alone; without labelled rows every score is
0.5.  Repeated rows score alike, an empty table gives an empty result, extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import texts, tidy
from skein.llm.hashed import distinct_rows, fetched, gram_ids, labelled_sample, padded_bytes, remainder, row_sums
from skein.llm.textops import LOWER, SPACE, by_size

BITS = 18
GRAMS = (4, 6)
PER_CLASS = 2500
SAMPLE_BYTES = 64 << 20
SMOOTH = 1.0
CERTAIN = 2.0
EPOCHS = 8
RATE = 0.2
DECAY = 1e-4
BATCH = 1 << 20

#: Lower case, and every white space a plain space.
PLAIN = LOWER.copy()
PLAIN[np.flatnonzero(SPACE)] = 32


def features(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct ids, row pointer) for each n-gram length."""
    padded, offs = padded_bytes(col, PLAIN)
    out = []
    for k, n in enumerate(GRAMS):
        ids, ptr = distinct_rows(*gram_ids(padded, offs, n, BITS))
        out.append((ids + np.int32(k << BITS), ptr))
    return out


@dataclass
class RatioModel:
    """Weights of the features (ratio times coefficient) and the bias."""

    weights: np.ndarray
    bias: float


def train(rows: list[np.ndarray], labels: list[int], prior: float, seed: int = 11) -> RatioModel:
    """Log-count ratios of the features, then logistic regression by AdaGrad on scaled features."""
    size = len(GRAMS) << BITS
    if not rows or len(set(labels)) < 2:
        return RatioModel(np.zeros(size, np.float32), 0.0)
    seen = np.full((2, size), SMOOTH)
    for ids, label in zip(rows, labels):
        seen[label][ids] += 1
    n = [labels.count(0) + 2 * SMOOTH, labels.count(1) + 2 * SMOOTH]
    ratio = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
    unsure = CERTAIN * np.sqrt(1 / seen[0] + 1 / seen[1])
    ratio = (np.sign(ratio) * np.maximum(0, np.abs(ratio) - unsure)).astype(np.float32)
    rows = [ids[ratio[ids] != 0] for ids in rows]
    rng = np.random.default_rng(seed)
    w, power = np.zeros(size, np.float32), np.full(size, 1e-2, np.float32)
    bias, bias_power = 0.0, 1e-2
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids = rows[k]
            scale = ratio[ids]
            z = float((w[ids] * scale).sum()) + bias
            g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[k]
            grad = np.float32(g) * scale + np.float32(DECAY) * w[ids]
            power[ids] += grad * grad
            w[ids] -= np.float32(RATE) * grad / np.sqrt(power[ids])
            bias_power += g * g
            bias -= RATE * g / np.sqrt(bias_power)
    share = np.mean(labels)
    bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share))) if 0 < prior < 1 else 0.0
    return RatioModel((w * ratio).astype(np.float32), float(bias))


def _features_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, "text", BATCH):
        kinds = features(b.column(1))
        ids = [np.concatenate([i[p[k] : p[k + 1]] for i, p in kinds]) for k in range(b.num_rows)]
        yield pa.record_batch([b.column(0), b.column(2), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "label", "ids"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> RatioModel:
    """Trains on the bounded sample; features are made by the executors."""
    sample, share = labelled_sample(docs, labels, target, PER_CLASS)
    got = fetched(sample.select("doc_id", "text", "label").mapInArrow(_features_batch, "doc_id long, label int, ids array<int>"), SAMPLE_BYTES)
    return train([np.asarray(i.values, np.int32) for i in got["ids"]], got["label"].to_pylist(), share)


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", BATCH):
            z = np.full(b.num_rows, bias)
            for ids, ptr in features(b.column(1)):
                z += row_sums(weights[ids], ptr)
            yield pa.record_batch([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: RatioModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row."""
    rows = texts(docs)
    return rows.mapInArrow(_score(model.weights, model.bias), "doc_id long, score double")


@tidy
def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
