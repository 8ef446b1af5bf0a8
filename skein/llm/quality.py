"""Quality classifier by supervised subword embeddings.

Hashed words and character n-grams of words (with the white space at their
edges) each have a learned vector; a text is the average of its vectors, a
softmax layer gives the score.  Training is plain stochastic gradient descent in
numpy on a bounded sample of labelled rows: ``PER_CLASS`` of each label and
``SAMPLE_BYTES`` of feature ids at most, whole texts.  As the output layer is
linear, a text's score needs only each feature's projection on it, so scoring
reads one number per feature.

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

from skein.llm.common import keep_rows, texts, tidy
from skein.llm.hashed import fetched, gram_ids, labelled_sample, padded_bytes, remainder, row_sums, word_ids
from skein.llm.textops import by_size, release_memory

BITS = 16  # of the ids of each kind of feature
GRAMS = (3, 5)
DIM = 8
PER_CLASS = 1500
SAMPLE_BYTES = 64 << 20
EPOCHS = 12
RATE = 20.0
BATCH = 1 << 20  # bytes of text in memory at once


def features(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, row pointer) for words and for each n-gram length; kinds have ids of their own."""
    padded, offs = padded_bytes(col)
    out = [word_ids(padded, offs, BITS)]
    for k, n in enumerate(GRAMS, 1):
        ids, ptr = gram_ids(padded, offs, n, BITS, in_words=True)
        out.append((ids + (k << BITS), ptr))
    return out


def rows_of(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct ids and their shares, by text."""
    kinds = features(col)
    out = []
    for k in range(len(col)):
        ids, n = np.unique(np.concatenate([i[p[k] : p[k + 1]] for i, p in kinds]), return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


@dataclass
class SubwordModel:
    """A trained model: feature vectors, output layer, and the projection used for scoring."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float, seed: int = 7) -> SubwordModel:
    """SGD over single texts in a shuffled order with a falling rate.

    ``prior`` is the share of label 1 among all training rows; rows are weighted
    so that the sample stands for it.
    """
    rng = np.random.default_rng(seed)
    size = (len(GRAMS) + 1) << BITS
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if not rows:
        return SubwordModel(vectors, output, bias)
    share = max(1e-3, min(1 - 1e-3, float(np.mean(labels))))
    weight = [(1 - prior) / (1 - share), prior / share]
    steps = EPOCHS * len(rows)
    step = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, part = rows[k]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            own = vectors[ids]
            hidden = part @ own
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= np.float32(min(3.0, weight[labels[k]]))
            back = p @ output
            output -= np.float32(0.05) * (rate / np.float32(RATE)) * np.outer(p, hidden)
            bias -= np.float32(0.01) * (rate / np.float32(RATE)) * p
            vectors[ids] = own - rate * np.outer(part, back)
    return SubwordModel(vectors, output, bias)


def _features_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, "text", BATCH):
        found = rows_of(b.column(1))
        yield pa.record_batch([b.column(0), b.column(2), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float32()))], ["doc_id", "label", "ids", "share"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> SubwordModel:
    """Trains on the bounded sample; features are made by the executors."""
    sample, share = labelled_sample(docs, labels, target, PER_CLASS)
    got = fetched(sample.mapInArrow(_features_batch, "doc_id long, label int, ids array<int>, share array<float>"), SAMPLE_BYTES)
    rows = [(np.asarray(i.values, np.int32), np.asarray(s.values, np.float32)) for i, s in zip(got["ids"], got["share"])]
    model = train(rows, got["label"].to_pylist(), share)
    del rows, got
    release_memory()  # the driver lives on
    return model


def scores(col: pa.Array, projection: np.ndarray, offset: float) -> np.ndarray:
    """The score of each text of a column."""
    total, count = np.zeros(len(col)), np.zeros(len(col), np.int64)
    for ids, ptr in features(col):
        total += row_sums(projection[ids], ptr)
        count += np.diff(ptr)
    z = total / np.maximum(count, 1) + offset
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _score(projection: np.ndarray, offset: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", BATCH):
            yield pa.record_batch([b.column(0), pa.array(scores(b.column(1), projection, offset))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row."""
    rows = texts(docs)
    return rows.mapInArrow(_score(model.projection, model.offset), "doc_id long, score double")


@tidy
def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@tidy
def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows, all columns, that the classifier accepts."""
    model = fit(docs, labels)
    projection, offset = model.projection, model.offset
    return keep_rows(docs, lambda col: scores(col, projection, offset) >= threshold)
