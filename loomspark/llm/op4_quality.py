"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's features are hashed counts of character-shape trigrams (letters, capitals, digits, spaces and each punctuation mark
as classes), of words, and of words that repeat the one before. Labelled rows (a bounded sample) give the weights and, by
singular value decomposition, a projection; the labelled vectors are broadcast. Every document is projected, its cosine with
every labelled vector is computed exactly in blocks, and the nearest k vote with weights that grow with similarity; vectors as
near as the k-th vote too, so that the order of the sample decides nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold, labelled
from .textops import chunks, load, words_of

FOLDS, HELD_OUT, LABEL = 4, 2, "quality"
SHAPES, WORDS, EXTRA = 768, 240, 16
SIZE = SHAPES + WORDS + EXTRA
#: Bounds of what is learned from and broadcast.
MOST_LABELLED, DIMENSIONS, NEIGHBOURS = 4000, 48, 25

_CLASS = np.full(256, 7, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[32], _CLASS[10] = 4, 5
_CLASS[128:] = 1
for _i, _c in enumerate("!#$%&*|.,;:?-_/<>@()[]{}=+~^\"'"):
    _CLASS[ord(_c)] = 8 + _i


def features(texts: pa.Array) -> np.ndarray:
    """Counts (float32), one row for each text."""
    w = words_of(texts)
    n = len(texts)
    raw = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = raw.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros((n, SIZE), np.float32)
    owner = np.repeat(np.arange(n), np.diff(w.offsets))
    kind = _CLASS[buf]
    if len(buf) > 2:
        tri = ((kind[:-2] * 64 + kind[1:-1]) * 64 + kind[2:]) * 2654435761 % (1 << 32) * SHAPES >> 32
        inside = owner[:-2] == owner[2:]
        out[:, :SHAPES] = np.bincount(owner[:-2][inside] * SHAPES + tri[inside], minlength=n * SHAPES).reshape(n, SHAPES)
    h, own = w.hashes(), w.owner()
    if len(h):
        out[:, SHAPES : SHAPES + WORDS] = np.bincount(own * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        same = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        repeats = np.bincount(own[1:][same], minlength=n)
        words = np.maximum(1, np.bincount(own, minlength=n))
        # Distinct words for each text, the share of repeats, capitals and marks, each as one of four columns by its size.
        order = np.lexsort((h, own))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])])
        distinct = np.bincount(own[order][new], minlength=n) / words
        chars = np.maximum(1, np.diff(w.offsets))
        for i, x in enumerate((repeats / words, 1 - distinct, np.bincount(owner[kind == 2], minlength=n) / chars, np.bincount(owner[kind >= 7], minlength=n) / chars)):
            out[np.arange(n), SHAPES + WORDS + 4 * i + np.minimum(3, (np.maximum(0, x) * 8).astype(int))] = 1
    return out


@dataclass
class Space:
    idf: np.ndarray
    project: np.ndarray
    mean: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of counts."""
        v = (_weigh(counts, self.idf) - self.mean) @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, v: np.ndarray, k: int) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest, smoothed to the sample's rate."""
        rate = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(v), rate)
        k = min(k, len(self.labels))
        out = np.empty(len(v))
        for a in range(0, len(v), 512):
            cosine = v[a : a + 512] @ self.vectors.T
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            row, near = np.nonzero(cosine >= least - 1e-6)  # ties count however they are rounded
            weight = np.exp(8 * cosine[row, near].astype(float) - 8)
            votes, total = (np.bincount(row, x, len(cosine)) for x in (weight * self.labels[near], weight))
            out[a : a + 512] = (votes + 0.02 * rate) / (total + 0.02)
        return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    for a, b, share in ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.5), (SHAPES + WORDS, SIZE, 1.0)):
        x[:, a:b] *= share / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


def fit(sample: DataFrame, dimensions: int = DIMENSIONS) -> Space:
    """From a bounded sample (text, label)."""

    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features(b.column("text"))], pa.binary()), b.column("label")], ["x", "label"])

    rows = sample.mapInArrow(run, "x binary, label int").collect()
    rows.sort(key=lambda r: bytes(r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, SIZE)
    labels = np.array([r["label"] for r in rows], float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.3
    weighed = _weigh(x, idf)
    mean = weighed.mean(axis=0) if len(x) else np.zeros(SIZE, np.float32)
    _, vectors = np.linalg.eigh(((weighed - mean).T @ (weighed - mean)).astype(float))
    space = Space(idf, np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]).astype(np.float32), mean, np.zeros((0, dimensions), np.float32), labels)
    space.vectors = space.place(x)
    return space


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.

    Null text counts as empty, which has no features and is placed like any other. Whole texts are read, however long.
    Without labelled rows every score is 0.5. Repeated rows are each scored, equal texts alike; other columns aren't read.
    An empty table gives no rows.
    """
    space = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, labels, LABEL, FOLDS, HELD_OUT, most)))

    def run(batches):
        for b in chunks(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(space.value.vote(space.value.place(features(b.column("text"))), k))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
