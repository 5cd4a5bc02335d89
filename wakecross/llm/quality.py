"""A quality classifier from positive and unlabelled documents."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import shared, words

FOLDS = 3
# Bounds of the samples that the model is fitted on: trusted positives, and documents whatever their label.
POSITIVES = 8_000
UNLABELLED = 8_000

# Classes of characters, whose pairs are the features.
_CLASSES = [
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n\x0b\x0c", ".,;:", "!?", "'\"-()",
    "*#$%&@^~=+", "|\\/<>[]{}_`",
]
N_CLASSES = len(_CLASSES) + 2
_CLASS = np.full(256, len(_CLASSES) + 1, np.int64)
_CLASS[128:] = len(_CLASSES)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
# Shares of words equal to the one before, two before, three before; mean word length; shares of repeated words and of short texts.
N_FEATURES = N_CLASSES * N_CLASSES + 6


def features(column: pa.Array) -> np.ndarray:
    """One row per text, of roots of shares, so that a little junk already shows. An empty text is all zeros but one."""
    data, offsets = words.buffers(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    kind = _CLASS[data]
    same = row[1:] == row[:-1]
    pair = (row[1:] * (N_CLASSES * N_CLASSES) + kind[:-1] * N_CLASSES + kind[1:])[same]
    counts = np.bincount(pair, minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, : N_CLASSES * N_CLASSES] = counts / np.maximum(lengths - 1, 1)[:, None]
    starts, ends, first = words.spans(data, offsets, words.SPACED)
    hashes = words.hashed(words.LOWER[data], starts, ends)
    n_words = np.diff(first)
    word_row = words.rows_of(first)
    for lag in (1, 2, 3):
        again = (hashes[lag:] == hashes[:-lag]) & (word_row[lag:] == word_row[:-lag])
        out[:, -7 + lag] = np.bincount(word_row[lag:][again], minlength=n) / np.maximum(n_words, 1)
    out[:, -3] = (ends - starts).sum() and np.bincount(word_row, ends - starts, n) / np.maximum(n_words, 1) / 20
    order = np.lexsort((hashes, word_row))
    h, r = hashes[order], word_row[order]
    repeated = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    out[:, -2] = np.bincount(r[1:][repeated], minlength=n) / np.maximum(n_words, 1)
    out[:, -1] = 1 / (1 + n_words)
    return np.sqrt(out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _softplus(z):
    return np.logaddexp(0, z)


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = 800, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Adam on the non-negative unbiased risk of a linear model; without a prior, on plain positive against unlabelled."""
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (p - mean) / scale, (u - mean) / scale
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        # Slopes of the losses log(1 + exp(-g)) as positive and log(1 + exp(g)) as negative.
        up, down = -_sigmoid(-gp) / len(p), _sigmoid(gp) / len(p)
        low = _sigmoid(gu) / len(u)
        if prior is None:
            cp, cu = up, low
        elif _softplus(gu).mean() - prior * _softplus(gp).mean() >= 0:
            cp, cu = prior * (up - down), low
        else:
            # The unlabelled risk without its positives fell below zero: undo, else the model learns the sample by heart.
            cp, cu = prior * down, -low
        g = np.append(cp @ p + cu @ u + decay * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, float(b))


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled.

    A set of documents holds at least prior times its share of the positives. Sets are cut at levels of a
    score that tells positives from unlabelled, fitted on one half and measured on the other;
    the least ratio bounds the prior from above, and is near it once a level holds no negatives.
    """
    model = _fit(p[::2], u[::2], None, steps=300)
    own, other = np.sort(model.margin(p[1::2])), np.sort(model.margin(u[1::2]))
    levels = own[(np.linspace(0.02, 0.6, 30) * len(own)).astype(int)]
    above = [1 - np.searchsorted(x, levels) / len(x) for x in (own, other)]
    return float(np.clip((above[1] / above[0]).min(), 0.01, 0.99))


def train(p: np.ndarray, u: np.ndarray) -> Model:
    """The model from features of trusted positives and of unlabelled documents; one that always says 0.5 if either is missing."""
    if len(p) < 2 or len(u) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    p, u = p.astype(np.float64), u.astype(np.float64)
    return _fit(p, u, class_prior(p, u))


def fold(folds: int = FOLDS):
    """crc32 of doc_id as text, modulo folds. A row without doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch):
            rows = [r.tobytes() for r in features(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array(rows, pa.binary())], names=["positive", "x"])


def fit(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits the model to samples of bounded size: at most ``positives`` and ``unlabelled`` documents, chosen by hash of doc_id.

    Only labels of rows outside fold 1 are used, and of these only that quality is 1. Texts count whole, whatever
    their length, and a missing one as empty: each comes to the driver as one row of features.
    """
    outside = documents.where(fold() != 1).select("doc_id", F.col("text").cast("string").alias("text"))
    trusted = labels.where("quality = 1").where(fold() != 1).select("doc_id").distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    others = outside.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    chosen = trusted.select("doc_id", F.lit(True).alias("positive")).union(others.select("doc_id", F.lit(False)))
    # At most a fixed number of ids.
    sample = outside.join(F.broadcast(chosen), "doc_id").select("positive", "text")
    rows = sample.mapInArrow(shared.released(_featured), "positive boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
    order = np.lexsort((x[:, -1], x[:, 3], x[:, -3])) if len(x) else np.zeros(0, int)
    positive = np.array(rows.column("positive").to_pylist(), bool)[order]
    x = x[order]
    shuffled = np.random.default_rng(7).permutation(len(x))
    x, positive = x[shuffled], positive[shuffled]
    return train(x[positive], x[~positive])


def score(documents: DataFrame, model: Model, *keep: str) -> DataFrame:
    """A column score for every row, from its whole text alone; null and empty texts are scored as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "_text"):
                rest = part.drop_columns(["_text"])
                values = pa.array(model.score(features(part.column("_text")).astype(np.float64)), pa.float64())
                yield pa.RecordBatch.from_arrays([*rest.columns, values], names=[*rest.schema.names, "score"])

    frame = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    return frame.mapInArrow(shared.released(run), words.extended(frame, "score double"))


def keep(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents scored ``least`` or more, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                good = model.score(features(part.column("text")).astype(np.float64)) >= least
                yield part.filter(pa.array(good))

    return documents.mapInArrow(shared.released(run), documents.schema)
