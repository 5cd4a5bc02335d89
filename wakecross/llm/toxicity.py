"""Toxic texts by two Kneser-Ney models that share what they back off to."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import words
from wakecross.llm.language_model import BEGIN, discounts, held_out

FOLDS = 5
# Bounds of the sample that the models are counted on; longer texts are not taken.
TOXIC = 3_000
ORDINARY = 6_000
SAMPLE_CHARS = 50_000
# Every third sampled text sets the scale of the scores and is not counted.
SCALE_EVERY = 3
WINDOWS = (4, 16)
# One word counts for so much at most; evidence below the first is common to ordinary texts.
WEAK, STRONG = 1.0, 4.0
# Counts of words up to this are left to the shared counts whole.
RARE = 3


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the words before them, and each row's first word."""
    hashes, first = words.word_hashes(column, words.ALNUM)
    before = np.concatenate([[BEGIN], hashes[:-1]]) if len(hashes) else hashes.copy()
    before[first[:-1][first[:-1] < len(hashes)]] = BEGIN
    return hashes, before, first


def _key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return words.mix(word + words.mix(before ^ np.uint64(0x9E3779B97F4A7C15)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key among sorted keys, the last index plus one where it is missing."""
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), int)


class Models:
    """Both models, of ordinary (0) and toxic (1) texts, over pairs counted by the distinct words that follow.

    Counting what differs, at both orders, keeps near copies of one text from passing for an expression.
    """

    def __init__(self, word: np.ndarray, before: np.ndarray, counts: np.ndarray):
        """Distinct pairs with their counts in ordinary and toxic texts (two columns)."""
        self.words, w = np.unique(word, return_inverse=True)
        self.contexts, v = np.unique(before, return_inverse=True)
        n_words = len(self.words)
        # Shared: in how many contexts a word stands in any text; unknown words get the share of half a context.
        spread = np.append(np.bincount(w, minlength=n_words) + 0.5, 0.5)
        shared = spread / spread.sum()
        self.single, self.total, self.mass, self.kept = [], [], [], []
        for k in (0, 1):
            n = counts[:, k]
            seen = n > 0
            types = np.bincount(w[seen], minlength=n_words)
            # Rare words are no evidence of a class: the discount is at least the whole of a small count.
            d = np.maximum(discounts(*[int((types == j).sum()) for j in (1, 2, 3, 4)]), np.minimum(np.arange(4), RARE))
            left = d[np.minimum(types, 3)]
            total = max(int(types.sum()), 1)
            rest = np.append(types - left, 0) / total
            self.single.append(rest + (1 - rest.sum()) * shared)
            e = discounts(*[int((n == j).sum()) for j in (1, 2, 3, 4)])
            # A pair seen once is no evidence: its whole count goes to the words alone.
            e[1] = 1.0
            self.total.append(np.append(np.bincount(v, n, len(self.contexts)), 0))
            self.mass.append(np.append(np.bincount(v, np.where(seen, e[np.minimum(n, 3)], 0), len(self.contexts)), 0))
            self.kept.append(np.maximum(n - e[np.minimum(n, 3)], 0))
        self.neutral = float(np.log(self.single[1][-1] / self.single[0][-1]))
        strong = (self.kept[0] > 0) | (self.kept[1] > 0)
        keys = _key(word[strong], before[strong])
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.kept = [np.append(k[strong][order], 0).astype(np.float32) for k in self.kept]

    def ratio(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log likelihood of each word under the toxic model less that under the ordinary one."""
        w, v, p = _find(self.words, word), _find(self.contexts, before), _find(self.pairs, _key(word, before))
        logs = []
        for k in (0, 1):
            total = self.total[k][v]
            joint = (self.kept[k][p] + self.mass[k][v] * self.single[k][w]) / np.maximum(total, 1)
            logs.append(np.log(np.where(total > 0, joint, self.single[k][w])))
        # Relative to a word that neither model knows, so that text of rare words only is neutral.
        return logs[1] - logs[0] - self.neutral


N_EVIDENCE = 3 + len(WINDOWS)


def evidence(models: Models, column: pa.Array) -> np.ndarray:
    """Per text, normalised by length: mean ratio; what exceeds ``WEAK``, as a sum on a log scale and per root of the
    length; and the highest mean over windows of each width. No words: zeros."""
    word, before, first = _pairs(column)
    ratio = np.clip(models.ratio(word, before), -STRONG, STRONG)
    n = len(first) - 1
    counts = np.diff(first)
    out = np.zeros((n, N_EVIDENCE))

    def summed(x):
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums, sums[first[1:]] - sums[first[:-1]]

    sums, whole = summed(ratio)
    strong = summed(np.maximum(ratio - WEAK, 0))[1]
    out[:, 0] = whole / np.maximum(counts, 1)
    out[:, 1] = np.log1p(strong)
    out[:, 2] = strong / np.sqrt(np.maximum(counts, 1))
    row = words.rows_of(first)
    full = np.flatnonzero(counts)
    for k, width in enumerate(WINDOWS, 3):
        # A window that starts near the end is shorter, and counts as if neutral words followed.
        stop = np.minimum(np.arange(len(word)) + width, first[row + 1])
        if len(full):
            out[full, k] = np.maximum.reduceat((sums[stop] - sums[:-1]) / width, first[:-1][full])
    return out


@dataclass
class Scale:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -60, 60)))


def _scale(x: np.ndarray, toxic: np.ndarray, share: float) -> Scale:
    """Logistic regression, weighted to the share of toxic texts."""
    if not len(x) or toxic.all() or not toxic.any():
        return Scale(np.zeros(x.shape[1]), float(np.log(share / (1 - share))))
    spread = x.std(0) + 1e-6
    z = np.c_[x / spread, np.ones(len(x))]
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -60, 60)))
        slope = z.T @ (weight * (p - toxic)) + 1e-1 * np.append(b[:-1], 0)
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(b))
        b = b - np.linalg.solve(curve, slope)
    return Scale(b[:-1] / spread, float(b[-1]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair with the word after it (the last pair of a text with its beginning)."""
    for batch in batches:
        for part in words.chunks(batch):
            word, before, first = _pairs(part.column("text"))
            after = np.concatenate([word[1:], [BEGIN]]) if len(word) else word
            after[first[1:][np.diff(first) > 0] - 1] = BEGIN
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[words.rows_of(first)]
            columns = [pa.array(x.view(np.int64)) for x in (word, before, after)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(toxic, pa.int32())], names=["word", "before", "after", "toxic"])


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Models, Scale]:
    """Counts both models in Spark on a sample of bounded size, and sets the scale on a part that is left out.

    Labels come from rows outside fold 0 only. The sample is at most ``TOXIC`` and ``ORDINARY`` distinct texts of at
    most ``SAMPLE_CHARS`` characters, chosen by hash; tables of that size come to the driver and go to all tasks.
    """
    own = labels.where("toxic is not null").where(~held_out(FOLDS)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = min(max(sizes.get(1, 0) / max(sum(sizes.values()), 1), 0.001), 0.999)
    mark = F.xxhash64("doc_id", F.lit(3))
    chosen = [own.where(F.col("toxic") == k).orderBy(mark, "doc_id").limit(n) for k, n in ((0, ORDINARY), (1, TOXIC))]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    texts = documents.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(ids, "doc_id")
    # Copies would count their words over and over.
    texts = texts.groupBy("toxic", "text").agg(F.min(mark).alias("mark")).select("toxic", "text", "mark")
    left_out = F.pmod("mark", F.lit(SCALE_EVERY)) == 0
    pairs = (
        texts.where(~left_out).select("toxic", "text")
        .mapInArrow(_counted, "word long, before long, after long, toxic int")
        .groupBy("word", "before", "after")
        .agg(F.max(1 - F.col("toxic")).alias("n0"), F.max("toxic").alias("n1"))
        .groupBy("word", "before")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .toArrow()
    )
    columns = {name: pairs.column(name).combine_chunks().to_numpy() for name in pairs.schema.names}
    counts = np.stack([columns["n0"], columns["n1"]], 1).astype(np.int64)
    models = Models(columns["word"].view(np.uint64), columns["before"].view(np.uint64), counts)
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                rows = [r.tobytes() for r in evidence(shared.value, part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(rows, pa.binary())], names=["toxic", "x"])

    rest = texts.where(left_out).select("toxic", "text").mapInArrow(weigh, "toxic int, x binary").toArrow()
    x = np.frombuffer(b"".join(rest.column("x").to_pylist()), np.float64).reshape(-1, N_EVIDENCE)
    return shared, _scale(x, np.array(rest.column("toxic").to_pylist(), bool), share)


def score(documents: DataFrame, fitted, *keep: str) -> DataFrame:
    """A column score for every row, from its whole text; null and empty texts hold no evidence and get the base rate."""
    models, scale = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "_text"):
                rest = part.drop_columns(["_text"])
                values = pa.array(scale.score(evidence(models.value, part.column("_text"))), pa.float64())
                yield pa.RecordBatch.from_arrays([*rest.columns, values], names=[*rest.schema.names, "score"])

    frame = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    return frame.mapInArrow(run, words.extended(frame, "score double"))
