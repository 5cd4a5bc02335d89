"""Language identification: averaged hashed subword embeddings with a linear softmax, and a calibrated rejection."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import shared, words
from wakecross.llm.language_model import held_out

FOLDS = 5
# Bound of the labelled sample that the model is fitted on, shared equally by the languages; every fourth text sets the calibration.
SAMPLE = 3_200
CALIBRATE_EVERY = 4
# Subwords are runs of so many bytes of a word with its borders, hashed into 2**BITS rows of an embedding table.
WIDTHS = (2, 3, 4, 5)
BITS = 14
DIMENSIONS = 16
PASSES = 12
RATE = 0.5
BATCH = 16
# Share of wrong languages allowed among the texts that are not rejected.
ERRORS = 0.005
SCORE_BYTES = 1 << 20

_ADDED = ["lang_pred", "score", "rejected"]
_BORDER = 0x20
_BYTES = np.where(words.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)), words.LOWER, _BORDER).astype(np.uint8)


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every subword of all rows, and each row's first one.

    Letters and all bytes of non-ASCII characters make words, after lower-casing A-Z; anything else is a border.
    A subword may begin or end with a border, but holds none inside.
    """
    data, offsets = words.buffers(column)
    n = len(offsets) - 1
    # One border before every row, one after the last.
    padded = np.full(len(data) + n + 1, _BORDER, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = _BYTES[data]
    opens = offsets + np.arange(n + 1)
    borders = np.concatenate([[0], np.cumsum(padded == _BORDER)])
    places, buckets = [], []
    value = np.zeros(len(padded), np.uint64)
    for width in range(1, max(WIDTHS) + 1):
        # A polynomial of the window's bytes, one more with each width.
        value = value[: len(padded) - width + 1] * np.uint64(0x100000001B3) + padded[width - 1 :]
        if width not in WIDTHS:
            continue
        at = np.arange(len(value))
        inside = borders[at + width - 1] - borders[np.minimum(at + 1, len(padded))]
        whole = borders[at + width] - borders[at]
        good = np.flatnonzero((inside == 0) & (whole < width))
        places.append(good)
        buckets.append((words.mix(value[good] + np.uint64(width << 56)) >> np.uint64(64 - BITS)).astype(np.int64))
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(place[order], opens)


def shares(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row its buckets and their shares of the row's subwords."""
    bucket, first = subwords(column)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        keys, counts = np.unique(bucket[a:b], return_counts=True)
        out.append((keys.astype(np.uint16), (counts / max(b - a, 1)).astype(np.float32)))
    return out


@dataclass
class Model:
    """``table`` has a row of logits per bucket: the embedding table times the softmax weights."""

    langs: list[str]
    table: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    embeddings: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"embeddings": None}

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def logits(self, column: pa.Array) -> np.ndarray:
        """The mean over each row's subwords; a row without any is all zeros.

        The mean of embeddings times the weights is the mean of their products, which are kept ready.
        """
        bucket, first = subwords(column)
        sums = np.zeros((len(first) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            sums[full] = np.add.reduceat(self.table[bucket], first[:-1][full], axis=0)
        return sums / np.maximum(np.diff(first), 1)[:, None]


def train(rows: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray, langs: list[str], seed: int = 11) -> Model:
    """Stochastic gradient descent on the log loss of small batches, at a rate that falls to nothing.

    Embeddings start at zero, so subwords that training has not seen stand for no language. The rate of the
    table is larger by the mean squared length of a text's shares, by which steps there are shorter.
    """
    rng = np.random.default_rng(seed)
    embeddings = np.zeros((1 << BITS, DIMENSIONS), np.float32)
    weights = rng.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, len(langs))).astype(np.float32)
    rows_used = [k for k in range(len(rows)) if len(rows[k][0])]
    if rows_used and len(langs) > 1:
        scale = 1 / max(float(np.mean([np.square(rows[k][1]).sum() for k in rows_used])), 1e-6)
        steps = PASSES * -(-len(rows_used) // BATCH)
        step = 0
        for _ in range(PASSES):
            order = rng.permutation(rows_used)
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                rate = RATE * (1 - step / steps)
                step += 1
                size = [len(rows[j][0]) for j in some]
                bucket = np.concatenate([rows[j][0] for j in some]).astype(np.int64)
                share = np.concatenate([rows[j][1] for j in some])
                opens = np.cumsum([0, *size[:-1]])
                hidden = np.add.reduceat(embeddings[bucket] * share[:, None], opens, axis=0)
                z = hidden @ weights
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), lang[some]] -= 1
                p /= len(some)
                back = p @ weights.T
                weights -= rate * (hidden.T @ p)
                np.subtract.at(embeddings, bucket, rate * scale * share[:, None] * np.repeat(back, size, axis=0))
    return Model(langs, (embeddings @ weights).astype(np.float64), embeddings=embeddings)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray, errors: float = ERRORS) -> Model:
    """Sets the temperature with the least log loss on texts left out of training, and the score below which a language is rejected.

    That is the lowest score above which at most a share ``errors`` of these texts is wrong, but one half at least.
    """
    some = [k for k in range(len(rows)) if len(rows[k][0])]
    if not some or len(model.langs) < 2:
        return model
    logits = np.stack([rows[k][1].astype(np.float64) @ model.table[rows[k][0].astype(np.int64)] for k in some])
    lang = lang[some]

    def loss(t: float) -> float:
        z = logits / t
        top = z.max(1)
        return float(np.mean(np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(z)), lang]))

    model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    p = model.probabilities(logits)
    best = p.max(1)
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(p.argmax(1)[order] != lang[order])
    # Equal scores are kept or rejected together.
    last = np.append(best[order][1:] != best[order][:-1], True)
    fine = np.flatnonzero((wrong <= errors * np.arange(1, len(order) + 1)) & last)
    model.least = max(0.5, float(best[order][fine[-1]]) if len(fine) else 1.0) if wrong[-1] else 0.5
    return model


def _shared_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, size=SCORE_BYTES):
            rows = shares(part.column("text"))
            columns = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("mark"), *columns], names=["lang", "mark", "bucket", "share"])


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits to at most ``sample`` labelled documents, the same number of each language, chosen by hash of doc_id.

    Learns only from text and lang of rows outside fold 0 whose lang is not null. Texts are taken whole; what
    comes to the driver is the shares of 2**BITS buckets at most for each sampled text.
    """
    own = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~held_out(FOLDS))
    counts = {r["lang"]: r["count"] for r in own.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)))
    each = max(sample // len(langs), 1)
    mark = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))
    # Only ids are ordered; the texts of a fixed number of them are read then.
    ids = own.select(F.col("lang").cast("string").alias("lang"), "doc_id", mark.alias("mark"))
    chosen = None
    for lang in langs:
        part = ids.where(F.col("lang") == lang).orderBy("mark", "doc_id").limit(each)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = F.broadcast(chosen.select("doc_id", "mark").distinct())
    texts = own.select(F.col("lang").cast("string").alias("lang"), "doc_id", "text").join(chosen, "doc_id").select("lang", "mark", "text")
    table = texts.mapInArrow(shared.released(_shared_out), "lang string, mark long, bucket binary, share binary").toArrow().to_pylist()
    # Rows arrive in any order.
    table.sort(key=lambda r: (r["mark"], r["lang"], r["bucket"], r["share"]))
    rows = [(np.frombuffer(r["bucket"], np.uint16), np.frombuffer(r["share"], np.float32)) for r in table]
    at = np.array([langs.index(r["lang"]) for r in table], int)
    aside = np.array([r["mark"] % CALIBRATE_EVERY == 0 for r in table], bool)
    picked = {k: [rows[j] for j in np.flatnonzero(aside == k)] for k in (False, True)}
    return calibrate(train(picked[False], at[~aside], langs), picked[True], at[aside])


def identify(documents: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns lang_pred, score and rejected for every row, from its whole text.

    score is the calibrated probability of lang_pred. Null texts, those without a letter, and all texts under a
    model without languages are ``und`` with score 0, and rejected. A text of unknown script has equal probabilities, and so
    is rejected. Columns in ``keep`` are passed on, but for those that have the name of an added one.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() not in _ADDED]
    letter, text = (words.unused(c, documents.columns) for c in ("_letter", "_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in words.chunks(batch, text, SCORE_BYTES):
                rest = part.drop_columns([letter, text])
                some = part.column(letter).to_numpy(zero_copy_only=False).astype(bool)
                if known.langs:
                    p = known.probabilities(known.logits(part.column(text)))
                else:
                    some, p = np.zeros(len(some), bool), np.zeros((len(some), 1))
                names = np.array([*known.langs, "und"], object)
                best, value = np.where(some, p.argmax(1), len(known.langs)), np.where(some, p.max(1), 0.0)
                added = [pa.array(names[best], pa.string()), pa.array(value), pa.array(~some | (value < known.least))]
                yield pa.RecordBatch.from_arrays([*rest.columns, *added], names=[*rest.schema.names, *_ADDED])

    whole = F.col("text").cast("string").alias(text)
    has_letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias(letter)
    schema = words.extended(documents.select(*keep, whole), "lang_pred string, score double, rejected boolean")
    return documents.select(*keep, has_letter, whole).mapInArrow(shared.released(run), schema)
