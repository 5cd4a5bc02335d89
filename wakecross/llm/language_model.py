"""An interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in mapped arrays."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import packed, shared, words
from wakecross.sources.tables import shared_folder

FOLDS = 10
FLUSH_TOKENS = 2_500_000
SCORE_BYTES = 6 << 20
# The end of a text is a token; what stands before its first word is only a context.
END = np.uint64(0x5E3D_8F2A_91C7_0000)
BEGIN = np.uint64(0xB19A_4C6E_D302_0000)
_LOW = np.uint64(16)


def held_out(folds: int = FOLDS):
    """Whether a row's doc_id, as text, falls into fold 0. A row without doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows, what stands before each, and each row's first token."""
    hashes, first = words.word_hashes(column, words.SPACED)
    start = first + np.arange(len(first))
    token = np.full(int(start[-1]), END)
    token[np.arange(len(hashes)) + words.rows_of(first)] = hashes
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[start[:-1]] = BEGIN
    return token, before, start


@dataclass
class Grid:
    """Pairs are dealt by the highest bits of both words, so one word's pairs lie in many buckets."""

    word_bits: int
    context_bits: int

    @classmethod
    def of(cls, pairs: int) -> "Grid":
        bits = min(40, max(4, int(pairs // packed.BUCKET_ROWS).bit_length()))
        return cls(bits - bits // 2, bits // 2)

    def bucket(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        high = word >> np.uint64(64 - self.word_bits)
        return (high << np.uint64(self.context_bits)) | (context >> np.uint64(64 - self.context_bits))


def _six(values: np.ndarray) -> list[np.ndarray]:
    """The upper 48 bits as two arrays."""
    return [(values >> np.uint64(32)).astype(np.uint32), (values >> _LOW).astype(np.uint16)]


def _from_six(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | (low.astype(np.uint64) << _LOW)


def _pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return words.mix((word >> _LOW) * np.uint64(0x9E3779B97F4A7C15) + words.mix(context >> _LOW))


def _batch(kind: int, bucket: np.ndarray, columns: list[list[bytes]]) -> pa.RecordBatch:
    names = ["kind", "bucket", *(f"c{k}" for k in range(5))]
    empty = pa.nulls(len(bucket), pa.binary())
    blobs = [pa.array(c, pa.binary()) for c in columns] + [empty] * (5 - len(columns))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(bucket), kind), pa.int32()), pa.array(bucket, pa.int64()), *blobs], names=names
    )


_DEALT = "kind int, bucket long, " + ", ".join(f"c{k} binary" for k in range(5))


def _dealt(kind: int, bucket: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Arrays in any order, one row per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
    columns = [[x[a:b].tobytes() for a, b in ranges] for x in (y[order] for y in arrays)]
    return _batch(kind, bucket[cuts[:-1]].astype(np.int64), columns)


def _count(grid: Grid, word_buckets: int):
    def flush(held) -> Iterator[pa.RecordBatch]:
        token = np.concatenate([t for t, _ in held])
        context = np.concatenate([c for _, c in held])
        keys, counts = np.unique(token, return_counts=True)
        yield _dealt(1, packed.bucket_of(keys, word_buckets), [keys, counts.astype(np.uint32)])
        order = np.argsort((token & np.uint64(0xFFFFFFFF00000000)) | (context >> np.uint64(32)))
        token, context = token[order], context[order]
        opens = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (context[1:] != context[:-1])]))
        counts = np.diff(np.concatenate([opens, [len(token)]]))
        token, context = token[opens], context[opens]
        # A count is one byte; a larger one is several entries.
        times = (counts - 1) // 255 + 1
        last = np.cumsum(times) - 1
        small = np.full(int(times.sum()), 255, np.uint8)
        small[last] = (counts - 255 * (times - 1)).astype(np.uint8)
        token, context = np.repeat(token, times), np.repeat(context, times)
        yield _dealt(0, grid.bucket(token, context), [*_six(token), *_six(context), small])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in words.chunks(batch):
                token, context, _ = _tokens(part.column("text"))
                held.append((token, context))
                size += len(token)
                if size >= FLUSH_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return count


def _grams(keys: np.ndarray, counts: np.ndarray, *wanted: int) -> list[np.ndarray]:
    """Distinct keys (they come sorted) with their number of entries, and how many entries have each wanted count."""
    opens = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    columns = [np.ones(len(keys), bool), *(counts == k for k in wanted), counts > max(wanted, default=0)]
    return [keys[opens], *(np.add.reduceat(c.astype(np.int64), opens).astype(np.uint32) if len(opens) else c for c in columns)]


def _store_pairs(table: packed.HashTable, word_buckets: int):
    """Kind 0: one bucket's distinct pairs to a file; per word its contexts, per context its words by count."""

    def store(key, group):
        kind, bucket = key[0].as_py(), key[1].as_py()
        if kind == 1:
            return group
        parts = packed.gather(group, np.uint32, np.uint16, np.uint32, np.uint16, np.uint8)
        word, context, counts = _from_six(*parts[:2]), _from_six(*parts[2:4]), parts[4].astype(np.int64)
        order = np.lexsort((context, word))
        word, context, counts = word[order], context[order], counts[order]
        opens = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
        counts = np.add.reduceat(counts, opens)
        word, context = word[opens], context[opens]
        keys = _pair_key(word, context)
        by_key = np.argsort(keys)
        table.write(bucket, keys[by_key], n=counts[by_key])
        types = _grams(word, counts)[:2]
        order = np.argsort(context, kind="stable")
        follows = _grams(context[order], counts[order], 1, 2)
        tail = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)
        out = [
            _dealt(2, packed.bucket_of(types[0], word_buckets), types),
            _dealt(3, packed.bucket_of(follows[0], word_buckets), [follows[0], *follows[2:]]),
            _batch(4, np.array([0]), [[tail.tobytes()]]),
        ]
        return pa.Table.from_batches(out)

    return store


_TOTALS = ["tokens", "vocabulary", "contexts", "p1", "p2", "p3", "p4", "t1", "t2", "t3", "t4", "more"]


def _store_words(table: packed.HashTable):
    """Every word of one bucket: its count, its contexts, and as a context how many words follow once, twice, more often."""

    def part(group, kind, *types):
        chosen = group.filter(pa.compute.equal(group.column("kind"), kind))
        return packed.gather(chosen, *types)

    def store(key, group):
        out = dict.fromkeys(_TOTALS, 0)
        tails = part(group, 4, np.int64)[0].reshape(-1, 4).sum(0)
        out |= dict(zip(("p1", "p2", "p3", "p4"), tails.tolist(), strict=True))
        keys, counts = packed.summed(*part(group, 1, np.uint64, np.uint32))
        whole, types = packed.summed(*part(group, 2, np.uint64, np.uint32))
        follow = part(group, 3, np.uint64, *[np.uint32] * 3)
        contexts, n1 = packed.summed(follow[0], follow[1])
        n2, n3 = (packed.summed(follow[0], x)[1] for x in follow[2:])
        extra = contexts[~np.isin(contexts >> _LOW, keys >> _LOW)]
        every = np.sort(np.concatenate([keys, extra]))
        values = {"c": np.zeros(len(every), np.int64)}
        values["c"][np.searchsorted(every, keys)] = counts
        for name, source, column in (("t", whole, types), ("n1", contexts, n1), ("n2", contexts, n2), ("n3", contexts, n3)):
            values[name] = np.zeros(len(every), np.int64)
            if len(source):
                at = np.minimum(np.searchsorted(source >> _LOW, every >> _LOW), len(source) - 1)
                values[name] = np.where((source[at] >> _LOW) == (every >> _LOW), column[at], 0)
        if len(every):
            table.write(key[0].as_py(), every, **values)
        known = values["t"][values["c"] > 0]
        out |= {"tokens": int(counts.sum()), "vocabulary": len(keys), "contexts": int(known.sum())}
        out |= {f"t{k}": int((known == k).sum()) for k in (1, 2, 3, 4)} | {"more": int((known >= 3).sum())}
        return pa.table({name: pa.array([int(out[name])], pa.int64()) for name in _TOTALS})

    return store


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from counts of counts; each within 0 and its count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = [0.0]
    for k, (n, more) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(k - (k + 1) * y * more / n, 0.0), k) if n else out[-1])
    return np.array(out)


@dataclass
class Model:
    pairs: packed.HashTable
    grid: Grid
    table: packed.HashTable
    totals: dict

    def __post_init__(self):
        t = self.totals
        self.pair_discounts = discounts(t["p1"], t["p2"], t["p3"], t["p4"])
        self.word_discounts = discounts(t["t1"], t["t2"], t["t3"], t["t4"])

    def logs(self, token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its count in training, log10 of its base and of its model probability."""
        t, n_words = self.totals, self.totals["vocabulary"]
        keys, at = np.unique(np.concatenate([token, [BEGIN, END]]), return_inverse=True)
        _, found = self.table.find(keys)
        value = {name: column.astype(np.float64) for name, column in found.items()}
        base = np.log10((value["c"] + 0.1) / (t["tokens"] + 0.1 * (n_words + 1)))
        d, s = self.word_discounts, value["t"]
        spare = (d[1] * t["t1"] + d[2] * t["t2"] + d[3] * t["more"]) / (n_words + 1)
        single = (np.maximum(s - d[np.minimum(s, 3).astype(int)], 0) + spare) / t["contexts"] if t["contexts"] else np.full(len(keys), 1.0 / (n_words + 1))
        # As a context a word occurs as often as it is a token; each text begins and ends once.
        uses = value["c"].copy()
        uses[at[-2]] = uses[at[-1]]
        e = self.pair_discounts
        mass = e[1] * value["n1"] + e[2] * value["n2"] + e[3] * value["n3"]
        word, before = at[: len(token)], np.searchsorted(keys, context)
        pair = word.astype(np.int64) * len(keys) + before
        distinct, inverse = np.unique(pair, return_inverse=True)
        word, before = distinct // len(keys), distinct % len(keys)
        n = self._count(keys[word], keys[before])
        seen = uses[before] > 0
        upper = np.maximum(n - e[np.minimum(n, 3).astype(int)], 0) + mass[before] * single[word]
        p = np.where(seen, upper / np.where(seen, uses[before], 1), single[word])
        return found["c"][at[: len(token)]], base[at[: len(token)]], np.log10(p)[inverse]

    def _count(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        keys, buckets = _pair_key(word, context), self.grid.bucket(word, context)
        order = np.lexsort((keys, buckets))
        out = np.zeros(len(keys))
        out[order] = self.pairs.find_in(buckets[order], keys[order])[1]["n"]
        return out


def train(texts: DataFrame) -> Model:
    """Counts all texts. Only totals come to the driver; tables go to the shared folder in sorted files."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grid, word_buckets = Grid.of(size // 8), packed.bucket_count(size // 64)
    folders = [shared_folder(spark) for _ in range(2)]
    for folder in folders:
        shared.make_folder(folder)
    pairs = packed.HashTable(folders[0], 0, n=np.uint32)
    table = packed.HashTable(folders[1], word_buckets, c=np.int64, t=np.uint32, n1=np.uint32, n2=np.uint32, n3=np.uint32)
    dealt = texts.select("text").mapInArrow(_count(grid, word_buckets), _DEALT)
    stats = dealt.groupBy("kind", "bucket").applyInArrow(_store_pairs(pairs, word_buckets), _DEALT)
    totals = stats.groupBy("bucket").applyInArrow(_store_words(table), ", ".join(f"{n} long" for n in _TOTALS))
    row = totals.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _TOTALS)).first()
    return Model(pairs, grid, table, row.asDict())


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "_text", SCORE_BYTES):
                token, context, start = _tokens(part.column("_text"))
                known, base, full = model.logs(token, context)
                sums = [np.add.reduceat(x, start[:-1]) for x in ((known > 0).astype(np.int64), base, full)]
                added = [
                    pa.array(np.diff(start), pa.int64()),
                    pa.array(sums[0], pa.int64()),
                    pa.array(sums[1], pa.float64()),
                    pa.array(sums[2], pa.float64()),
                ]
                rest = part.drop_columns(["_text"])
                names = [*rest.schema.names, "n_tokens", "n_known", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([*rest.columns, *added], names=names)

    return score


def score(documents: DataFrame, model: Model, *keep: str) -> DataFrame:
    """For every row: n_tokens, n_known, and log10 probabilities of the text, base_score and score.

    Tokens are what is between spaces and the controls 09 to 0D, after lower-casing A-Z, and one
    end; an empty or missing text is the end alone. base_score is of single tokens with 0.1
    added to every count; score is the model's. perplexity is 10 to the power of -score / n_tokens.
    Unknown words get the share of one unseen word. Columns in ``keep`` are passed on. Without
    training texts every token is unknown. Words are kept as 64-bit hashes, in pairs as 48 bits of them.
    """
    frame = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    return frame.mapInArrow(_score(model), words.extended(frame, "n_tokens long, n_known long, base_score double, score double"))
