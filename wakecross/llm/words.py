"""Words of texts as arrays, straight from Arrow's string buffers.

All work is on UTF-8 bytes. Separators are ASCII in every word definition used
here, so no character is ever cut. A null text is an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Bytes of text that are turned into arrays at once; one longer text stands alone.
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the given ranges, both ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Anything but a space and the controls 09 to 0D.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
# Digits, lower-case letters and all bytes of non-ASCII characters, after lower-casing.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficients(n: int) -> np.ndarray:
    """The first n numbers of a fixed pseudo-random sequence, all odd."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps) | np.uint64(1)


_COEFFICIENTS = _coefficients(1024)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and the rows' offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows, each of at most ``size`` bytes of text or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the index of its first word (one entry more at the end)."""
    mask = table[data]
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    bytes_ = data[within + np.repeat(starts, lengths)]
    longest = int(lengths.max())
    factors = _COEFFICIENTS if longest <= len(_COEFFICIENTS) else _coefficients(longest)
    sums = np.add.reduceat((bytes_.astype(np.uint64) + np.uint64(1)) * factors[within], at)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each row's first word."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, table)
    return hashed(data, starts, ends), first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, in order, and each row's first run.

    A row of fewer words, but not none, has its whole sequence as one run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    start = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(first[:-1] - start[:-1], runs) + np.arange(int(start[-1]))
    width = np.repeat(np.minimum(counts, k), runs)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += np.where(width > j, padded[at + j], np.uint64(0)) * _COEFFICIENTS[j]
    return mix(total + width.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), start


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores more as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(frame: DataFrame, added: str) -> StructType:
    """The frame's schema with its last column, the text, replaced by the added ones."""
    return StructType([*frame.schema.fields[:-1], *StructType.fromDDL(added).fields])
