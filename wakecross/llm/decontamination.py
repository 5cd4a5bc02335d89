"""Benchmark passages in training documents, found through an FM-index per shard."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import shared, words
from wakecross.llm.fm_index import FMIndex
from wakecross.sources.tables import shared_folder

WINDOW = 10
# Words of documents per index, and bytes of benchmark text searched at a time.
SHARD_WORDS = 1_500_000
BLOCK_BYTES = 8 << 20

_FOUND = "n_words long, hits array<struct<start: long, end: long>>, items array<long>"
_FOUND_TYPES = [
    ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.int64())),
]


def _benchmark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, first = words.word_hashes(batch.column("text"), words.ALNUM)
        blobs = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array(blobs, pa.binary())], names=["item_id", "words"]
        )


def store_benchmark(benchmark: DataFrame) -> str:
    """Word hashes of the benchmark as parquet files of bounded size in the shared folder; their folder."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // BLOCK_BYTES) + 1
    folder = shared_folder(benchmark.sparkSession)
    (
        benchmark.select(F.col("item_id").cast("long"), "text")
        .repartition(parts, F.xxhash64("item_id", "text"))
        .mapInArrow(_benchmark_words, "item_id long, words binary")
        .write.parquet(folder)
    )
    return folder


def _blocks(folder: str) -> list[list[str]]:
    """The files of the stored benchmark in groups of bounded size."""
    blocks, room = [], 0
    for path, size in shared.files(folder, ".parquet"):
        if room < size:
            blocks.append([])
            room = BLOCK_BYTES
        blocks[-1].append(path)
        room -= size
    return blocks


def _read(paths: list[str]) -> pa.Table:
    tables = []
    for path in paths:
        with shared.open_file(path) as source:
            tables.append(pq.read_table(source))
    return pa.concat_tables(tables)


class Windows:
    """The windows of one block of items as rows of symbols over the block's own vocabulary."""

    def __init__(self, table: pa.Table, window: int):
        self.items = np.array(table.column("item_id").to_pylist(), object)
        texts = [np.frombuffer(blob, np.uint64) for blob in table.column("words").to_pylist()]
        counts = np.array([len(text) for text in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(0, np.uint64)])
        self.vocabulary, symbols = np.unique(flat, return_inverse=True)
        symbols = np.concatenate([symbols + 1, np.zeros(window, np.int64)])
        per_item = np.where(counts > window, counts - window + 1, (counts > 0).astype(counts.dtype))
        first = np.cumsum(counts) - counts
        self.item = np.repeat(np.arange(len(texts)), per_item)
        at = np.arange(int(per_item.sum())) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        at += np.repeat(first, per_item)
        self.lengths = np.repeat(np.minimum(counts, window), per_item)
        rows = symbols[at[:, None] + np.arange(window)]
        self.patterns = np.where(np.arange(window) < self.lengths[:, None], rows, 0)


def _search(hashes: np.ndarray, first: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered words (true or false), and pairs of (row, item) that occur."""
    covered = np.zeros(len(hashes), bool)
    nothing = covered, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(windows.lengths) or not len(hashes):
        return nothing
    slot = np.minimum(np.searchsorted(windows.vocabulary, hashes), len(windows.vocabulary) - 1)
    symbol = np.where(windows.vocabulary[slot] == hashes, slot + 1, 0)
    # An occurrence lies in a run of known words of one row; runs shorter than any window hold none.
    known = symbol > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    starts_row = first[:-1][first[:-1] < len(hashes)]
    opens[starts_row] |= known[starts_row]
    run = np.cumsum(opens) - 1
    length = np.bincount(run[known])
    keep = known.copy()
    keep[known] = length[run[known]] >= windows.lengths.min()
    kept = np.flatnonzero(keep)
    if not len(kept):
        return nothing
    fresh = np.concatenate([[0], np.cumsum(run[kept][1:] != run[kept][:-1])])
    place = np.arange(len(kept)) + fresh
    text = np.zeros(place[-1] + 2, np.int64)
    text[place] = symbol[kept]
    word_at = np.full(len(text), -1, np.int64)
    word_at[place] = kept
    index = FMIndex(text, len(windows.vocabulary) + 1)
    low, high = index.search(windows.patterns, windows.lengths)
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
    begin = word_at[index.locate(rows)]
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, begin + windows.lengths[which], -1)
    covered = np.cumsum(marks[:-1]) > 0
    row = np.searchsorted(first, begin, side="right") - 1
    pairs = np.unique(np.stack([row, windows.item[which]], 1), axis=0)
    return covered, pairs[:, 0], pairs[:, 1]


def _merged(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered words: row, start and end within the row."""
    before = np.concatenate([[False], covered[:-1]])
    after = np.concatenate([covered[1:], [False]])
    inner = first[(first > 0) & (first < len(covered))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
    row = np.searchsorted(first, starts, side="right") - 1
    return row, starts - first[row], ends - first[row]


def _scan(folder: str, window: int, shard_words: int):
    def search_shard(held: list, blocks: list[list[str]]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([h for _, h, _ in held])
        first = [np.zeros(1, np.int64)]
        for _, _, f in held:
            first.append(f[1:] + first[-1][-1])
        first = np.concatenate(first)
        covered = np.zeros(len(hashes), bool)
        items = [set() for _ in range(len(first) - 1)]
        for block in blocks:
            windows = Windows(_read(block), window)
            hit, rows, found = _search(hashes, first, windows)
            covered |= hit
            for row, item in zip(rows.tolist(), windows.items[found].tolist(), strict=True):
                if item is not None:
                    items[row].add(item)
        row, start, end = _merged(covered, first)
        cuts = np.searchsorted(row, np.arange(len(first)))
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
        hits = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)
        listed = pa.array([sorted(x) for x in items], pa.list_(pa.int64()))
        counts = pa.array(np.diff(first), pa.int64())
        at = 0
        for batch, _, f in held:
            n = len(f) - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, counts[at : at + n], hits[at : at + n], listed[at : at + n]],
                names=[*batch.schema.names, *(name for name, _ in _FOUND_TYPES)],
            )
            at += n

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(folder)
        held, size = [], 0
        for batch in batches:
            for part in words.chunks(batch, "_text"):
                hashes, first = words.word_hashes(part.column("_text"), words.ALNUM)
                held.append((part.drop_columns(["_text"]), hashes, first))
                size += len(hashes) + part.num_rows
                if size >= shard_words:
                    yield from search_shard(held, blocks)
                    held, size = [], 0
        if held:
            yield from search_shard(held, blocks)

    return scan


def contaminated_spans(
    documents: DataFrame, benchmark: DataFrame, *keep: str, window: int = WINDOW, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """For every row of documents: its words, the spans of words to remove, and the items they are from.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
    A window is ``window`` consecutive words of an item, or all of an item with
    fewer; every occurrence of a window is found. Spans count words of the row,
    the end exclusive, and are merged and in order. Columns named in ``keep`` are
    passed on; any other columns are not read. A null or empty text has no words and no
    span; items without words never occur; an item without an id marks spans
    but is not listed; repeated rows are searched alike; without documents or
    items nothing is found. Only maps: documents are never shuffled, and every
    task holds one shard's words and one block of items at a time.
    """
    folder = store_benchmark(benchmark)
    frame = documents.select(*keep, F.col("text").alias("_text"))
    return frame.mapInArrow(shared.released(_scan(folder, window, shard_words)), words.extended(frame, _FOUND))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contaminated_spans`` with doc_id kept."""
    names = F.array_sort(F.transform("items", lambda item: item.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, hit: n + hit["end"] - hit["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark passage, with their own columns."""
    # As one value, the columns cannot clash with those that are added.
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text")
    found = contaminated_spans(rows, benchmark, "_row", window=window)
    return found.where(F.size("hits") == 0).select("_row.*")
