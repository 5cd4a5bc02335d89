"""Arrays that tasks deal to hash buckets, and tables of sorted hashes in the shared folder.

Rows of numbers travel as one binary value per task and bucket: the work per
number stays in numpy, while Spark partitions, shuffles and repeats it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wakecross.llm import shared

BUCKET_ROWS = 1_000_000


def bucket_count(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Buckets of bounded size for so many numbers."""
    return max(8, int(rows // per_bucket) + 1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as equal ranges of the 64-bit hash."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bounds(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys, and the end."""
    return np.searchsorted(bucket_of(sorted_keys, buckets), np.arange(buckets + 1, dtype=np.uint64))


def deal(columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has numbers; the first column holds the sorted keys."""
    cuts = bounds(columns[0], buckets)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        blobs = [pa.array([c[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()) for c in columns]
        names = ["bucket", *(f"c{k}" for k in range(len(columns)))]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *blobs], names=names)


def schema(columns: int) -> str:
    return ", ".join(["bucket int", *(f"c{k} binary" for k in range(columns))])


def gather(table: pa.Table, *types) -> list[np.ndarray]:
    """The numbers of one bucket, column by column."""
    out = []
    for k, kind in enumerate(types):
        blobs = table.column(f"c{k}").to_pylist()
        out.append(np.frombuffer(b"".join(blobs), kind))
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class HashTable:
    """Sorted 64-bit keys with columns of values, one file per bucket and column, memory-mapped."""

    def __init__(self, folder: str, buckets: int, **types):
        self.folder, self.buckets, self.types = folder, buckets, types
        self._open: dict[int, tuple] = {}

    def write(self, bucket: int, keys: np.ndarray, **values: np.ndarray) -> None:
        shared.write_bytes(f"{self.folder}/{bucket:07d}.key", np.ascontiguousarray(keys))
        for name, kind in self.types.items():
            shared.write_bytes(f"{self.folder}/{bucket:07d}.{name}", np.ascontiguousarray(values[name].astype(kind)))

    def _bucket(self, bucket: int) -> tuple:
        if bucket not in self._open:
            paths = {name: f"{self.folder}/{bucket:07d}.{name}" for name in ("key", *self.types)}
            if not shared.exists(paths["key"]):
                self._open[bucket] = (np.zeros(0, np.uint64), {n: np.zeros(0, t) for n, t in self.types.items()})
            else:
                values = {n: shared.mapped(paths[n], t) for n, t in self.types.items()}
                self._open[bucket] = (shared.mapped(paths["key"], np.uint64), values)
        return self._open[bucket]

    def columns(self, bucket: int) -> dict[str, np.ndarray]:
        return self._bucket(bucket)[1]

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For sorted keys: which are present, and their values (0 where absent)."""
        return self.find_in(bucket_of(keys, self.buckets), keys)

    def find_in(self, buckets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The same for keys sorted by their buckets, and in them."""
        present = np.zeros(len(keys), bool)
        out = {name: np.zeros(len(keys), kind) for name, kind in self.types.items()}
        cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            table, values = self._bucket(int(buckets[a]))
            if not len(table):
                continue
            at = np.minimum(np.searchsorted(table, keys[a:b]), len(table) - 1)
            hit = table[at] == keys[a:b]
            present[a:b] = hit
            for name in self.types:
                out[name][a:b][hit] = values[name][at[hit]]
        return present, out
