"""Byte-level BPE through a table of distinct words.

Texts are split into the pieces that merges never cross. Every distinct piece of the corpus is
encoded once, in Spark, into a table by hash in the shared folder; ids then join
back to the pieces' positions. Decoding joins ids with the vocabulary's byte strings.
"""

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wakecross.llm import packed, shared, words
from wakecross.sources.tables import shared_folder

# Fixed value: the split pattern of the vocabulary, with white space spelled as the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
FLUSH_PIECES = 200_000
# Pieces that a worker keeps at hand; more are looked up again.
KEPT_PIECES = 400_000
CHUNK_BYTES = 1 << 20
# Pieces that the tokenizer holds at once; what it returns for each is large.
ENCODED_PIECES = 2_000


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Tokenizer:
    """The vocabulary's own tokenizer; a process loads it once, for all its tasks."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Splits texts as the vocabulary file says; special tokens are pieces of their own. Tasks that only split load no tokenizer."""

    def __init__(self, path: str):
        self.path = path
        self.special = sorted((t.content for t in tokenizer_of(path).get_added_tokens_decoder().values()), key=len, reverse=True)

    def open(self) -> "Splitter":
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        return self

    def __getstate__(self):
        return {"path": self.path, "special": self.special}

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out.extend([part] if k % 2 else self.find(part))
        return out


def byte_pieces(tokenizer: Tokenizer) -> list[bytes]:
    """The byte string of every id. Vocabulary entries spell bytes as printable characters in a fixed order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = special[i] if i in special else bytes(spelled[c] for c in token)
    return out


def _hashes(pieces: list[bytes]) -> np.ndarray:
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    return words.hashed(np.frombuffer(b"".join(pieces), np.uint8), ends - lengths, ends)


def _distinct(splitter: Splitter, buckets: int):
    """Distinct pieces of many texts, dealt by hash."""

    def flush(held: set[str]) -> Iterator[pa.RecordBatch]:
        raw = [p.encode() for p in held]
        hashes = _hashes(raw)
        order = np.argsort(hashes)
        hashes = hashes[order]
        raw = [raw[k] for k in order.tolist()]
        cuts = packed.bounds(hashes, buckets)
        full = np.flatnonzero(np.diff(cuts))
        lengths = np.fromiter(map(len, raw), np.uint32, len(raw))
        columns = [
            pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()) for x in (hashes, lengths)
        ]
        texts = pa.array([b"".join(raw[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns, texts], names=["bucket", "c0", "c1", "c2"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter.open()
        held: set[str] = set()
        for batch in batches:
            for part in words.chunks(batch, size=CHUNK_BYTES):
                for text in part.column("text").to_pylist():
                    held.update(splitter.pieces(text or ""))
                    if len(held) >= FLUSH_PIECES:
                        yield from flush(held)
                        held = set()
        if held:
            yield from flush(held)

    return distinct


class WordTable:
    """Distinct pieces by hash: their ids as text, and the bytes they decode to."""

    def __init__(self, folder: str, buckets: int):
        columns = dict(ids_at=np.uint64, ids_length=np.uint32, out_at=np.uint64, out_length=np.uint32)
        self.keys = packed.HashTable(folder, buckets, **columns)
        self.folder, self._blobs = folder, {}

    def __getstate__(self):
        return self.__dict__ | {"_blobs": {}}

    def write(self, bucket: int, keys: np.ndarray, ids: list[bytes], out: list[bytes]) -> None:
        columns = {}
        for name, values in (("ids", ids), ("out", out)):
            lengths = np.fromiter(map(len, values), np.uint32, len(values))
            shared.write_bytes(f"{self.folder}/{bucket:07d}.{name}", b"".join(values))
            columns |= {f"{name}_at": np.cumsum(lengths, dtype=np.uint64) - lengths, f"{name}_length": lengths}
        self.keys.write(bucket, keys, **columns)

    def _blob(self, bucket: int, name: str) -> memoryview:
        if (bucket, name) not in self._blobs:
            blob = shared.mapped(f"{self.folder}/{bucket:07d}.{name}", np.uint8)
            self._blobs[bucket, name] = memoryview(blob)
        return self._blobs[bucket, name]

    def find(self, pieces: list[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """Ids and decoded bytes of pieces, all of which must be in the table."""
        hashes = _hashes([p.encode() for p in pieces])
        order = np.argsort(hashes)
        keys = hashes[order]
        present, found = self.keys.find(keys)
        if not present.all():
            raise KeyError("a piece is not in the table of distinct words")
        names = [pieces[k] for k in order.tolist()]
        cuts = packed.bounds(keys, self.keys.buckets)
        ids, out = {}, {}
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[bucket], cuts[bucket + 1])
            for target, name in ((ids, "ids"), (out, "out")):
                blob = self._blob(bucket, name)
                begin = found[f"{name}_at"][own].astype(np.int64)
                end = (begin + found[f"{name}_length"][own]).tolist()
                target.update(zip(names[own], [bytes(blob[a:b]) for a, b in zip(begin.tolist(), end, strict=True)], strict=True))
        return {p: x.decode() for p, x in ids.items()}, out


def _encode_bucket(table: WordTable, splitter: Splitter, vocabulary):
    """Encodes one bucket's distinct pieces, each once, and joins their ids with the vocabulary."""

    def encode(key, group):
        shared.release_memory()
        hashes, lengths, text = packed.gather(group, np.uint64, np.uint32, np.uint8)
        ends = np.cumsum(lengths.astype(np.int64))
        hashes, first = np.unique(hashes, return_index=True)
        begin, end = (ends - lengths)[first], ends[first]
        known, tokenizer = vocabulary.value, tokenizer_of(splitter.path)
        ids, out = [], []
        for k in range(0, len(first), ENCODED_PIECES):
            own = slice(k, k + ENCODED_PIECES)
            pieces = [text[a:b].tobytes().decode() for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)]
            for encoded in tokenizer.encode_batch(pieces, add_special_tokens=False):
                found = encoded.ids
                ids.append(",".join(map(str, found)).encode())
                out.append(b"".join([known[i] for i in found]))
        table.write(key[0].as_py(), hashes, ids, out)
        return pa.table({"words": pa.array([len(first)], pa.int64())})

    return encode


def word_table(texts: DataFrame, path: str) -> WordTable:
    """The table of all distinct pieces of the texts."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = packed.bucket_count(size // 40, packed.BUCKET_ROWS // 4)
    folder = shared_folder(spark)
    shared.make_folder(folder)
    splitter, table = Splitter(path), WordTable(folder, buckets)
    vocabulary = spark.sparkContext.broadcast(byte_pieces(tokenizer_of(path)))
    dealt = texts.select("text").mapInArrow(shared.released(_distinct(splitter, buckets)), packed.schema(3))
    dealt.groupBy("bucket").applyInArrow(_encode_bucket(table, splitter, vocabulary), "words long").agg(F.sum("words")).collect()
    return table


def _join_back(table: WordTable, splitter: Splitter, finish):
    """The pieces of each text joined with the table, in order; ``finish`` makes columns of ids and bytes by piece."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter.open()
        ids: dict[str, str] = {}
        out: dict[str, bytes] = {}
        for batch in batches:
            for part in words.chunks(batch, "_text", CHUNK_BYTES):
                split = [splitter.pieces(text or "") for text in part.column("_text").to_pylist()]
                every = set().union(*split)
                fresh = every.difference(ids)
                if len(ids) + len(fresh) > KEPT_PIECES and ids:
                    # What this chunk shows again stays at hand.
                    again = every.intersection(ids)
                    ids, out = {p: ids[p] for p in again}, {p: out[p] for p in again}
                if fresh:
                    more = table.find(list(fresh))
                    ids.update(more[0])
                    out.update(more[1])
                columns = finish(split, ids, out)
                rest = part.drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, *columns.values()], names=[*rest.schema.names, *columns])

    return join


def _lists(split: list[list[str]], ids: dict[str, str], _: dict[str, bytes]) -> dict[str, pa.Array]:
    rows = [[int(x) for p in pieces for x in ids[p].split(",")] for pieces in split]
    return {"ids": pa.array(rows, pa.list_(pa.int32()))}


def _digests(split: list[list[str]], ids: dict[str, str], out: dict[str, bytes]) -> dict[str, pa.Array]:
    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    joined = [",".join(map(ids.__getitem__, pieces)) for pieces in split]
    # As the library decodes, bytes that are no UTF-8 become replacement characters.
    decoded = [b"".join(map(out.__getitem__, pieces)).decode("utf-8", "replace").encode() for pieces in split]
    return {
        "n_tokens": pa.array([x.count(",") + 1 if x else 0 for x in joined], pa.int64()),
        "ids_sha256": pa.array([sha(x.encode()) for x in joined], pa.string()),
        "decoded_sha256": pa.array([sha(x) for x in decoded], pa.string()),
    }


def _with(documents: DataFrame, path: str, keep: tuple, finish, added: str) -> DataFrame:
    frame = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    table = word_table(frame.select(F.col("_text").alias("text")), path)
    return frame.mapInArrow(shared.released(_join_back(table, Splitter(path), finish)), words.extended(frame, added))


def encode(documents: DataFrame, path: str, *keep: str) -> DataFrame:
    """A column ids for every row: what the vocabulary's own library gives without added special tokens.

    ``path`` is a byte-level BPE file of the tokenizers library. A special token's name in a text is
    that token. Null and empty texts have no ids. Columns in ``keep`` are passed on.
    """
    return _with(documents, path, keep, _lists, "ids array<int>")


def digests(documents: DataFrame, path: str, *keep: str) -> DataFrame:
    """n_tokens, ids_sha256 (ids in decimal, joined by commas) and decoded_sha256 (of the decoded text) for every row."""
    return _with(documents, path, keep, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of every row with ids, by joining each id with its piece.

    The vocabulary is a table of fixed size and broadcast. Rows are told apart by the key and their
    ids; equal rows give one. Bytes that are no UTF-8 become replacement characters; without ids the text is empty, an
    id outside the vocabulary adds nothing.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame(list(enumerate(byte_pieces(tokenizer_of(path)))), "id int, piece binary")
    placed = encoded.select(F.col(key), "ids").distinct().select(key, "ids", F.posexplode_outer("ids").alias("at", "id"))
    joined = placed.join(F.broadcast(pieces), "id", "left").groupBy(key, "ids").agg(
        F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("found")
    )
    return joined.select(key, F.make_valid_utf8(F.unhex(F.array_join(F.col("found.piece"), "")).cast("string")).alias("text"))
