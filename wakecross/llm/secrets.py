"""Secrets in texts, also under layers of URL, Unicode, base64 and compressed encoding."""

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import shared, words

# The three kinds, in their order, and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
# A text without any of these has no assignment.
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

# Long runs: all that hex numbers and base64 can be within.
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 in lines of one length or another, such as mail and keys have it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}\r?\n)+[A-Za-z0-9+/_-]+={0,2}")
# Decoded bytes without any of these hold no secret and no further layer.
USEFUL = re.compile(rb"[A-Za-z0-9+/_-]{12}|%[0-9A-Fa-fu]|\\[uUx]|&#|AKIA|(?i:passw|secret|token|api_?key)")
# How gzip, bzip2, xz and zlib data begins.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
_OPENERS = {
    b"\x1f": lambda: zlib.decompressobj(31), b"B": bz2.BZ2Decompressor, b"\xfd": lzma.LZMADecompressor, b"\x78": zlib.decompressobj,
}
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
# Decoded characters of one document; compressed data can be made to grow without end.
LAYER_CHARS = 32 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret that stands in the text itself."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    for run in LONG.finditer(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return found


class Layer:
    """A decoded text and where its characters come from in the document.

    ``starts`` are positions in this text from which on it is a copy, or one encoded
    character, of the document's part in ``sources``. Without them all of it stands for one span.
    """

    def __init__(self, text: str, span: tuple[int, int], starts=None, sources=None):
        self.text, self.span, self.starts, self.sources = text, span, starts, sources

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return self.span
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        begin, width = self.sources[k]
        if width == 0:
            return begin + i - self.starts[k], begin + i - self.starts[k] + 1
        return begin, begin + width

    def rewritten(self, pattern: re.Pattern, decode) -> "Layer | None":
        """The text with every match decoded; ``decode`` gives (characters, source width of each)."""
        out, starts, sources, at, size = [], [], [], 0, 0
        for m in pattern.finditer(self.text):
            pieces = decode(m)
            if m.start() > at:
                self._copied(at, m.start(), size, starts, sources)
                out.append(self.text[at : m.start()])
                size += m.start() - at
            source = m.start()
            for char, width in pieces:
                begin, end = self.place(source, source + width)
                out.append(char)
                starts.append(size)
                sources.append((begin, end - begin))
                size += len(char)
                source += width
            at = m.end()
        if not out:
            return None
        if at < len(self.text):
            self._copied(at, len(self.text), size, starts, sources)
            out.append(self.text[at:])
        text = "".join(out)
        return Layer(text, self.span, starts if self.starts is not None else None, sources) if text != self.text else None

    def _copied(self, begin: int, end: int, size: int, starts: list, sources: list) -> None:
        """Copies the places of a part that is not decoded."""
        if self.starts is None:
            return
        k = bisect_right(self.starts, begin) - 1
        while k < len(self.starts) and self.starts[k] < end:
            first = max(begin, self.starts[k])
            source, width = self.sources[k]
            starts.append(size + first - begin)
            sources.append((source + (first - self.starts[k] if width == 0 else 0), width))
            k += 1


def _from_url(match: re.Match) -> list[tuple[str, int]]:
    raw = bytes.fromhex(match[0].replace("%", ""))
    text = raw.decode("utf-8", "replace")
    if "\ufffd" in text:
        return [(chr(b), 3) for b in raw]
    return [(c, 3 * len(c.encode())) for c in text]


def _from_escape(match: re.Match) -> list[tuple[str, int]]:
    number = int(match[7]) if match[7] else int(next(g for g in match.groups() if g), 16)
    valid = number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF
    return [(chr(number) if valid else "\ufffd", len(match[0]))]


def _unpacked(data: bytes, room: int) -> Iterator[tuple[bytes, bool]]:
    """What compressed data anywhere in the bytes holds, and whether some of it had to be left."""
    for start in MAGIC.finditer(data):
        make = _OPENERS[start[0][:1]]
        try:
            job = make()
            out = job.decompress(data[start.start() :], room)
            if out:
                yield out, not job.eof and len(out) >= room
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
            continue


def _texts_of(data: bytes, room: int) -> Iterator[tuple[str, bool]]:
    """The texts in decoded bytes, through layers of compression, and whether some had to be left.

    Bytes that are not UTF-8 are read one by one, so that a secret among them is seen; bytes with nothing to
    look for are left out.
    """
    todo, seen = [(data, False)], set()
    while todo:
        data, cut = todo.pop()
        digest = hashlib.sha256(data).digest()
        if digest in seen:
            continue
        seen.add(digest)
        todo.extend(_unpacked(data, room))
        if cut or USEFUL.search(data):
            try:
                yield data.decode("utf-8"), cut
            except UnicodeDecodeError:
                yield data.decode("latin-1"), cut


def _from_base64(layer: Layer, room: int) -> Iterator[tuple[Layer, bool]]:
    """Every run read from each of its first four characters, since what stands before base64 can look like it."""
    runs = [LONG.finditer(layer.text)]
    if "\n" in layer.text:
        runs.append(WRAPPED.finditer(layer.text))
    for run in chain.from_iterable(runs):
        body = run[0].rstrip("=").replace("-", "+").replace("_", "/")
        if "\n" in body:
            body = body.replace("\r", "").replace("\n", "")
        for skipped in range(4):
            part = body[skipped:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            for text, cut in _texts_of(data, room):
                yield Layer(text, layer.place(run.start(), run.end())), cut


def unwrapped(text: str, room: int = LAYER_CHARS) -> tuple[set[tuple[int, int, int]], set[tuple[int, int]]]:
    """Secrets in all decoded layers, by the span they come from; and spans of layers too large to look through whole.

    A worklist: every layer is decoded each way, and each new result is a layer in turn.
    A text that was met before for the same span ends a cycle.
    """
    if "%" not in text and "\\" not in text and "&#" not in text and not LONG.search(text):
        return set(), set()
    found, cut = set(), set()
    todo = [Layer(text, (0, len(text)), [0], [(0, 0)])]
    seen = {(text, (0, len(text)))}
    while todo:
        layer = todo.pop()
        following = []
        if "%" in layer.text:
            following.append(layer.rewritten(URL, _from_url))
        if "\\" in layer.text or "&#" in layer.text or "%u" in layer.text:
            following.append(layer.rewritten(ESCAPE, _from_escape))
        for inner, more in _from_base64(layer, max(room, 1)):
            if more:
                cut.add(inner.span)
            following.append(inner)
        for inner in following:
            if inner is None or (inner.text, inner.span) in seen:
                continue
            if len(inner.text) > room:
                cut.add(inner.span)
                continue
            room -= len(inner.text)
            seen.add((inner.text, inner.span))
            found.update((*inner.place(s, e)[:1], kind, inner.place(s, e)[1]) for s, kind, e in scan(inner.text))
            todo.append(inner)
    return found, cut


def _spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _rows(texts: list[str | None]) -> dict[str, pa.Array]:
    base, every, cuts = [], [], []
    for text in texts:
        own = scan(text or "")
        more, cut = unwrapped(text or "")
        base.append(own)
        every.append(sorted(more.union(own)))
        cuts.append(bool(cut))
    counts = {f"n_{name}": [sum(s[1] == k for s in own) for own in base] for k, name in enumerate(KINDS)}
    return {name: pa.array(column, pa.int64()) for name, column in counts.items()} | {
        "base_sha256": pa.array([hashlib.sha256(_spelled(own).encode()).hexdigest() for own in base], pa.string()),
        "spans": pa.array([_spelled(s) for s in every], pa.string()),
        "cut": pa.array(cuts, pa.bool_()),
    }


def _redacted(texts: list[str | None], mark: str) -> pa.Array:
    out = []
    for text in texts:
        found, cut = unwrapped(text or "")
        spans = sorted({(s, e) for s, _, e in found.union(scan(text or ""))} | cut)
        if not spans:
            out.append(text)
            continue
        parts, at = [], 0
        for start, end in spans:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


def secrets(documents: DataFrame, *keep: str) -> DataFrame:
    """For every row: n_assign, n_access, n_hex and base_sha256 of the secrets in the text itself, spans of all, cut.

    Spans are kind:start:end in characters, end exclusive, by start, then kind, joined by commas. A
    secret under layers has the span of what encodes it: exact where characters are encoded one by
    one (URL, Unicode), else the whole base64 run, wrapped lines together. A null or empty text has none. ``cut`` marks
    rows whose decoded layers grew beyond ``LAYER_CHARS`` and are not all searched; base spans always are.
    """
    added = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, cut boolean"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "_text"):
                columns = _rows(part.column("_text").to_pylist())
                rest = part.drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, *columns.values()], names=[*rest.schema.names, *columns])

    frame = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    return frame.mapInArrow(shared.released(find), words.extended(frame, added))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret's span replaced, overlapping spans together; n_chars, if there, follows.

    What decodes to more than can be looked through is replaced too.
    """

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                at = part.schema.get_field_index("text")
                yield part.set_column(at, "text", _redacted(part.column("text").to_pylist(), mark))

    changed = documents.mapInArrow(shared.released(change), documents.schema)
    if "n_chars" in documents.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return changed.select(*documents.columns)
