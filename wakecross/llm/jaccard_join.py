"""Exact self-join of documents on the Jaccard similarity of their word shingles.

Adaptive multi-match prefixes. Order a set's n shingles in any way that all sets
share. Two sets with similarity of at least s share at least o = ceil(s * n) shingles,
so they share at least m among the first n - o + m of each ("the m-prefix").

1. Documents. In hash order every document looks at its m-prefix with m a tenth of n. One
   with fewer than m shingles there that occur in any other document has no partner.
   That leaves near duplicates and documents made of common passages.
2. Families. Among those that are left (one document per distinct set), the order
   is by frequency, and 1-prefixes hold rare shingles only. Documents that share one
   are in one family; only members of one family can link.
3. Tiles. Within a family, blocks of bounded size meet. In a tile each document
   chooses m by estimated cost: every step adds a posting list to scan and
   requires one more match before a pair is verified. Pairs that are connected
   already are not verified again, and a tile returns a spanning forest of its links.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.llm import packed, shared, words
from wakecross.llm.components import components, forest
from wakecross.operators.joins import by_size
from wakecross.sources.tables import shared_folder, stored

SHINGLE = 5
PERCENT = 80
# Documents of one block; two blocks and their sets are in memory at a time.
BLOCK = 128
FLUSH_ROWS = 1_000_000
LONGEST_MATCH = 8


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any partner."""
    return -(-percent * n // 100)


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles in hash order, and each row's first."""
    hashes, first = words.word_hashes(column, words.SPACED)
    values, start = words.shingles(hashes, first, k)
    row = words.rows_of(start)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[fresh], row[fresh]
    return values, np.searchsorted(row, np.arange(len(start)))


def _prefix(first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: matches to require, and the length of that prefix."""
    n = np.diff(first)
    matches = np.maximum(1, n // 10)
    return matches, np.minimum(n, n - required(n, percent) + matches)


def _leading(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the first ``lengths`` values of each row."""
    at = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(at - first[:-1], lengths)


def _count_keys(pick, k: int, buckets: int):
    """Deals distinct keys with their counts per flush of many documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in words.chunks(batch):
                values, first = _sets(part.column("text"), k)
                held.append(pick(values, first))
                size += len(held[-1])
                if size >= FLUSH_ROWS:
                    keys, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield from packed.deal([keys, counts.astype(np.uint32)], buckets)
                    held, size = [], 0
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from packed.deal([keys, counts.astype(np.uint32)], buckets)

    return count


def _store_repeated(table: packed.HashTable):
    """Writes one bucket's keys that occur more than once."""

    def store(key, group):
        keys, counts = packed.summed(*packed.gather(group, np.uint64, np.uint32))
        keep = counts > 1
        table.write(key[0].as_py(), keys[keep], n=counts[keep])
        return pa.table({"rows": pa.array([int(keep.sum())], pa.int64())})

    return store


def repeated_keys(texts: DataFrame, pick, k: int, buckets: int) -> packed.HashTable:
    """Keys that ``pick`` takes from more than one document, with their number of documents."""
    folder = shared_folder(texts.sparkSession)
    shared.make_folder(folder)
    table = packed.HashTable(folder, buckets, n=np.uint32)
    dealt = texts.select("text").mapInArrow(shared.released(_count_keys(pick, k, buckets)), packed.schema(2))
    dealt.groupBy("bucket").applyInArrow(_store_repeated(table), "rows long").agg(F.sum("rows")).collect()
    return table


def _lookup(table: packed.HashTable, values: np.ndarray) -> np.ndarray:
    """Documents per value, 1 where it does not repeat."""
    keys, inverse = np.unique(values, return_inverse=True)
    present, found = table.find(keys)
    return np.where(present, found["n"].astype(np.int64), 1)[inverse]


def _describe(table: packed.HashTable, k: int, percent: int):
    """Set sizes and digests of all rows, and the text of those that may have a partner."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                values, first = _sets(part.column("text"), k)
                n = np.diff(first)
                matches, lengths = _prefix(first, percent)
                common = _lookup(table, values[_leading(first, lengths)]) > 1
                seen = np.concatenate([[0], np.cumsum(common)])
                ends = np.cumsum(lengths)
                may = (n > 0) & (seen[ends] - seen[ends - lengths] >= matches)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (values, words.mix(values))]
                key = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(words.mix(key[0].view(np.uint64)).view(np.int64), pa.int64()),
                        pa.array(words.mix(key[1].view(np.uint64)).view(np.int64), pa.int64()),
                        pa.array([x if m else None for x, m in zip(texts, may, strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n", "key_1", "key_2", "text"],
                )

    return describe


def _family_edges(table: packed.HashTable, k: int, percent: int, buckets: int):
    """Postings of 1-prefixes in order of frequency: stars within a flush, and each star's centre for its bucket."""

    def stars(keys, nodes):
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        opens = np.concatenate([[True], keys[1:] != keys[:-1]])
        centre = nodes[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        return keys[opens], nodes[opens], forest(nodes, centre)

    def rows(edges):
        return pa.RecordBatch.from_arrays(
            [pa.array(edges[:, 0], pa.int64()), pa.array(edges[:, 1], pa.int64())], names=["u", "v"]
        )

    def flush(held):
        keys, nodes, edges = stars(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        n = len(edges)
        for batch in packed.deal([keys, nodes], buckets):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())],
                names=["bucket", "c0", "c1", "u", "v"],
            )
        if n:
            batch = rows(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *batch.columns],
                names=["bucket", "c0", "c1", "u", "v"],
            )

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in words.chunks(batch):
                values, first = _sets(part.column("text"), k)
                times, row = _lookup(table, values), words.rows_of(first)
                order = np.lexsort((values, times, row))
                n = np.diff(first)
                lead = order[_leading(first, np.minimum(n, n - required(n, percent) + 1))]
                lead = lead[times[lead] > 1]
                held.append((values[lead], part.column("node").to_numpy()[row[lead]]))
                size += len(lead)
                if size >= FLUSH_ROWS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def join(_, group):
        _, _, edges = stars(*packed.gather(group, np.uint64, np.int64))
        return pa.Table.from_batches([rows(edges)])

    return post, join


class _Forest:
    def __init__(self, labels: np.ndarray):
        """Members with one label (not -1) are connected from the start."""
        self.parent = list(range(len(labels)))
        seen = {}
        for i, label in enumerate(labels.tolist()):
            if label != -1:
                self.join(seen.setdefault(label, i), i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _choose_matches(times: np.ndarray, base: int, n: int) -> int:
    """Matches to require of one document in a tile, by cost.

    ``times`` are the list lengths of its shared values, rare first; the values
    that are its own come before them and cost nothing. A longer prefix scans
    more postings; about their number through m is left to verify, at a cost of n each.
    """
    own = n - len(times)
    ends = np.minimum(len(times), np.maximum(0, base + np.arange(LONGEST_MATCH) - own))
    scanned = np.concatenate([[0], np.cumsum(times)])[ends]
    return 1 + int(np.argmin(scanned + n * scanned / np.arange(1, LONGEST_MATCH + 1)))


def tile_links(
    values: np.ndarray, first: np.ndarray, labels: np.ndarray, sides: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows' sets, beyond what the labels connect.

    Rows with side 0 and 1 of a tile of two blocks need not be compared within a side when both sides occur.
    """
    rows, n = words.rows_of(first), np.diff(first)
    _, token, df = np.unique(values, return_inverse=True, return_counts=True)
    shared_ = df[token] > 1
    token, rows = token[shared_], rows[shared_]
    order = np.lexsort((token, df[token], rows))
    token, rows = token[order], rows[order]
    start = np.searchsorted(rows, np.arange(len(n) + 1))
    base = n - required(n, percent) + 1
    need = np.ones(len(n), np.int64)
    prefixes = []
    for i in range(len(n)):
        own = token[start[i] : start[i + 1]]
        if len(own) < required(n[i : i + 1], percent)[0] or not len(own):
            continue
        need[i] = min(_choose_matches(df[own], int(base[i]), int(n[i])), len(own))
        length = max(0, int(base[i]) + int(need[i]) - 1 - (int(n[i]) - len(own)))
        prefixes.append((i, own[:length]))
    if len(prefixes) < 2:
        return []
    members = np.array([i for i, _ in prefixes])
    used, column = np.unique(np.concatenate([p for _, p in prefixes]), return_inverse=True)
    line = np.repeat(np.arange(len(members)), [len(p) for _, p in prefixes])
    counts = np.zeros((len(members), len(members)), np.float32)
    by_column = np.argsort(column, kind="stable")
    step = 4096
    for low in range(0, len(used), step):
        part = by_column[slice(*np.searchsorted(column[by_column], [low, low + step]))]
        bits = np.zeros((len(members), min(step, len(used) - low)), np.float32)
        bits[line[part], column[part] - low] = 1
        counts += bits @ bits.T
    size, least = n[members], need[members]
    fits = counts >= np.minimum(least[:, None], least[None, :])
    fits &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    side = sides[members]
    if len(set(side.tolist())) == 2:
        fits &= side[:, None] != side[None, :]
    one, two = np.nonzero(np.triu(fits, 1))
    best = np.argsort(-counts[one, two], kind="stable")
    forest, links = _Forest(labels), []
    for a, b in zip(members[one[best]].tolist(), members[two[best]].tolist(), strict=True):
        if forest.find(a) == forest.find(b):
            continue
        both = len(np.intersect1d(values[first[a] : first[a + 1]], values[first[b] : first[b + 1]], assume_unique=True))
        if 100 * both >= percent * (n[a] + n[b] - both):
            forest.join(a, b)
            links.append((a, b))
    return links


def _tiles(k: int, percent: int):
    """Links of every tile; rows come sorted by tile."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        values, first = _sets(table.column("text"), k)
        tile, node = table.column("tile").to_numpy(), table.column("node").to_numpy()
        label, side = table.column("label").to_numpy(), table.column("side").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
        edges = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                own = slice(first[a], first[b])
                found = tile_links(values[own], first[a : b + 1] - first[a], label[a:b], side[a:b], percent)
                edges.extend((node[a + i], node[a + j]) for i, j in found)
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["u", "v"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            if held and size > words.CHUNK_BYTES:
                # Whole tiles go; the last one may continue.
                last = held[-1].column("tile")[held[-1].num_rows - 1].as_py()
                more = int(np.searchsorted(tile != last, True)) if (tile != last).any() else len(tile)
                held.append(batch.slice(0, more))
                if more < len(tile):
                    yield links(held)
                    held, size = [], 0
                batch = batch.slice(more)
            for part in words.chunks(batch):
                if held and size > words.CHUNK_BYTES:
                    last = held[-1].column("tile")[held[-1].num_rows - 1].as_py()
                    own = part.column("tile").to_numpy() == last
                    more = len(own) if own.all() else int(np.argmin(own))
                    held.append(part.slice(0, more))
                    if more < len(own):
                        yield links(held)
                        held, size = [], 0
                    part = part.slice(more)
                if part.num_rows:
                    held.append(part)
                    size += part.column("text").nbytes
        if held:
            yield links(held)

    return run


def _tile_edges(tiles: DataFrame, k: int, percent: int) -> DataFrame:
    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(shared.released(_tiles(k, percent)), "u long, v long")


def _labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with the label of their component so far; a lone node is its own."""
    return nodes.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _edges(roots: DataFrame) -> DataFrame:
    """Components found so far as edges, from which the next search starts."""
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def _blocks(frame: DataFrame, group: str, key: list, block: int) -> DataFrame:
    """A column ``part``: members of a group spread over parts of about ``block`` rows by hash; one part if they fit two."""
    sizes = frame.groupBy(group, *key).agg(F.count(F.lit(1)).alias("size"))
    parts = F.when(F.col("size") <= 2 * block, 1).otherwise(F.ceil(F.col("size") / block))
    sizes = sizes.withColumn("parts", parts.cast("long"))
    return frame.join(sizes, [group, *key]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))


def links(texts: DataFrame, families: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links (u, v) that connect what is linked in each family; texts are (node, text), families (node, family)."""
    nodes = _blocks(families, "family", [], block)
    alone = F.lit(-1).cast("long")
    first = nodes.join(texts, "node").select(
        F.xxhash64("family", "part").alias("tile"), "node", "text", alone.alias("label"), F.lit(0).alias("side")
    )
    edges = stored(_tile_edges(first, k, percent))
    large = stored(nodes.where("parts > 1").select("node", "family"))
    if large.isEmpty():
        return edges
    # One member of every component of a part stands for it, to connect what the parts have in common.
    roots = components(edges)
    marked = _labelled(large, roots)
    leaders = marked.groupBy("family", "label").agg(F.min("node").alias("node")).drop("label")
    dealt = _blocks(leaders, "family", [], block).join(texts, "node").select(
        F.xxhash64("family", "part").alias("tile"), "node", "text", alone.alias("label"), F.lit(0).alias("side")
    )
    roots = components(_edges(roots).union(_tile_edges(dealt, k, percent)))
    # What is still apart is compared in full, block by block; blocks of one component only are not.
    marked = stored(_labelled(large, roots))
    sizes = marked.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    marked = marked.join(sizes, "label").withColumn("own", F.when(F.col("members") >= block, F.col("label")).otherwise(-1))
    marked = stored(_blocks(marked, "family", ["own"], block).select("node", "family", "label", "own", "part"))
    blocks = stored(marked.groupBy("family", "own", "part").agg(F.count(F.lit(1)).alias("size")))
    other = blocks.select("family", F.col("own").alias("own_2"), F.col("part").alias("part_2"))
    pairs = blocks.join(other, "family").where(
        "(own <> own_2 or own = -1) and struct(own, part) <= struct(own_2, part_2)"
    )
    tile = F.xxhash64("family", "own", "part", "own_2", "part_2")
    sides = pairs.select("family", tile.alias("tile"), "own", "part", F.lit(0).alias("side")).union(
        pairs.where("own <> own_2 or part <> part_2").select(
            "family", tile.alias("tile"), F.col("own_2").alias("own"), F.col("part_2").alias("part"), F.lit(1).alias("side")
        )
    )
    last = marked.join(sides, ["family", "own", "part"]).join(texts, "node")
    return stored(_edges(roots).union(_tile_edges(last.select("tile", "node", "text", "label", "side"), k, percent)))


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: documents linked, directly or not, by similar word shingles.

    Words are what is between spaces and the controls 09 to 0D, after lower-casing A-Z. A text's
    set is its distinct runs of ``shingle`` words, or the whole sequence if it has fewer; a text
    without words, or no text, has none and links with nothing. Two documents
    link if 100 * intersection >= percent * union. Shingles are compared by 64-bit hash. component_id is
    the smallest doc_id that links reach. Rows with one doc_id are one document with several
    texts; a row without doc_id has no component and links nothing. Other columns are not read.
    No link between different sets is lost; exact copies share one set and are looked at once.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = packed.bucket_count(size // 20)

    def leading(values, first):
        return values[_leading(first, _prefix(first, percent)[1])]

    table = repeated_keys(texts, leading, shingle, buckets)
    sets = stored(
        texts.mapInArrow(
            shared.released(_describe(table, shingle, percent)), "doc_id long, n long, key_1 long, key_2 long, text string"
        )
    )
    known = sets.where("doc_id is not null")
    classes = known.groupBy("key_1", "key_2", "n").agg(F.min("doc_id").alias("node"))
    classes = stored(classes.where("n > 0"))
    # One text per distinct set; its copies' texts may differ in white space, but not in shingles.
    kept = known.where("text is not null").join(classes, ["key_1", "key_2", "n"]).where("doc_id = node")
    kept = stored(kept.select("node", "text", "key_1", "key_2").dropDuplicates(["node", "key_1", "key_2"]).select("node", "text"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = packed.bucket_count(size // 6)
    table = repeated_keys(kept, lambda values, first: values, shingle, buckets)
    post, join = _family_edges(table, shingle, percent, buckets)
    posted = stored(kept.mapInArrow(shared.released(post), "bucket int, c0 binary, c1 binary, u long, v long"))
    starred = posted.where("bucket is not null").groupBy("bucket").applyInArrow(join, "u long, v long")
    touching = posted.where("bucket is null").select("u", "v").union(starred)
    roots = components(touching)
    families = stored(roots.select("node", F.col("root").alias("family")).union(roots.select("root", "root").distinct()))
    found = links(kept, families, shingle, percent, block)
    # Rows of one doc_id with different sets meet in that doc_id.
    same = known.join(classes, ["key_1", "key_2", "n"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    final = components(found.union(same.where("u <> v")))
    return sets.join(by_size(final.withColumnRenamed("node", "doc_id")), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")
    )
