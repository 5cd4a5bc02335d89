"""Exact ranked search over sparse vectors: ball trees whose bounds prune subtrees best-first, integer scores at the leaves."""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakecross.llm import words
from wakecross.sources.tables import stored

K = 20
LEAF_ROWS = 64
# Rows and numbers that one tree holds.
TREE_ROWS = 8_192
TREE_NUMBERS = 1 << 20
# Bytes of item text that are searched for at once; their terms go to all tasks.
BLOCK_BYTES = 1 << 20
# Doubles of sums over up to 2**20 terms are off by less than this share.
SAFE = 2.0**-30


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows, A-Z lower-cased, and each row's first one."""
    data, offsets = words.buffers(column)
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, offsets, words.ALNUM)
    lengths = ends - starts
    within = words.ALNUM[data]
    text = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(data[within])
    )
    return text, first


def _looked_up(known):
    """Per document: how many terms it has, and those that items have with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                text, first = terms_of(part.column("text"))
                term = pc.fill_null(pc.index_in(text, value_set=known.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = words.rows_of(first)
                at = np.flatnonzero(term >= 0)
                keys, counts = np.unique(row[at] * len(known.value) + term[at], return_counts=True)
                row_of, term_of = keys // max(len(known.value), 1), keys % max(len(known.value), 1)
                cuts = np.searchsorted(row_of, np.arange(part.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (term_of.astype(np.int32), counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"]
                )

    return run


class BallTree:
    """Balls around sparse vectors, split in halves along the line between two far rows.

    ``at``, ``term`` and ``value`` are the rows in compressed form. Bounds are taken in the space where every value
    is multiplied by the root of its term's weight, and a query by the same root, which leaves inner products as they are.
    """

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.leaf_rows, self.terms = max(leaf_rows, 1), len(weight)
        self.root = np.sqrt(weight.astype(np.float64))
        rows = len(at) - 1
        scaled = value * self.root[term]
        order, ranges, children = np.arange(rows), [(0, rows)], [(-1, -1)]
        # Nodes are split in the order they are made; the rows of each are a range of ``order``.
        node = 0
        while node < len(ranges):
            a, b = ranges[node]
            if b - a > self.leaf_rows:
                order[a:b] = self._halves(order[a:b], at, term, scaled)
                middle = (a + b) // 2
                children[node] = (len(ranges), len(ranges) + 1)
                ranges += [(a, middle), (middle, b)]
                children += [(-1, -1)] * 2
            node += 1
        self.order, self.ranges, self.children = order, ranges, children
        size = np.diff(at)[order]
        index = self._index(order, at)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.term, self.value = term[index], value[index]
        self._enclose(scaled[index])

    @staticmethod
    def _index(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = (at[1:] - at[:-1])[rows]
        begin = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(at[:-1][rows] - begin, size)

    def _halves(self, rows: np.ndarray, at: np.ndarray, term: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        """The rows in the order of their place between a row far from the centre and the row farthest from that one."""
        index = self._index(rows, at)
        size = np.diff(at)[rows]
        row = np.repeat(np.arange(len(rows)), size)
        own_term, own = term[index], scaled[index]
        square = np.bincount(row, own * own, len(rows))

        def products(vector):
            return np.bincount(row, own * vector[own_term], len(rows))

        def vector(k):
            dense = np.zeros(self.terms)
            dense[own_term[row == k]] = own[row == k]
            return dense

        centre = np.bincount(own_term, own, self.terms) / len(rows)
        far = vector(int(np.argmax(square - 2 * products(centre))))
        to_far = products(far)
        other = vector(int(np.argmax(square - 2 * to_far)))
        return rows[np.argsort(products(other) - to_far, kind="stable")]

    def _enclose(self, scaled: np.ndarray) -> None:
        """Centre and radius of every node, the centres as lists of nodes per term. A ball reaches only along its rows' terms."""
        self.radius = np.zeros(len(self.ranges))
        terms, nodes, values = [], [], []
        for node, (a, b) in enumerate(self.ranges):
            if a == b:
                continue
            own = slice(self.at[a], self.at[b])
            have, term = np.unique(self.term[own], return_inverse=True)
            value = scaled[own]
            row = np.repeat(np.arange(b - a), np.diff(self.at[a : b + 1]))
            centre = np.bincount(term, value) / (b - a)
            length = float(centre @ centre)
            gap = value - centre[term]
            square = length + np.bincount(row, gap * gap - centre[term] ** 2, b - a)
            # What rounding can hide of a difference of squares is added.
            slack = SAFE * (length + np.bincount(row, value * value, b - a))
            self.radius[node] = np.sqrt((np.maximum(square, 0) + slack).max())
            terms.append(have)
            nodes.append(np.full(len(have), node))
            values.append(centre)
        terms, nodes, values = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((terms, int), (nodes, int), (values, float)))
        order = np.argsort(terms, kind="stable")
        self.nodes, self.centres = nodes[order], values[order]
        self.lists = np.searchsorted(terms[order], np.arange(self.terms + 1))

    def bounds(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For a query of distinct terms of positive weight, no less than the highest score in each node."""
        q = weight / self.root[term]
        size = self.lists[term + 1] - self.lists[term]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.lists[term] - begin, size)
        node, q = self.nodes[at], np.repeat(q, size)
        inner = np.bincount(node, self.centres[at] * q, len(self.ranges))
        reach = np.sqrt(np.bincount(node, q * q, len(self.ranges))) * self.radius
        return (inner + reach) * (1 + 4 * SAFE) + 1

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, ids: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
        """The k best rows of positive score as (-score, id, row), and how many rows were scored.

        Nodes are taken by falling bound until none can hold a row that would enter; equal scores go to the smaller id.
        """
        dense = np.zeros(self.terms, np.int64)
        dense[term] = weight
        bound = self.bounds(term, weight.astype(np.float64))
        heap, best, scored = [(-bound[0], 0)], [], 0
        while heap:
            high, node = heapq.heappop(heap)
            if len(best) == k and -high < -best[-1][0]:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            a, b = self.ranges[node]
            if a == b:
                continue
            own = slice(self.at[a], self.at[b])
            # Every row has a term, so no range is empty.
            score = np.add.reduceat(self.value[own] * dense[self.term[own]], self.at[a:b] - self.at[a])
            scored += b - a
            some = np.flatnonzero(score >= (-best[-1][0] if len(best) == k else 1))
            rows = self.order[a:b][some]
            best = sorted([*best, *zip((-score[some]).tolist(), ids[rows].tolist(), rows.tolist(), strict=True)])[:k]
        return best, scored


def _searched(queries, weights, k: int, leaf_rows: int):
    """One tree's best rows for every item."""

    def run(_, group):
        group = group.combine_chunks()
        ids = group.column("doc_id").combine_chunks()
        # Rows without an id come after all others of their score.
        filled = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        terms, values = group.column("terms").combine_chunks(), group.column("impacts").combine_chunks()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        # Only the terms that the tree's rows have count.
        own, term = np.unique(terms.flatten().to_numpy(), return_inverse=True)
        tree = BallTree(at, term, values.flatten().to_numpy(), weights.value[own], leaf_rows)
        out = [[], [], [], []]
        for number, (query, repeats) in enumerate(queries.value):
            place = np.minimum(np.searchsorted(own, query), len(own) - 1)
            hit = (own[place] == query) & (weights.value[query] > 0)
            if not hit.any():
                continue
            best, scored = tree.search(place[hit], (repeats * weights.value[query])[hit], k, filled)
            out[0] += [number] * len(best)
            out[1] += [ids[row].as_py() for _, _, row in best]
            out[2] += [-score for score, _, _ in best]
            out[3] += [scored] * len(best)
        columns = [pa.array(x, pa.int64()) for x in out]
        return pa.table(columns, names=["number", "doc_id", "score", "scored"])

    return run


def _items(items: DataFrame) -> DataFrame:
    """(item_id, text): one row per item_id; equal rows count once, different texts of one id are taken together."""
    return (
        items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
        .groupBy("item_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
    )


def _block(documents: DataFrame, block: list, k: int, leaf_rows: int) -> DataFrame:
    """The best documents of one block of items."""
    spark = documents.sparkSession
    text, first = terms_of(pa.array([r["text"] for r in block], pa.string()))
    known = pc.unique(text)
    term = pc.index_in(text, value_set=known).to_numpy(zero_copy_only=False)
    queries = [np.unique(term[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
    sent = spark.sparkContext.broadcast(known)
    rows = stored(documents.mapInArrow(_looked_up(sent), "doc_id long, n long, terms array<int>, tfs array<long>"))
    total = rows.agg(
        F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"),
        F.count_if(F.size("terms") > 0).alias("rows"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("numbers"),
    ).first()
    frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    weighed = frequency.select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * total["docs"] + 2) / (2.0 * F.col("count") + 1))).cast("long").alias("w")
    ).collect()
    weights = np.zeros(len(known), np.int64)
    for r in weighed:
        weights[r["term"]] = r["w"]
    length = F.expr(f"100 - 25 + (25 * n * cast({total['docs']} as bigint)) div cast({max(total['terms'], 1)} as bigint)")
    impacts = F.expr("transform(tfs, tf -> (1000000000 * tf) div (1000 * tf + 12 * m))")
    vectors = rows.where(F.size("terms") > 0).withColumn("m", length).select("doc_id", "terms", impacts.alias("impacts"))
    trees = max(1, -(-total["rows"] // TREE_ROWS), -(-total["numbers"] // TREE_NUMBERS))
    # The rows of a written table are numbered the same each time.
    dealt = vectors.groupBy(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(trees)).alias("tree"))
    shared = [spark.sparkContext.broadcast(x) for x in (queries, weights)]
    found = dealt.applyInArrow(_searched(*shared, k, leaf_rows), "number long, doc_id long, score long, scored long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(block)], f"number long, item_id {block[0]['kind']}")
    return best.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = K, leaf_rows: int = LEAF_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest positive score for every item.

    Terms are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased. With N documents that have
    terms, L terms in them, df documents with a term, and tf and n a document's occurrences and terms: a term weighs
    floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, and a document scores the sum over the item's terms,
    repeats included, of w * (10**9 tf div (1000 tf + 12 m)). Equal scores go to the smaller doc_id.

    A score is an inner product of an item's weights and a document's vector. Vectors hold only the terms of the
    block of items that is searched for: no other term can add to any product. They are dealt to trees of bounded size
    by hash; each tree is searched for every item, and the best of all trees are merged. Items are taken in blocks
    of at most ``block_bytes`` of text (one longer item stands alone), each a pass over the documents.

    Null and empty texts have no terms. Repeated document rows are ranked each; one without doc_id comes last
    among equals. Equal item rows count once, different texts of one item_id are taken together; no rows, no result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = stored(_items(items).withColumn("size", F.octet_length("text").cast("long")))
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = int(-(-total // block_bytes)) or 1
    kind = dict(items.dtypes)["item_id"]
    out = None
    for number in range(blocks):
        rows = table.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        block = [r.asDict() | {"kind": kind} for r in rows]
        if block:
            part = _block(docs, block, k, leaf_rows)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
