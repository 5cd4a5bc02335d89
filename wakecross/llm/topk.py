"""Exact search of the highest inner products, term at a time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
K = 20
EVERY = 20
QUERY_BLOCK = 1_024
VECTOR_BLOCK = 8_192


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, terms): floor(64 * x) of every component; rows without id, vector or with a component that is no finite number go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    terms = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))


def _packed(key, group):
    """A block's vectors as ids, row lengths and terms."""
    ids = group.column("vec_id").combine_chunks().to_numpy()
    terms = group.column("terms").combine_chunks()
    lengths = np.diff(terms.offsets.to_numpy())
    values = terms.flatten().to_numpy(zero_copy_only=False)
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids, lengths.astype(np.int64), values.astype(np.int64))]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *blobs], names=["block", "ids", "lengths", "values"])


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids, lengths, values = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "values"))
    dense = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    at = np.cumsum(lengths) - lengths
    dense[np.repeat(np.arange(len(ids)), lengths), np.arange(len(values)) - np.repeat(at, lengths)] = values
    return ids, dense


class Postings:
    """Per term the rows that have it and their weights; a term of most rows is kept for all of them."""

    def __init__(self, dense: np.ndarray):
        self.rows = len(dense)
        self.lists = []
        for column in np.ascontiguousarray(dense.T):
            at = np.flatnonzero(column)
            self.lists.append((None, column) if 2 * len(at) > self.rows else (at, column[at]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """All rows' inner products with a query, added up term by term."""
        total = np.zeros(self.rows, np.int64)
        for term in np.flatnonzero(query[: len(self.lists)]):
            at, weights = self.lists[term]
            if at is None:
                total += weights * query[term]
            elif len(at):
                total[at] += weights * query[term]
        return total


def _best(k: int):
    def best(_, left, right):
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, dense = _matrix(right.to_pylist()[0])
            postings = Postings(dense)
            for query_id, query in zip(*_matrix(left.to_pylist()[0]), strict=True):
                total = postings.scores(query)
                others = ids != query_id
                some, total = ids[others], total[others]
                if len(total) > k:
                    high = np.flatnonzero(total >= np.partition(total, len(total) - k)[len(total) - k])
                    some, total = some[high], total[high]
                order = np.lexsort((some, -total))[:k]
                out[0].append(np.full(len(order), query_id))
                out[1].append(some[order])
                out[2].append(total[order])
        columns = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in out]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return best


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query, ties to the smaller vec_id.

    Queries are the vec_ids that ``every`` divides, with the smallest of their vectors where they have several; every row
    of another vec_id is a candidate, repeated ones too. A score
    is the inner product of whole_numbers, a missing component being 0. Blocks of queries meet blocks of
    vectors, each pair of blocks once; a block's dense scores are added up from postings, and its k best selected and merged.
    No vectors give no rows. Sums are exact in 64 bits for components below 2**27.
    """
    terms = whole_numbers(vectors)
    asked = terms.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    n, n_queries = terms.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    blocks, query_blocks = -(-n // vector_block) or 1, -(-n_queries // query_block) or 1
    packed = "block long, ids binary, lengths binary, values binary"

    def dealt(rows, parts):
        # Rows that one vec_id repeats differ in nothing but their vectors.
        return rows.groupBy(F.pmod(F.xxhash64("vec_id", "terms"), F.lit(parts)).alias("block")).applyInArrow(_packed, packed)

    right = dealt(terms, blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    left = dealt(asked, query_blocks)
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.col("other").cast("long").alias("v"), F.col("block").alias("q"), "ids", "lengths", "values"
    )
    right = right.select(F.col("block").alias("v"), F.col("other").cast("long").alias("q"), "ids", "lengths", "values")
    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
