"""Ranked search against scoring every document; bounds that hold for every node."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import brute
from wakecross.llm import ball_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(brute.LOWER))) for i, t in docs]
    full = [(i, ts) for i, ts in terms if ts]
    n_docs, total = len(full), sum(len(ts) for _, ts in full)
    df = Counter(t for _, ts in full for t in set(ts))
    wanted = {}
    for i, t in set(items):
        wanted.setdefault(i, []).extend(TERM.findall((t or "").translate(brute.LOWER)))
    out = []
    for item, query in wanted.items():
        scores = []
        for i, ts in full:
            tf, m = Counter(ts), 75 + 25 * len(ts) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in query if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def ours(spark, docs, items, **options):
    left = spark.createDataFrame([(*d, "x", [1], 2) for d in docs], "doc_id long, text string, terms string, tfs array<int>, item_id long")
    right = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in ball_tree.ranked(left, right, **options).collect()), key=key)


@pytest.fixture(scope="module")
def tables():
    random.seed(6)
    vocabulary = [f"t{int(random.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(k, " ".join(random.choice(vocabulary) for _ in range(random.randrange(80)))) for k in range(600)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)] + [(700, "T1 é É t1"), (701, None), (702, "..."), (None, docs[7][1]), (5, docs[5][1])]
    docs.append((703, "t2 " * 30_000))
    items = [(k, " ".join(random.choice(vocabulary) for _ in range(random.randrange(1, 25)))) for k in range(30)]
    return docs, items + [(5, items[5][1]), (5, "t1 more t1"), (90, None), (91, ""), (92, "nowhere"), (None, "t3 t4"), (93, docs[5][1])]


@pytest.mark.parametrize("options", [{"k": 20}, {"k": 3, "leaf_rows": 1}, {"k": 7, "leaf_rows": 10**6}, {"k": 5, "block_bytes": 100}])
def test_equal_to_scoring_all(spark, tables, options):
    assert ours(spark, *tables, **options) == sorted(plain(*tables, options["k"]), key=key)


def test_many_trees(spark, tables, monkeypatch):
    monkeypatch.setattr(ball_tree, "TREE_ROWS", 50)
    assert ours(spark, *tables) == sorted(plain(*tables, 20), key=key)


def test_no_rows(spark, tables):
    docs, items = tables
    assert ours(spark, [], items) == ours(spark, docs, []) == ours(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    weight = rng.integers(0, 20_000, 300)
    groups = np.arange(300).reshape(20, 15)
    rows = [np.unique(rng.choice(groups[k % 20], 12 if k % 3 else 2)) for k in range(2_000)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term = np.concatenate(rows)
    value = rng.integers(1, 900_000, len(term))
    tree = ball_tree.BallTree(at, term, value, weight, 32)
    ids, shares = rng.permutation(2_000), []
    for k in range(20):
        query = groups[k][weight[groups[k]] > 0][:15]
        dense = np.zeros(300, np.int64)
        dense[query] = weight[query]
        exact = np.add.reduceat(value * dense[term], at[:-1])
        bound = tree.bounds(query, dense[query].astype(float))
        for node, (a, b) in enumerate(tree.ranges):
            assert bound[node] >= exact[tree.order[a:b]].max()
        best, scored = tree.search(query, dense[query], 10, ids)
        want = sorted((-int(exact[j]), int(ids[j])) for j in range(2_000) if exact[j] > 0)[:10]
        assert [(s, i) for s, i, _ in best] == want
        shares.append(scored / 2_000)
    assert np.mean(shares) < 0.7


def test_equal_rows_and_one_row():
    for n in (1, 100):
        tree = ball_tree.BallTree(np.arange(n + 1), np.zeros(n, int), np.full(n, 5), np.array([3]), 8)
        best, _ = tree.search(np.array([0]), np.array([6]), 4, np.arange(n)[::-1])
        assert [(s, i) for s, i, _ in best] == [(-30, i) for i in range(min(n, 4))]
