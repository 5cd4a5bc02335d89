"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, sf_dir, name):
    ours, theirs = compare(spark, connection, QUERIES[name], ORACLES[name], sf_dir)
    assert ours
    assert ours == theirs


def test_line_heatmap_is_in_order(spark, sf_dir):
    rows = [(-r["count"], r.ix) for r in QUERIES["line_heatmap"](spark, sf_dir).collect()]
    assert rows == sorted(rows)


def test_sample_repeats_itself(spark, sf_dir):
    first = QUERIES["bounded_sample"](spark, sf_dir).collect()
    assert len(first) == 250
    assert first == QUERIES["bounded_sample"](spark, sf_dir).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
