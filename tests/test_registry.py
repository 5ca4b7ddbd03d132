"""Every registered query at the smallest scale, beside its SQL where it has one."""

import duckdb
import pytest
from compare import TABLES, compare

import __spark_entry__ as entry
from __spark_entry__ import _text_queries

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Queries without SQL are tested one by one in test_models.py, those on text in tests/llm.
CHECKED = sorted(set(ORACLES) - set(_text_queries()[0]))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, sf, name):
    text, _, ok = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(ORACLES) <= set(QUERIES)


def test_a_missing_library_takes_only_the_queries_that_need_it(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "foldline.llm.queries", None)
    monkeypatch.delattr("foldline.llm.queries", raising=False)
    left = entry.queries()
    assert "stack_linear" in left and "pipeline" not in left and not any(name.startswith("op1") for name in left)
