"""Every registered query against its DuckDB oracle (or a rows-only run) at sf0.001."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from shelfspark.sources.tables import TABLES

#: The corpus operators have tests of their own in tests/llm.
QUERIES = {n: f for n, f in E.queries().items() if not re.match(r"op\d+_|pipeline", n)}
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert srows and all(any(v is not None for v in r) for r in srows)
        return
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, cur.fetchall())


def test_every_query_meets_every_vector():
    """SURVEY 2.4: registered, with SQL (the tests above hold its rows against it)."""
    assert "query_document_cross" in QUERIES and "query_document_cross" in ORACLES
