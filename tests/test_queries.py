"""Every registered query of the engine against its SQL twin on the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from leadmill.operators import ranks
from leadmill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def con(smoke_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{smoke_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql_twin(spark, con, smoke_dir, name):
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = catalogue.QUERIES[name](spark, smoke_dir)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(norm, r)) for r in want.fetchall())


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_all_rows_are_numbered_in_ranges(spark, smoke_dir):
    """Every order gets its rank, nulls last, and no task ranks them all."""
    o = catalogue.table(spark, smoke_dir, "orders").selectExpr("o_orderkey", "if(o_orderkey % 5 = 0, null, o_custkey) as m").repartition(3)
    out = ranks.numbered(o, [F.desc_nulls_last("m"), F.asc("o_orderkey")], "rank")
    assert "Window" not in out._jdf.queryExecution().toString()
    rows = sorted((r.rank, r.m is None, -(r.m or 0), r.o_orderkey) for r in out.collect())
    assert [r[0] for r in rows] == list(range(1, o.count() + 1))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert ranks.numbered(o.where("false"), [F.asc("o_orderkey")], "rank").count() == 0
