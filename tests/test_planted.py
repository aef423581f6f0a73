"""Operators on planted rows, one case each, against the rows stated beside them."""

from __future__ import annotations

import importlib

import duckdb
import pytest
from planted import CASES
from test_queries import norm

for _part in ("enrich", "crawling", "discovery", "mailing"):
    importlib.import_module(f"planted.{_part}_cases")


@pytest.mark.parametrize("name", sorted(CASES))
def test_planted_rows(spark, smoke_dir, name):
    run, sql = CASES[name]
    want = duckdb.connect().execute(sql)
    columns = [d[0] for d in want.description]
    df = run(spark, smoke_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(norm, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(norm, r)) for r in want.fetchall())
