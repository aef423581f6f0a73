"""Many queries at once against a plain search."""

from __future__ import annotations

import math

import numpy as np
import pytest

from leadmill.operators import nearest

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, queries, k):
    usable = lambda e: e and all(x is not None and math.isfinite(x) for x in e)
    unit = lambda e: np.array(e) / (np.linalg.norm(e) or 1)
    out = []
    for q, e in queries:
        if q is None or not usable(e):
            continue
        scored = sorted((-round(float(unit(e) @ unit(v)), 6), i) for i, v in rows if i is not None and usable(v) and i != q and len(v) == len(e))
        out += [(q, n + 1, i, -s + 0.0) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("run_rows", [1024, 16])
def test_nearest_to_each(spark, monkeypatch, run_rows):
    monkeypatch.setattr(nearest, "RUN_ROWS", run_rows)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(300)] + [(300 + i, r.normal(size=5).tolist()) for i in range(9)]
    rows += [(400 + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(500, None), (501, []), (502, [None] * 8), (503, [math.nan] * 8), (504, [0.0] * 8), (None, [1.0] * 8)]
    queries = [row for row in rows if row[0] is None or row[0] % 7 == 0 or row[0] > 490]
    df = lambda x: spark.createDataFrame(x, SCHEMA).repartition(3)
    for k in (1, 5, 1000):
        got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in nearest.nearest_to_each(df(rows), df(queries), k).collect())
        assert [g[:3] for g in got] == [w[:3] for w in plain(rows, queries, k)]
        assert np.allclose([g[3] for g in got], [w[3] for w in plain(rows, queries, k)])
    assert nearest.nearest_to_each(df(rows).where("false"), df(queries), 3).count() == 0
    assert nearest.nearest_to_each(df(rows), df(queries).where("false"), 3).count() == 0


def test_cells_with_some_of_the_rows_and_queries(spark, monkeypatch):
    """Ties, own rows, two lengths and unusable vectors where every query meets its rows in several cells."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 40)
    monkeypatch.setattr(nearest, "CELL_QUERIES", 15)
    r = np.random.default_rng(8)
    rows = [(i, r.integers(-2, 3, size=4).astype(float).tolist()) for i in range(400)] + [(400 + i, r.normal(size=3).tolist()) for i in range(9)] + [(500, None), (501, []), (502, [None] * 4), (503, [math.inf] * 4)]
    queries = [row for row in rows if row[0] % 5 == 0]
    df = lambda x: spark.createDataFrame(x, SCHEMA).repartition(3)
    for k in (1, 7, 500):
        got = sorted((x.query_id, x.rank, x.vec_id) for x in nearest.nearest_to_each(df(rows), df(queries), k).collect())
        assert got == [w[:3] for w in plain(rows, queries, k)]


def test_no_batch_of_a_task_is_larger_than_its_rows(spark, monkeypatch, tmp_path):
    """What Python gets at once is some rows, however many rows and queries there are, and each row comes once."""
    v = spark.range(20_000).selectExpr("id as vec_id", "transform(sequence(1, 16), i -> sin(id * i)) as embedding")
    kind, path = type(v), str(tmp_path / "seen")

    def counted(self, f, schema, real=kind.mapInArrow):
        def run(batches):
            def each():
                for b in batches:
                    with open(path, "a") as out:
                        out.write(f"{b.num_rows} {b.get_total_buffer_size()}\n")
                    yield b

            return f(each())

        return real(self, run, schema)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert nearest.nearest_to_each(v, v.where("vec_id % 5 = 0"), 3).count() == 12_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows, size = zip(*(map(int, line.split()) for line in open(path)))
    assert max(size) < 100_000
    assert 20_000 + 4000 <= sum(rows) <= 20_000 + 4000 * 4


def test_runs_that_cannot_win_are_left_out(monkeypatch):
    """Rows that lie in the other half of the components than the queries are never multiplied."""
    monkeypatch.setattr(nearest, "RUN_ROWS", 50)
    r = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near, far = (unit(np.concatenate((r.normal(size=(200, 4)) * a, r.normal(size=(200, 4)) * b), axis=1)) for a, b in ((1, 0.01), (0.01, 1)))
    x, q = np.concatenate((far, near)), near[:20] + 0.001
    made = []
    real = np.round
    monkeypatch.setattr(nearest.np, "round", lambda s, d: (made.append(s.shape[1]), real(s, d))[1])
    ids, names, _ = nearest.best_of_block(np.arange(400), x, np.arange(1000, 1020), unit(q), 3)
    assert len(ids) == 60 and (names >= 200).all() and sum(made) <= 200
