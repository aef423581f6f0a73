"""Prefix scans against plain loops, on hot times and nulls; summaries that merge in any order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leadmill.operators import scans


@pytest.fixture(scope="module")
def events(spark):
    """A third of all rows at one time; null times, keys and values; negative values."""
    r = random.Random(4)
    rows = [(i, 500 if i % 3 == 0 else None if i % 41 == 0 else r.randint(0, 1000), r.choice(["a", "b", None]), None if i % 7 == 0 else r.randint(-50, 50)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "id long, at long, kind string, value long").repartition(7)


def test_running_totals(events):
    rows, df = events
    out = scans.running(df, [F.asc_nulls_first("at"), F.asc("id")], n=F.lit(1), total=F.col("value"))
    assert "Window" not in out._jdf.queryExecution().toString()
    want, n, total = [], 0, 0
    for i, at, _, v in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])):
        n, total = n + 1, total + (v or 0)
        want.append((i, n, total))
    assert sorted((r.id, r.n, r.total) for r in out.collect()) == sorted(want)
    assert scans.running(df.where("false"), [F.col("id")], n=F.lit(1)).count() == 0


@pytest.mark.parametrize("keys", [[], ["kind"]])
@pytest.mark.parametrize("span", [0, 60, 5000])
def test_sliding_counts(events, keys, span):
    rows, df = events
    timed = [(i, at, k) for i, at, k, _ in rows if at is not None]
    want = sorted((i, sum(1 for _, b, q in timed if at - span <= b <= at and (not keys or q == k))) for i, at, k in timed)
    out = scans.sliding_counts(df, "id", "at", span, keys)
    assert sorted((r.id, r.n) for r in out.collect()) == want


def test_no_task_sorts_a_hot_time_alone(spark):
    """All events at one time: their ranges are still several."""
    df = spark.range(20_000).select(F.col("id"), F.lit(7).cast("long").alias("at"))
    assert {r.n for r in scans.sliding_counts(df, "id", "at", 10).select("n").distinct().collect()} == {20_000}
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # small ranges would be read together
    try:
        files = scans.running(df, [F.col("at"), F.col("id")], n=F.lit(1)).select(F.input_file_name().alias("f")).distinct().count()
    finally:
        spark.conf.unset(name)
    assert files > 1


def test_summaries_merge_in_any_order(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), None if i % 50 == 0 else 5.0 if i % 3 == 0 else r.expovariate(0.2)) for i in range(30_000)] + [("none", None)]
    df = spark.createDataFrame(rows, "kind string, value double").repartition(5)
    wanted = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    parts = [scans.summary(df.where(F.pmod(F.hash("value"), F.lit(4)) == k), ["kind"], "value") for k in range(4)]
    orders = [[0, 1, 2, 3], [3, 1, 0, 2]]
    for order in orders:
        acc = parts[order[0]]
        for k in order[1:]:
            acc = scans.merged(acc.unionByName(parts[k]), ["kind"])
        rest = scans.summary(df.where("value is null"), ["kind"], "value")
        said = scans.estimates(scans.merged(acc.unionByName(rest), ["kind"]), wanted)
        for x in said.collect():
            values = sorted(v for k, v in rows if k == x.kind and v is not None)
            assert x.n == len(values)
            if not values:
                assert x.p50 is None and x.total is None
                continue
            assert x.low == values[0] and x.high == values[-1] and abs(x.total - sum(values)) < 1e-6 * sum(values)
            for name, q in wanted.items():
                low, high = sum(v < x[name] for v in values) / len(values), sum(v <= x[name] for v in values) / len(values)
                assert low - q <= scans.RANK_ERROR and q - high <= scans.RANK_ERROR
    off = scans.rank_errors(df, ["kind"], "value", scans.estimates(scans.summary(df, ["kind"], "value"), wanted), wanted).collect()
    assert len(off) == 3 and all(x[n] <= scans.RANK_ERROR for x in off for n in wanted)
