"""Ranks of a whole table without one task that sees it all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder; only a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='leadmill-')}"
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers of all rows; ``order`` ends in a tie-break.

    Ranges are sorted and numbered apart, and shifted by the rows of the ranges before; one count per range comes to the driver.
    """
    path = scratch(df.sparkSession)
    walk = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    walk.write.parquet(path)
    walk = df.sparkSession.read.schema(walk.schema).parquet(path)
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in walk.groupBy(part.alias("part")).count().collect())
    base, total = [], 0
    for p, n in sizes:
        base.append((p, total))
        total += n
    bases = df.sparkSession.createDataFrame(base, "_part long, _base long")
    return walk.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + local + 1).drop("_part", "_base", "_at")


def percentiles(df: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(key, a column per wanted quantile): exact, interpolated between the two nearest values; null values don't count.

    The table is sorted once in ranges and numbered; only the rows at the wanted ranks are picked, so that a key
    with most of the rows is spread over tasks like any other.
    """
    rows = numbered(df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v")), [F.col(key), F.col("_v")], "_rank")
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("_rank").alias("_from"))
    spots = F.array(*(F.struct(F.lit(n).alias("q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at")) for n, q in wanted.items()))
    spots = sizes.select(key, "_from", F.explode(spots).alias("s")).select(key, "s.q", (F.col("s.at") - F.floor("s.at")).alias("_part"), (F.col("_from") + F.floor("s.at")).alias("_low"), (F.col("_from") + F.ceil("s.at")).alias("_high"))
    ends = spots.select(F.explode(F.array("_low", "_high")).alias("_rank")).distinct()
    picked = rows.join(ends, "_rank").select("_rank", "_v")
    low, high = picked.select(F.col("_rank").alias("_low"), F.col("_v").alias("_a")), picked.select(F.col("_rank").alias("_high"), F.col("_v").alias("_b"))
    out = spots.join(low, "_low").join(high, "_high").withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    return out.groupBy(key).agg(*(F.max(F.when(F.col("q") == n, F.col("_x"))).alias(n) for n in wanted))
