"""Running totals and sliding counts over a whole table by prefix scans, and summaries that merge over batches.

A scan sorts the table once in ranges; each range is summed up by itself, row after row, and shifted by the sums of the ranges before it.
Those are one row per range at the driver.  No task sees more than its range, however the times lie: rows of equal time are
parted by the rest of the order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leadmill.operators.ranks import scratch

PART, ROW = "_part", "_row"
#: Size parameter of the quantile sketches, and the rank error that estimates stay under (some 0.4 % at that size; a margin above).
SKETCH, RANK_ERROR = 800, 0.01


def _local_sums(names: Sequence[str]):
    """Each range's running sums of the columns ``names``, null as 0, the range's number and the row's in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, seen = TaskContext.get().partitionId(), dict.fromkeys(names, 0), 0
        for b in batches:
            columns = list(b.columns)
            for n in names:
                sums = np.cumsum(np.asarray(b.column(n).fill_null(0), np.int64)) + before[n]
                before[n] = int(sums[-1]) if len(sums) else before[n]
                columns[b.schema.get_field_index(n)] = pa.array(sums)
            at = pa.array(np.arange(seen, seen + b.num_rows))
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b.num_rows, part, np.int64)), at], [*b.schema.names, PART, ROW])

    return run


def running(df: DataFrame, order: Sequence[Column], **measures: Column) -> DataFrame:
    """``df`` with the running total of each measure (longs, null as 0) up to and with each row in ``order``, which ends in a tie-break.

    Totals have 64 bits.  An empty table gives no rows.
    """
    spark, names, path = df.sparkSession, list(measures), scratch(df.sparkSession)
    rows = df.withColumns({n: c.cast("long") for n, c in measures.items()})
    schema = StructType([*rows.schema, StructField(PART, LongType()), StructField(ROW, LongType())])
    # Ranges are cut by a sample, so what is read below is written once.
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_local_sums(names), schema).write.parquet(path)
    walk = spark.read.schema(schema).parquet(path)
    base, total = [], dict.fromkeys(names, 0)
    for r in sorted(walk.groupBy(PART).agg(*(F.max_by(n, ROW).alias(n) for n in names)).collect()):
        base.append((r[PART], *(total[n] for n in names)))
        total = {n: total[n] + r[n] for n in names}
    bases = spark.createDataFrame(base, ", ".join([f"{PART} long", *(f"_base_{n} long" for n in names)]))
    return walk.join(F.broadcast(bases), PART).withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in names}).drop(PART, ROW, *(f"_base_{n}" for n in names))


def sliding_counts(events: DataFrame, ident: str, time: str, span: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ``ident``, n): how many events of its keys lie in the last ``span`` (units of ``time``, a long) up to each event, both ends and all of its own time counted in.

    Every event is put in the order of time three times: where its span begins, as itself, and behind the events of its time.  The running
    count of events at the last of these less that at the first is its answer, so no window has to hold a span's rows.  An
    event without a time has none, and is counted for nobody; ``ident`` is unique.
    """
    spots = F.array(F.struct((F.col(time) - span).alias("_at"), F.lit(0).alias("_kind")), F.struct(F.col(time).alias("_at"), F.lit(1).alias("_kind")), F.struct(F.col(time).alias("_at"), F.lit(2).alias("_kind")))
    d = events.where(F.col(time).isNotNull()).select(*keys, ident, F.explode(spots).alias("_s")).select(*keys, ident, "_s.*")
    order = [*map(F.col, keys), F.col("_at"), F.col("_kind"), F.col(ident)]
    seen = running(d, order, _n=F.when(F.col("_kind") == 1, 1).otherwise(0)).where("_kind <> 1")
    return seen.groupBy(*keys, ident).agg(F.sum(F.when(F.col("_kind") == 2, F.col("_n")).otherwise(-F.col("_n"))).alias("n"))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key that stands for its values: (keys, n, total, low, high, sketch); null values don't count."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch"))


def merged(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary of all values behind rows of ``summary``, in any order and grouping."""
    return summaries.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def estimates(summaries: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """``summaries`` with a column per wanted quantile in place of the sketch; their ranks are within ``RANK_ERROR`` of the wanted ones."""
    got = {n: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))) for n, q in wanted.items()}
    return summaries.withColumns(got).drop("sketch")


def rank_errors(df: DataFrame, keys: Sequence[str], value: str, estimated: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """(keys, a column per wanted quantile): how far the estimate's exact rank in ``df`` is from the wanted one, as a share of the rows.

    A value that repeats has all the ranks of its copies.
    """
    e = estimated.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(n).alias(f"_{n}") for n in wanted))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = df.where(F.col(value).isNotNull()).join(F.broadcast(e) if not keys else e, same)
    counts = [c for n in wanted for c in (F.count_if(F.col(value) < F.col(f"_{n}")).alias(f"_{n}_low"), F.count_if(F.col(value) <= F.col(f"_{n}")).alias(f"_{n}_high"))]
    g = both.groupBy(*keys).agg(F.count("*").alias("_n"), *counts)
    off = lambda n, q: F.greatest(F.lit(0.0), F.col(f"_{n}_low") / F.col("_n") - q, q - F.col(f"_{n}_high") / F.col("_n"))
    return g.select(*keys, *(off(n, q).alias(n) for n, q in wanted.items()))
