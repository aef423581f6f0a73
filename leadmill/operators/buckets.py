"""Tables laid out in hash buckets of a key, changed bucket by bucket, and views kept up by deltas.

A change reads and rewrites the buckets that its keys fall into and no other: their ids, at most as many as there are buckets,
prune the scan's partitions, and the write overwrites the partitions it has rows for.  The rows of a change that is written again
after a failure are the same, so it can be repeated.  Buckets are moved into place one after the other: readers
that need all of a change at once need a table format with commits in this one's place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from leadmill.operators.merge import replace_partition, upsert

BUCKET = "_bucket"


class Buckets:
    """A table in a folder: ``keys`` name a row, ``by`` (the keys unless given) choose its bucket of ``count``."""

    def __init__(self, df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str] | None = None, count: int = 64):
        self.path, self.keys, self.by, self.count = path, list(keys), list(by or keys), count
        self.spark: SparkSession = df.sparkSession
        self.schema = StructType([*df.schema, StructField(BUCKET, IntegerType())])
        self._write(self.placed(df))

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.by), F.lit(self.count)).cast("int"))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop(BUCKET)

    def ids(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``, which have the columns of ``by``; never more than there are buckets."""
        return sorted(r[0] for r in self.placed(rows.select(*self.by)).select(BUCKET).distinct().collect())

    def rows_of(self, ids: list[int]) -> DataFrame:
        """All rows of some buckets; the scan lists and reads their files alone."""
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col(BUCKET).isin(ids))

    def upsert(self, batch: DataFrame, order: Sequence[Column]) -> list[int]:
        """ON CONFLICT DO UPDATE within the batch's buckets, which are returned; rows as ``merge.upsert``."""
        return self._change(batch, lambda old, new: upsert(old, new, self.keys, order))

    def replace(self, batch: DataFrame, keys: DataFrame | None = None) -> list[int]:
        """Delete and reinsert: rows of the keys in ``keys`` (the batch's unless given) go, the batch's rows come."""
        if keys is None:
            return self._change(batch, lambda old, new: replace_partition(old, new, self.keys))
        ids = sorted({*self.ids(batch), *self.ids(keys)})
        return self._rewrite(ids, self.rows_of(ids).join(keys.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(self.placed(batch)))

    def delete(self, keys: DataFrame) -> list[int]:
        ids = self.ids(keys)
        return self._rewrite(ids, self.rows_of(ids).join(keys.select(*self.keys).distinct(), self.keys, "left_anti"))

    def _change(self, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        ids = self.ids(batch)
        return self._rewrite(ids, merged(self.rows_of(ids), self.placed(batch)))

    def _rewrite(self, ids: list[int], rows: DataFrame) -> list[int]:
        written = self._write(rows.select(self.schema.names))
        for i in set(ids) - written:  # a bucket that has lost its last row has no rows to be overwritten by
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={i}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return ids

    def _write(self, rows: DataFrame) -> set[int]:
        """Overwrite the buckets that ``rows`` has rows for, and say which; adaptive execution sizes the files of a bucket, so a large one is written by several tasks."""
        seen = Observation()
        rows = rows.hint("rebalance", BUCKET).observe(seen, F.collect_set(BUCKET).alias("ids"))
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(self.path)
        return set(seen.get["ids"])


class JoinView:
    """A view of two bucketed tables with one key, kept up by deltas.

    ``combine`` gives the view's rows of some keys from both tables' rows of those keys.  A batch of either side changes its table and
    names keys; new rows meet the other side's state and the other way round for those keys alone, and their rows are
    replaced in the view.  All three are laid out alike, so a batch reads and writes the same buckets of each.
    """

    def __init__(self, left: Buckets, right: Buckets, path: str, combine: Callable[[DataFrame, DataFrame], DataFrame]):
        self.left, self.right, self.combine = left, right, combine
        self.view = Buckets(combine(left.read(), right.read()), path, left.keys, left.by, left.count)

    def apply(self, order: Sequence[Column], left: DataFrame | None = None, right: DataFrame | None = None) -> list[int]:
        """Take in a batch of rows of either side or both, the last of a key in ``order``; gives the buckets touched."""
        keys, batches = self.left.keys, [(t, b) for t, b in ((self.left, left), (self.right, right)) if b is not None]
        if not batches:
            return []
        changed = batches[0][1].select(*keys)
        for _, b in batches[1:]:
            changed = changed.unionByName(b.select(*keys))
        changed = changed.distinct()
        for t, b in batches:
            t.upsert(b, order)
        ids = self.left.ids(changed)
        now = lambda t: t.rows_of(ids).drop(BUCKET).join(changed, keys, "left_semi")
        return self.view.replace(self.combine(now(self.left), now(self.right)), changed)


