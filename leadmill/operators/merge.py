"""Sinks as pure functions old x batch -> new: upserts, inserts, partial and predicate updates, the master merge.

A target is rewritten as a whole (or by partition, with dynamic overwrite); a v2 table
with MERGE INTO can replace the rewrite without a change for callers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in ``order``, which should end in a tie-break.

    Spark keeps a key's first row per task before it shuffles (WindowGroupLimit), so a hot key is one row per
    task.  Null keys are a key of their own; an empty table gives no rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """ON CONFLICT DO UPDATE: the batch's last row per key replaces the target's.

    As in a unique index, a null key equals none: such rows of either side are all kept.  Columns of one side alone
    are null in the other's rows; an empty batch leaves the target.
    """
    nameless = F.lit(False)
    for k in keys:
        nameless = nameless | F.col(k).isNull()
    named = last_per_key(batch.where(~nameless), keys, order)
    return target.join(named, list(keys), "left_anti").unionByName(named, allowMissingColumns=True).unionByName(batch.where(nameless), allowMissingColumns=True)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING; of equal keys inside the batch one is kept, and one of those with a null key."""
    return target.unionByName(batch.dropDuplicates(list(keys)).join(target, list(keys), "left_anti"), allowMissingColumns=True)


def replace_partition(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete and reinsert: all rows of the keys in the batch are replaced by the batch; null keys replace none."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch, allowMissingColumns=True)


def update_where(df: DataFrame, predicate: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(predicate, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_keep_old(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """COALESCE(new, old) for the rows that the updates name."""
    new = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = target.join(new, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def propagate(target: DataFrame, source: DataFrame, key: str, other_than: str, **values) -> DataFrame:
    """Set values where a source row has the same key but another ``other_than``."""
    hit = has_other(target, source, key, other_than)
    return hit.withColumns({c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")


def has_other(target: DataFrame, source: DataFrame, key: str, other_than: str) -> DataFrame:
    """``target`` with ``_hit``: a source row has the same key but another ``other_than``.

    Two bounds per key say so: one of them differs unless all are equal, so the join is an equi-join of one row per key.
    """
    s = source.where(F.col(other_than).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(other_than).alias("_lo"), F.max(other_than).alias("_hi"))
    hit = F.coalesce((F.col("_lo") != F.col(other_than)) | (F.col("_hi") != F.col(other_than)), F.lit(False))
    return target.join(s, F.col(key) == F.col("_k"), "left").withColumn("_hit", hit).drop("_k", "_lo", "_hi")


def update_by_other_key(target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the updated table, ``updates`` with ``matched``): rows found by a secondary key take the updates' values.

    Of several updates for one key the one with the largest values counts; a null key matches nothing.
    """
    one = updates.groupBy(key).agg(F.max(F.struct(*columns)).alias("_u"))
    out = target.join(one, key, "left").withColumns({c: F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in columns}).drop("_u")
    known = target.select(key).distinct().withColumn("_m", F.lit(True))
    return out, updates.join(known, key, "left").withColumn("matched", F.coalesce("_m", F.lit(False))).drop("_m")


def finalize(df: DataFrame, where: Column, **values) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the values set where the predicate holds, one row with how many ``updated``)."""
    return update_where(df, where, **values), df.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("updated"))


def delete_by_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows without those whose key is in ``keys``; a null key stays."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value; a value of None asks nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def merge_candidates(existing: DataFrame, candidates: DataFrame, source: str, first: str = "hunter") -> DataFrame:
    """Full outer merge of (request_id, domain, organization, source, job_id) with a source's candidates.

    The first source owns job and organization once it has spoken; a null organization never
    overwrites; sources add up in a fixed order; rows of neither side are lost.
    """
    e = existing.select("request_id", "domain", F.col("organization").alias("_eo"), F.col("source").alias("_es"), F.col("job_id").alias("_ej"))
    c = candidates.select("request_id", "domain", F.col("organization").alias("_co"), F.col("job_id").alias("_cj"))
    owner = F.lit(source == first)
    both = F.col("_es").isNotNull() & F.col("_cj").isNotNull()
    merged_source = F.when(F.col("_cj").isNull() | F.col("_es").contains(source), F.col("_es")).when(F.col("_es").isNull(), F.lit(source)).otherwise(F.lit("hunter, google_maps"))
    taken = F.col("_es").contains(first) & ~owner
    return e.join(c, ["request_id", "domain"], "full").select(
        "request_id",
        "domain",
        F.when(both & taken, F.coalesce("_eo", "_co")).when(both, F.coalesce("_co", "_eo")).otherwise(F.coalesce("_eo", "_co")).alias("organization"),
        merged_source.alias("source"),
        F.when(both & taken, F.col("_ej")).otherwise(F.coalesce("_cj", "_ej")).alias("job_id"),
    )


def sheet_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A fixed header: missing columns become empty, NULL becomes empty text."""
    have = set(df.columns)
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns))
