"""Ranking, selection and grouping with evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefer_else_all(df: DataFrame, keys: Sequence[str], match: Column) -> DataFrame:
    """Matching rows of a key if there are any, else all of its rows."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"_m": F.coalesce(match, F.lit(False))}).withColumn("_any", F.max("_m").over(w)).where("_m or not _any").drop("_m", "_any")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def guardrail(df: DataFrame, keys: Sequence[str], raw: str, protected: Column, order: Sequence[Column], margin: int = 15) -> DataFrame:
    """One row per key: the best, unless a protected one is within ``margin`` of it."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_p", F.coalesce(protected, F.lit(False))).withColumn("_top", F.max(raw).over(w))
    d = d.withColumn("_e", F.col("_p") & (F.col(raw) >= F.col("_top") - margin))
    return top_n(d, keys, [F.desc("_e"), F.desc(raw), *order], 1, "_n").drop("_p", "_top", "_e", "_n")


def group_evidence(df: DataFrame, keys: Sequence[str], value: Column, evidence: Column, seq: Column, rank: Column | None = None) -> DataFrame:
    """Values grouped without case: first-seen spelling, evidence in order of rank and then seq.

    The evidence is a list in one row, for values that few rows name; ``evidence.grouped`` keeps it in rows.
    """
    rank = rank if rank is not None else F.lit(0)
    d = df.select(*keys, value.alias("_v"), F.struct(rank.alias("rank"), seq.alias("seq"), evidence.alias("evidence")).alias("_e"), seq.alias("_s"))
    d = d.where(F.trim("_v") != "").groupBy(*keys, F.lower(F.trim("_v")).alias("key"))
    return d.agg(F.min_by(F.trim("_v"), "_s").alias("value"), F.array_sort(F.collect_list("_e")).alias("_l")).withColumn("evidence", F.transform("_l", lambda e: e["evidence"])).drop("_l")


def vote_majority(votes: DataFrame, keys: Sequence[str], voter: str, value: str, wins: int = 2) -> DataFrame:
    """The value at least ``wins`` voters agree on without case and blanks, else the first voter's."""
    canon = F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))
    counted = votes.groupBy(*keys, canon.alias("_c")).agg(F.countDistinct(voter).alias("n"), F.min(voter).alias("_f"), F.min_by(value, voter).alias("_v"))
    order = F.struct(F.when(F.col("n") >= wins, -F.col("n")).otherwise(0), F.col("_f"))
    return counted.groupBy(*keys).agg(F.min_by("_v", order).alias("value"), F.max("n").alias("votes"))


def vote_items(votes: DataFrame, keys: Sequence[str], voter: str, item: str, least: int = 2) -> DataFrame:
    """Items with at least ``least`` voters."""
    return votes.groupBy(*keys, F.lower(F.trim(item)).alias("item")).agg(F.countDistinct(voter).alias("votes")).where(F.col("votes") >= least)


def vote_union(votes: DataFrame, keys: Sequence[str], item: str, order: Sequence[Column]) -> DataFrame:
    """All items once, in the order first seen."""
    d = top_n(votes.withColumn("item", F.lower(F.trim(item))), [*keys, "item"], order, 1, "_n").drop("_n")
    return d.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows closest to one query vector, ties to the smaller vec_id; a TakeOrdered, no shuffle of the table.

    ``query`` is one row, broadcast.  Vectors of another length, or null, take no part; without a query vector there is no row; a
    zero norm scores 0.
    """
    both = vectors.crossJoin(F.broadcast(query)).where(F.size("embedding") == F.size("query"))
    return both.withColumn("score", F.round(cosine(F.col("embedding"), F.col("query")), 6)).orderBy(F.desc("score"), "vec_id").limit(k)
