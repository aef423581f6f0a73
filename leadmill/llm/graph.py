"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes that have an edge.

    Edges are undirected longs; self-loops and null ends are ignored.  Each round
    hangs the larger neighbours of a node under its smallest neighbour (large
    star), then the smaller ones (small star).  Only minima per node are grouped,
    so partial aggregation takes care of hubs, and the joins back are plain
    equi-joins that adaptive execution can split.  The edge table shrinks to a
    star forest in O(log n) rounds; each round is a table in the shared folder.
    A graph that is no star forest after ``rounds`` raises: nothing is returned half done.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = materialize(e)
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.where("a <> b").distinct())
        now = nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        discard(e)
        e = nxt
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"the components have not settled in {rounds} rounds")
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)
