"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights.  Candidate rows are packed into blocks, and a
block is turned into postings: per term the rows that have it and their weights.  For a
block of queries, term after term, the query weights times the term's postings are
scattered into dense score arrays; the best k of each query are selected by
partition, and the blocks' selections are merged.  Every query meets every row; work and
traffic are Q*N in blocks, which is what an exhaustive search costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_ROWS = 8192
QUERY_ROWS = 512
#: Queries whose score arrays are filled together, and share of a block above which a posting list is kept dense.
TILE, DENSE = 32, 0.3
BLOCK = "part long, seq long, ids binary, terms binary, weights binary, bounds binary"


def quantize(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row is usable, terms, weights, bounds of usable rows): floor(scale * x), zeros left out.

    Rows that are null or hold a null or non-finite component are not usable.  A weight that
    is no 63-bit integer raises: scores of longs can't hold it.
    """
    offsets = np.asarray(vectors.offsets, np.int64)
    values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])
    x = np.asarray(values.cast(pa.float64()).fill_null(math.nan))
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    ok = np.asarray(vectors.is_valid()) & (np.bincount(row, ~np.isfinite(x), len(size)) == 0)
    term = np.arange(len(x)) - np.repeat(offsets[:-1] - offsets[0], size)
    w = np.floor(np.where(np.isfinite(x) & ok[row], x, 0) * scale)
    if np.abs(w).max(initial=0) >= 2.0**62:
        raise OverflowError("a component times the scale is beyond 62 bits")
    w = w.astype(np.int64)
    keep = ok[row] & (w != 0)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(size))[ok])))
    return ok, term[keep].astype(np.int32), w[keep], bounds


def pack_blocks(rows: int, scale: float):
    """Rows of each task, in the order read, as blocks of at most ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        count = 0

        def block():
            nonlocal seq, count
            ids, terms, weights = (np.concatenate([h[i] for h in held]) for i in range(3))
            bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(h[3]) for h in held]))))
            held.clear()
            count, seq = 0, seq + 1
            cols = [pa.array([part]), pa.array([seq])] + [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ids, terms, weights, bounds.astype(np.int64))]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BLOCK.split(", ")])

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, min(rows - count, whole.num_rows - at))
                at += batch.num_rows
                ok, terms, weights, bounds = quantize(batch.column("embedding"), scale)
                held.append((np.asarray(batch.column("vec_id"))[ok], terms, weights, bounds))
                count += batch.num_rows
                if count >= rows:
                    yield block()
        if count:
            yield block()

    return run


def search(k: int):
    """The k best of each query block in each candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                ids, qids = get("ids", np.int64), get("q_ids", np.int64)
                if not len(ids) or not len(qids):
                    continue
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                ids = ids[order]
                bounds, qb = get("bounds", np.int64), get("q_bounds", np.int64)
                terms, weights = get("terms", np.int32), get("weights", np.int64)
                qt, qw = get("q_terms", np.int32), get("q_weights", np.int64)
                biggest = int(np.abs(weights).max(initial=0)) * int(np.abs(qw).max(initial=0)) * (int(max(terms.max(initial=0), qt.max(initial=0))) + 1)
                # Beyond 63 bits the sums are Python's integers: slow, and exact.
                kind = np.int32 if biggest < 1 << 31 else np.int64 if biggest < 1 << 63 else object
                postings: dict[int, tuple] = {}
                rows = place[np.repeat(np.arange(len(ids)), np.diff(bounds))]
                by_term = np.argsort(terms, kind="stable")
                wanted, first = np.unique(terms[by_term], return_index=True)
                for t, a, b in zip(wanted.tolist(), first.tolist(), [*first[1:].tolist(), len(terms)], strict=True):
                    where, w = rows[by_term[a:b]], weights[by_term[a:b]].astype(kind)
                    if len(where) > DENSE * len(ids):
                        full = np.zeros(len(ids), kind)
                        full[where] = w
                        postings[t] = (None, full)
                    else:
                        postings[t] = (where, w)
                out: list[tuple[np.ndarray, ...]] = []
                query_of = np.repeat(np.arange(len(qids)), np.diff(qb))
                step = np.empty((TILE, len(ids)), kind)
                for lo in range(0, len(qids), TILE):
                    hi = min(lo + TILE, len(qids))
                    score = np.zeros((hi - lo, len(ids)), kind)
                    span = slice(int(qb[lo]), int(qb[hi]))
                    dense = np.zeros((int(qt.max(initial=0)) + 1, hi - lo), kind)
                    dense[qt[span], query_of[span] - lo] = qw[span].astype(kind)
                    for t in np.unique(qt[span]).tolist():
                        if t in postings:
                            where, w = postings[t]
                            if where is None:
                                np.multiply(dense[t][:, None], w[None, :], out=step[: hi - lo])
                                score += step[: hi - lo]
                            else:
                                score[:, where] += dense[t][:, None] * w[None, :]
                    # Among equal scores the smaller vec_id is further left: one key orders both.
                    key = score.astype(np.int64) * len(ids) + np.arange(len(ids) - 1, -1, -1) if biggest < (1 << 62) // max(1, len(ids)) else None
                    for i in range(hi - lo):
                        # The query's own rows, however many, lie side by side and take no place.
                        a, b = np.searchsorted(ids, qids[lo + i], "left"), np.searchsorted(ids, qids[lo + i], "right")
                        n = min(len(ids) - (b - a), k)
                        if not n:
                            continue
                        if key is not None:
                            key[i, a:b] = np.iinfo(np.int64).min
                            best = np.argpartition(key[i], len(ids) - n)[len(ids) - n :]
                        else:
                            best = np.array(sorted(range(len(ids)), key=lambda j: (-score[i][j], j)))  # noqa: B023
                            best = best[ids[best] != qids[lo + i]][:n]
                            if kind is object and max(map(abs, score[i][best])) >= 1 << 63:
                                raise OverflowError(f"a score of query {qids[lo + i]} is beyond a long")
                        out.append((np.full(len(best), qids[lo + i]), ids[best], score[i][best].astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, cell_rows: int = 4 * CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries`` by integer inner product.

    Both have vec_id and embedding; other columns are ignored.  Components become floor(scale * x).
    A query is not its own candidate; ties go to the smaller vec_id.  Vectors that are null, hold a null or
    a non-finite component, or have no vec_id take no part; a zero vector does.  A row whose vec_id repeats is a candidate each
    time and, as a query, asks once per distinct vec_id's rows; rows of the query's own vec_id are its own.
    Fewer than k candidates give all of them; an empty table gives no rows.  Sums are exact at any size; a
    returned score that no long can hold raises.
    """
    clean = lambda df: df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors, queries = clean(vectors), clean(queries)
    # A cell per ``cell_rows`` rows, or per core where that is more; the blocks shrink with them, down to 1024 rows.
    n = vectors.count()
    cells = max(1, -(-n // cell_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 2048))
    size = min(CANDIDATE_ROWS, max(1024, n // (2 * cells)))
    blocks = vectors.mapInArrow(pack_blocks(size, scale), BLOCK).withColumn("cell", F.pmod(F.xxhash64("part", "seq"), F.lit(cells))).repartition(cells, "cell")
    asked = queries.dropDuplicates(["vec_id"]).mapInArrow(pack_blocks(QUERY_ROWS, scale), BLOCK)
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "terms", "weights", "bounds")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("q_cell"))
    asked = asked.repartition(cells, "q_cell")
    pairs = blocks.join(asked, F.col("cell") == F.col("q_cell")).select("ids", "terms", "weights", "bounds", "q_ids", "q_terms", "q_weights", "q_bounds")
    found = pairs.mapInArrow(search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
