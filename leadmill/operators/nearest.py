"""The rows of an index closest by cosine to each of many query vectors.

Rows and queries are dealt to a grid of cells, each with its share of the rows and its share of the queries.  A task holds a cell's
queries with their best so far, and the cell's rows stream past them, so its memory is one batch of rows, one cell's queries and a tile of scores,
whatever the number of rows.  A batch's rows are in order of how much of them lies in the first half of the components, in runs; a run is left out where even its best
bound, |head| |head| + |tail| |tail|, is under the k-th score that each query of the block has by then.  What leaves a cell is k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows and queries of a cell at most, on average; a block of queries meets a run of rows as a matrix product.
CELL_ROWS, CELL_QUERIES, QUERY_ROWS, RUN_ROWS = 65_536, 8192, 1024, 1024
#: Rows that a cell's queries may hold together.
CELL_FOUND = 4_000_000


def _norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return np.linalg.norm(x[:, :half], axis=1), np.linalg.norm(x[:, half:], axis=1)


class _Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        self.query_ids, self.q, self.k, self.norms = query_ids, q, k, _norms(q)
        # Of what is found, in order of query, score and id; then the score to reach.
        self.at, self.names, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(q), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, head: np.ndarray, tail: np.ndarray) -> None:
        for start in range(0, len(x), RUN_ROWS):
            run = slice(start, start + RUN_ROWS)
            if (self.norms[0] * head[run].max() + self.norms[1] * tail[run].max() + 1e-6 < self.least).all():
                continue
            score = np.round(self.q @ x[run].T, 6)
            score[self.query_ids[:, None] == ids[run][None]] = -np.inf
            # The first run says by itself what to reach: else all of it would be sorted.
            least = self.least if len(self.at) or score.shape[1] <= self.k else np.partition(score, -self.k, axis=1)[:, -self.k]
            at, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            if len(at):
                self._keep(at, ids[run][column], score[at, column])

    def _keep(self, at: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        at, names, scores = (np.concatenate(c) for c in ((self.at, at), (self.names, names), (self.scores, scores)))
        order = np.lexsort((names, -scores, at))
        first = np.searchsorted(at[order], np.arange(len(self.q)))
        order = order[np.arange(len(order)) - first[at[order]] < self.k]
        self.at, self.names, self.scores = at[order], names[order], scores[order]
        last = np.searchsorted(self.at, np.arange(len(self.q)), side="right") - 1
        full = np.bincount(self.at, minlength=len(self.q)) >= self.k
        self.least[full] = self.scores[last[full]]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.query_ids[self.at], self.names, self.scores


def _by_head(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    head, tail = _norms(x)
    order = np.argsort(-head, kind="stable")
    return ids[order], x[order], head[order], tail[order]


def best_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows of a block but its own, scores rounded to six places, ties to the smaller id."""
    best = _Best(query_ids, q, k)
    best.add(*_by_head(ids, x))
    return best.found()


def _units(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Usable rows of a batch as unit vectors, by length."""
    vectors = batch.column("embedding")
    sizes = np.diff(np.asarray(vectors.offsets))
    for dim in np.unique(sizes[sizes > 0]).tolist():
        part = batch.filter(pa.array((sizes == dim) & np.asarray(vectors.is_valid())))
        x = np.asarray(part.column("embedding").flatten().fill_null(math.nan)).reshape(-1, dim)
        ok = np.isfinite(x).all(axis=1)
        x, norm = x[ok], np.linalg.norm(x[ok], axis=1, keepdims=True)
        yield dim, np.asarray(part.column("vec_id"))[ok], np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _search(k: int):
    """Of batches in order of cell, its queries first."""

    def found(held: dict[int, list[_Best]]) -> Iterator[pa.RecordBatch]:
        for best in sum(held.values(), []):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.found()], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            cells, kinds = (np.asarray(batch.column(c)) for c in ("cell", "kind"))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                if cells[start] != cell:
                    yield from found(held)
                    cell, held = cells[start], {}
                for dim, ids, x in _units(batch.slice(start, end - start)):
                    if kinds[start] == 0:
                        held.setdefault(dim, []).extend(_Best(ids[i : i + QUERY_ROWS], x[i : i + QUERY_ROWS], k) for i in range(0, len(x), QUERY_ROWS))
                    elif dim in held and len(x):
                        block = _by_head(ids, x)
                        for best in held[dim]:
                            best.add(*block)
        yield from found(held)

    return run


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` closest to each row of ``queries`` (both vec_id, embedding), its own vec_id left out.

    Scores are cosines rounded to six places, ties go to the smaller vec_id, a zero vector scores 0.  Vectors that are null or empty or hold a null or
    non-finite component, and rows without a vec_id, take no part; vectors of different lengths don't meet; ids are unique.
    """
    clean = lambda d: d.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors, queries = clean(vectors), clean(queries)
    # The counts say how often rows and queries are copied: a row goes to each share of the queries, a query to each share of the rows.
    n, shares = vectors.count(), lambda of, size: -(-of // size)
    across = max(1, shares(queries.count(), max(1, min(CELL_QUERIES, CELL_FOUND // k))))
    down = max(1, shares(n, CELL_ROWS), min(shares(n, RUN_ROWS), shares(vectors.sparkSession.sparkContext.defaultParallelism, across)))
    share = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    asked = queries.select("*", F.lit(0).alias("kind"), share(across).alias("a"), each(down).alias("b"))
    rows = vectors.select("*", F.lit(1).alias("kind"), each(across).alias("a"), share(down).alias("b"))
    met = asked.unionByName(rows).select("vec_id", "embedding", "kind", (F.col("b") * across + F.col("a")).cast("int").alias("cell"))
    met = met.repartitionById(across * down, "cell").sortWithinPartitions("cell", "kind")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
