"""Compression of vectors to short codes: a codebook for each part of the components, entries found by lower bounds.

Components become integers and a vector is cut into equal parts.  Each part takes the nearest of its
position's codebook entries.  Entries are filtered from coarse to fine: with S a block's sum of components, s its length and
r what is left of a part once the block's mean is taken out,

    |x - c|^2  >=  sum over blocks of (S(x) - S(c))^2 / s  +  (|r(x)| - |r(c)|)^2,

first with one block a part, then with two, four and so on.  An entry goes only where its bound is over the distance of an entry
already measured, the one whose bound was least at each step; the others get their exact integer distance, and ties go to the smaller index.  Bounds
are floats with a margin beyond their rounding, so that none goes wrongly.

A codebook is entries x components integers, whatever the number of vectors: the driver holds it and tasks get a copy.
A round is one scan, in which a task sums what it assigns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import bound_batches, materialize, tidy

#: Rows whose parts are compared with a codebook at once.
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Codebooks:
    """``entries``: per part its entries' integer components, in order; ``scale``: what components were multiplied with."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    scale: float

    @property
    def parts(self) -> int:
        return len(self.entries)

    @property
    def width(self) -> int:
        """Components of a part."""
        return max((len(e) for part in self.entries for e in part), default=0)

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def integers(vectors: pa.Array, scale: float, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row is usable, floor(scale * x) of the usable rows), padded with zeros to ``length`` or to the longest row.

    A row that is null or holds a null or non-finite component is not usable.  A component that is no 62-bit integer raises.
    """
    offsets = np.asarray(vectors.offsets, np.int64)
    x = np.asarray(vectors.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64()).fill_null(math.nan))
    size = np.where(np.asarray(vectors.is_valid()), np.diff(offsets), 0)
    full = np.diff(offsets)
    row = np.repeat(np.arange(len(full)), full)
    ok = np.asarray(vectors.is_valid()) & (np.bincount(row, ~np.isfinite(x), len(full)) == 0)
    mine = ok[row]
    with np.errstate(over="ignore"):
        v = np.floor(x[mine] * scale)
    if not (np.abs(v) < 2.0**62).all():
        raise OverflowError("a component times the scale is beyond 62 bits")
    size = size[ok]
    out = np.zeros((len(size), int(size.max(initial=0)) if length is None else length), np.int64)
    at = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = v.astype(np.int64)
    return ok, out


def block_bounds(width: int) -> list[np.ndarray]:
    """Starts of the blocks of a part, coarse to fine, down to blocks of more than one component."""
    levels, n = [], 1
    while n < width:
        levels.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return levels


def means_and_residual(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block sums over the root of the block's length, norm of what the means leave), as floats of exact integers."""
    size = np.diff([*starts, x.shape[1]])
    sums, squares = np.add.reduceat(x, starts, axis=1), np.add.reduceat(x * x, starts, axis=1)
    left = (squares * size - sums * sums).astype(float) / size
    return sums.astype(float) / np.sqrt(size), np.sqrt(left.sum(axis=1))


class Part:
    """The codebook of one part, ready to be compared with."""

    def __init__(self, entries: tuple[tuple[int, ...], ...]):
        self.width = max(map(len, entries), default=0)
        self.entries = np.array(entries, dtype=object).reshape(len(entries), self.width)
        self.most = max((abs(int(x)) for e in entries for x in e), default=0)
        self.levels = [(starts, *means_and_residual(self.entries, starts)) for starts in block_bounds(self.width)]
        self.narrow = self.entries.astype(np.int64) if self.most < 1 << 62 else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, squared distance, entries measured) of the nearest entry of each row of ``x``."""
        # Beyond 63 bits Python's integers count: slow, and exact.
        small = self.narrow is not None and self.width * max(4, self.width) * (int(np.abs(x).max(initial=0)) + self.most) ** 2 < 1 << 62
        x, c = (x, self.narrow) if small else (x.astype(object), self.entries)
        n, k = len(x), len(c)
        measure = lambda i, j: ((x[i] - c[j]) ** 2).sum(axis=1)
        if not self.width or k == 1:
            return np.zeros(n, np.int64), measure(np.arange(n), np.zeros(n, np.int64)), np.ones(n, np.int64)
        # Well over what rounding makes of a bound: a share of it, and of the squared norms for what cancels out.
        slack = 1e-9 + 1e-18 * ((x * x).sum(axis=1).astype(float) + float((c * c).sum(axis=1).max()))
        limit = lambda far: (far * (1 + 1e-9) + slack) * (1 + 2e-9)
        i = j = far = None
        for starts, means, residual in self.levels or [(np.zeros(1, np.int64), *means_and_residual(self.entries, np.zeros(1, np.int64)))]:
            own, rest = means_and_residual(x, starts)
            if i is None:  # the coarsest bound of all entries, and the distance of the entry that it puts first
                low = (rest[:, None] - residual[None]) ** 2
                for b in range(own.shape[1]):
                    low += (own[:, b : b + 1] - means[None, :, b]) ** 2
                far = measure(np.arange(n), low.argmin(axis=1)).astype(float)
                i, j = np.nonzero(low <= limit(far)[:, None])
            else:
                low = (rest[i] - residual[j]) ** 2
                for b in range(own.shape[1]):
                    low += (own[i, b] - means[j, b]) ** 2
                bound = np.full((n, k), np.inf)
                bound[i, j] = low
                far = np.minimum(far, measure(np.arange(n), bound.argmin(axis=1)).astype(float))
                stay = low <= limit(far)[i]
                i, j = i[stay], j[stay]
        # The first of equal distances has the smaller index.
        exact = np.full((n, k), np.iinfo(np.int64).max if small else 1 << 300, np.int64 if small else object)
        exact[i, j] = measure(i, j)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(n), best], np.bincount(i, minlength=n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def rows_of_integers(scale: float):
    """(vec_id, v): usable rows as integers."""

    def run(batches):
        for batch in _blocks(batches):
            ok, _ = integers(batch.column("embedding"), scale)
            kept = batch.filter(pa.array(ok))
            lists = kept.column("embedding")
            flat = np.floor(np.asarray(lists.flatten().cast(pa.float64())) * scale).astype(np.int64)
            offsets = np.asarray(lists.offsets, np.int64)
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat))], ["vec_id", "v"])

    return run


def sums_by_entry(books: Codebooks):
    """Per task: the sum of the components, and the number, of the parts assigned to each entry."""

    def run(batches):
        parts, width = [Part(p) for p in books.entries], books.width
        count = [np.zeros(len(p), np.int64) for p in books.entries]
        total = [np.zeros((len(p), width), object) for p in books.entries]
        for batch in _blocks(batches):
            _, v = integers(batch.column("embedding"), books.scale, width * len(parts))
            if not len(v):
                continue
            wide = int(np.abs(v).max(initial=0)) >= 1 << 40
            for p, part in enumerate(parts):
                x = v[:, p * width : (p + 1) * width]
                at, _, _ = part.nearest(x)
                count[p] += np.bincount(at, minlength=len(count[p]))
                step = np.zeros((len(count[p]), width), object if wide else np.int64)
                np.add.at(step, at, x.astype(object) if wide else x)
                total[p] += step
        rows = [(p, e, Decimal(int(s)), int(count[p][e]), w) for p in range(len(parts)) for e in np.flatnonzero(count[p]).tolist() for w, s in enumerate(total[p][e].tolist())]
        if rows:
            p, e, s, n, w = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(w, pa.int32()), pa.array(s, pa.decimal128(38, 0)), pa.array(n, pa.int64())], ["part", "entry", "place", "total", "n"])

    return run


def codes_of(books: Codebooks):
    """(vec_id, label, code, error, measured) of usable rows: code has a byte per part, measured counts the distances taken."""

    def run(batches):
        parts, width = [Part(p) for p in books.entries], books.width
        for batch in _blocks(batches):
            ok, v = integers(batch.column("embedding"), books.scale, width * len(parts))
            kept, n = batch.filter(pa.array(ok)), len(v)
            code, error, measured = np.zeros((n, len(parts)), np.uint8), np.zeros(n, object), np.zeros(n, np.int64)
            for p, part in enumerate(parts if n else []):
                code[:, p], far, took = part.nearest(v[:, p * width : (p + 1) * width])
                error, measured = error + far.astype(object), measured + took
            if n and max(error) >= 1 << 63:
                raise OverflowError("an error is beyond a long")
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error.astype(np.int64)), pa.array(measured)], ["vec_id", "label", "code", "error", "measured"])

    return run


def _read(vectors: DataFrame) -> DataFrame:
    bound_batches(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *(["label"] if "label" in vectors.columns else []))


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> Codebooks:
    """The codebooks of ``vectors`` (vec_id, embedding) after so many rounds over all rows.

    An entry starts as the part of a row: those with the ``entries`` smallest vec_ids, in order; of one vec_id the smaller vector is
    first, null ids come last, and fewer rows give fewer entries.  A round assigns every part to its nearest entry and
    replaces entries by the floor of their parts' mean; an entry that nothing is assigned to stays.  Vectors are padded with
    zeros to the next multiple of ``parts`` that holds the longest.  No usable row gives codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte per part: 1 to 256 entries")
    v = _read(vectors)
    ints = v.select("vec_id", "embedding").mapInArrow(rows_of_integers(scale), "vec_id long, v array<long>")
    longest = ints.agg(F.max(F.size("v"))).first()[0]
    head = [r.v for r in ints.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not head:
        return Codebooks(((),) * parts, scale)
    width = -(-longest // parts)
    rows = [x + [0] * (width * parts - len(x)) for x in head]
    books = Codebooks(tuple(tuple(tuple(x[p * width : (p + 1) * width]) for x in rows) for p in range(parts)), scale)
    for _ in range(rounds if width else 0):
        found = v.select("embedding").mapInArrow(tidy(sums_by_entry(books)), "part int, entry int, place int, total decimal(38,0), n long")
        new = [[list(e) for e in part] for part in books.entries]
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r.part][r.entry][r.place] = int(r.total) // r.n
        books = Codebooks(tuple(tuple(tuple(e) for e in part) for part in new), scale)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code binary, error, measured) of every usable row of ``vectors`` (vec_id, embedding, label); others go.

    A row longer than the codebooks raises; without a label column the label is null.
    """
    v = _read(vectors)
    v = v if "label" in v.columns else v.withColumn("label", F.lit(None).cast("int"))
    schema = f"vec_id long, label {v.schema['label'].dataType.simpleString()}, code binary, error long, measured long"
    return v.mapInArrow(tidy(codes_of(books)), schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``embedding``: the vectors that the codes stand for, in the scale of the originals."""

    def run(batches):
        table = [np.array(p, float).reshape(len(p), books.width) / books.scale for p in books.entries]
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, books.parts)
            x = np.hstack([t[code[:, p]] for p, t in enumerate(table)]) if batch.num_rows else np.zeros((0, 0))
            offsets = pa.array(np.arange(batch.num_rows + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [*batch.schema.names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{fields}, embedding array<double>")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """(vec_id, code, error, label_error, measured, codebooks_sha256) of every usable row, by codebooks fitted to all of them.

    Uses vec_id, embedding and label; other columns are ignored.  Rows whose vector is null or holds a null or non-finite
    component go; a vec_id that repeats, or is null, is a row each time.  label_error sums the errors of equal labels, null
    labels together.  An empty table gives no rows.
    """
    books = fit(vectors, parts, entries, rounds, scale)
    codes = materialize(encode(vectors, books))
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", "measured", F.lit(books.digest()).alias("codebooks_sha256"))


def sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same in DuckDB, entry by entry; lengths must be a multiple of ``parts``."""
    nearest = "SELECT r, p, arg_min(e, struct_pack(d, e)) AS e, min(d) AS d FROM (SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{i} b ON b.p = x.p) GROUP BY r, p"
    steps = [
        f"k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"x AS (SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM k, range({parts}) t(p))",
        f"b0 AS (SELECT p, r - 1 AS e, v FROM x WHERE r <= {entries})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i=i)})")
        steps.append(f"u{i} AS (SELECT a.p, a.e, unnest(x.v) AS y, generate_subscripts(x.v, 1) AS q FROM a{i} a JOIN x ON x.r = a.r AND x.p = a.p)")
        steps.append(f"m{i} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY q) AS v FROM (SELECT p, e, q, CAST(sum(y) AS BIGINT) AS t, count(*) AS n FROM u{i} GROUP BY p, e, q) GROUP BY p, e)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)")
    steps += [
        f"f AS ({nearest.format(i=rounds)})",
        "c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c ON c.r = k.r, h"
