"""Document fingerprints by winnowing.

Every run of k code points has a rolling hash.  Of each window of w hashes in a row the smallest is kept, the rightmost of equal
ones, with its position.  So two texts that share w + k - 1 code points in a row share a print, and a print
stands for the same k code points in both; a window moves by one, so prints are at most w apart.

A text of few grams has a narrower window (an eighth of its grams), so that short texts have prints to compare.  What a
wider window keeps, a narrower one keeps too: two fingerprints of different windows are compared after the
finer one was winnowed again at its positions with the wider window.

``fingerprints`` gives hashes and positions of each document.  ``edited_and_next`` sets each document beside an edited copy of
itself and beside the next document: texts move once, compressed, to ranges of ids, in which a task streams them in order.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import bound_batches, mix, slices, tidy

#: Odd base of the rolling hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of a stored hash, grams for which a text has a window of one more, ranges of ids per shuffle partition, and ids sampled per range.
HASH_BITS, GRAMS_PER_WINDOW, RANGES, SAMPLED = 40, 8, 8, 20
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for texts of usual length."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 14)
        made = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 1 << 20:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each run of ``k`` code points; a shorter text, unless empty, is one run."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    up, down = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * down[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * up[: n - k + 1]) >> np.uint64(64 - HASH_BITS)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost of equal ones, ascending; fewer hashes are one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    at, low, done = np.arange(n, dtype=np.int32), hashes, 1
    while done < window:
        step = min(done, window - done)
        right = low[step:] <= low[:-step]
        at, low = np.where(right, at[step:], at[:-step]), np.where(right, low[step:], low[:-step])
        done += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))].astype(np.int64)


@dataclass(frozen=True)
class Fingerprint:
    """Prints of a text: hashes and positions, the window they were taken with and how many grams the text has."""

    hashes: np.ndarray
    positions: np.ndarray
    window: int
    grams: int

    def text(self) -> str:
        """Window and grams in hex, then per print its hash (10 hex digits) and the step from the print before (2 digits at least, after a point where more)."""
        steps = np.diff(self.positions, prepend=0).tolist()
        return f"{self.window:x}.{self.grams:x}." + "".join(f"{h:010x}{s:02x}" if s < 256 else f"{h:010x}.{s:x}." for h, s in zip(self.hashes.tolist(), steps, strict=True))

    def coarser(self, window: int) -> np.ndarray:
        """The hashes that a wider window keeps."""
        if window <= self.window:
            return self.hashes
        every = np.full(self.grams, _NEVER)
        every[self.positions] = self.hashes
        return every[winnow(every, window)]


def fingerprint_points(points: np.ndarray, k: int, window: int) -> Fingerprint:
    h = gram_hashes(points, k)
    own = min(window, 1 + len(h) // GRAMS_PER_WINDOW)
    at = winnow(h, own)
    return Fingerprint(h[at], at, own, len(h))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Shared share of both texts' distinct prints, taken with the wider of both windows; 1 for two empty texts, 0 beside one."""
    window = max(a.window, b.window)
    x, y = np.unique(a.coarser(window)), np.unique(b.coarser(window))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _prints(k: int, window: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                made = [fingerprint_points(code_points(t or ""), k, window) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(f.hashes) for f in made)])
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))  # noqa: B023, E731
                hashes = np.concatenate([f.hashes for f in made]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(hashes, pa.int64()), lists(np.concatenate([f.positions for f in made]), pa.int64()), pa.array([f.window for f in made], pa.int32()), pa.array([f.grams for f in made], pa.int64())], ["doc_id", "hashes", "positions", "window", "grams"])

    return run


def fingerprints(docs: DataFrame, k: int = 12, window: int = 40) -> DataFrame:
    """(doc_id, hashes, positions, window, grams) of every row of ``docs`` (doc_id, text); a null or empty text has no prints."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_prints(k, window)), "doc_id long, hashes array<long>, positions array<long>, window int, grams long")


#: A null doc_id is sent as this, before all others.
NOBODY = -(1 << 63)
SENT = "range long, guard boolean, doc long, mark long, z binary, size long"


def to_ranges(bounds: list[int], lowest: int):
    """Rows with the range of ids they belong to; the rows of a range's first id go to the range before too, as its guard, and the lowest id's to the last."""
    last = len(bounds)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    # Rows of one id are in the order of a hash of their text.
                    mark = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                    r = bisect.bisect_right(bounds, doc)
                    body = (doc, mark, pa.compress(raw, codec="zstd", asbytes=True), len(raw))
                    rows.append((r, False, *body))
                    if r and bounds[r - 1] == doc:
                        rows.append((r - 1, True, *body))
                    if doc == lowest:
                        rows.append((last, True, *body))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SENT.split(", ")])

    return run


@dataclass
class _Doc:
    doc: int
    text: str
    points: np.ndarray
    prints: Fingerprint


def pair_up(k: int, window: int, share: int):
    """Rows sorted by range, guards last, to one row per document with what it has in common with its edited text and with the next one."""

    def read(doc: int, z: bytes, size: int) -> _Doc:
        text = (pa.decompress(z, decompressed_size=size, codec="zstd", asbytes=True) if size else b"").decode("utf-8", "surrogatepass")
        points = code_points(text)
        return _Doc(doc, text, points, fingerprint_points(points, k, window))

    def judge(d: _Doc, after: _Doc) -> tuple:
        n = len(d.points)
        cut = n // share
        edited = d.text[: n - cut] + after.text[:cut]
        points = np.concatenate((d.points[: n - cut], after.points[:cut]))
        prints = fingerprint_points(points, k, window)
        return None if d.doc == NOBODY else d.doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), d.prints.text(), prints.text(), likeness(d.prints, prints), likeness(d.prints, after.prints)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, None, False
        for batch in batches:
            out, size = [], 0
            cols = [batch.column(c).to_pylist() for c in ("range", "guard", "doc", "z", "size")]
            for r, guard, doc, z, full in zip(*cols, strict=True):
                if r != now:
                    now, held, done = r, None, False
                if done or (guard and held is None):
                    continue  # one guard is enough, and a range without rows needs none
                d = read(doc, z, full)
                if held is not None:
                    out.append(judge(held, d))
                    size += len(held.points)
                held, done = d, guard
                if size > 1 << 20:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    return run


def edited_and_next(docs: DataFrame, k: int = 12, window: int = 40, share: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs`` (doc_id, text).

    The edited text is the document's with its last n_chars // ``share`` code points replaced by the first as many (or all) of
    the next document in ascending doc_id, after the last the first; a single document is its own next.  A null text is
    empty; null ids are the smallest; rows of one doc_id are in the order of a hash of their text, so equal ones are each other's next.  Other columns are
    ignored, and an empty table gives no rows.  A range holds the rows of its ids, so one id's rows are streamed by one task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc"), "text")
    # The bounds are ids of the table, picked from a sample as long as the number of ranges times a constant.
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, lowest = d.agg(F.count("*"), F.min("doc")).first()
    picked = np.sort(d.select("doc").sample(min(1.0, SAMPLED * n / max(1, total)), seed=7).toArrow()["doc"].to_numpy())
    bounds = [int(b) for b in np.unique(picked[:: max(1, len(picked) // n)]) if b > lowest]
    sent = d.mapInArrow(tidy(to_ranges(bounds, lowest)), SENT)
    sent = sent.repartition("range").sortWithinPartitions("range", "guard", "doc", "mark")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(tidy(pair_up(k, window, share)), schema)
