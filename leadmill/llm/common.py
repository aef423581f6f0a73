"""Helpers shared by the corpus operators: scratch tables, word splitting, hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
#: Most bytes of an Arrow batch between the JVM and Python, whatever the rows' size.
BATCH_BYTES = 8 << 20
_ARROW_BYTES, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches end at ``most`` bytes from now on, so that rows of any size need the same memory; the user's own setting stays."""
    if spark.conf.get(_ARROW_BYTES) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_BYTES, str(most))


def release_memory() -> None:
    """Give memory that nothing uses back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` (batches to batches), releasing its worker's memory when a task ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only where it is
    unset in a local session (as in tests) a temporary folder takes its place.
    """
    bound_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='leadmill-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leadmill-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The table outlives lost executors and cuts the lineage.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return out


_MADE: ContextVar[list[str] | None] = ContextVar("tables of this run", default=None)


class RunTables:
    """The tables that ``materialize`` writes inside ``with``, and no other run's."""

    def __enter__(self) -> RunTables:
        self.made: list[str] = []
        self._token = _MADE.set(self.made)
        return self

    def __exit__(self, *_) -> None:
        _MADE.reset(self._token)

    def keep(self, df: DataFrame) -> None:
        """Delete all of them but the one behind ``df``, which needs none of the others."""
        for path in [p for p in self.made if p != df._scratch_path]:
            _delete(df.sparkSession, path)
            self.made.remove(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most ``limit`` bytes of ``column``.

    One row is never cut: a text over the limit is a part of its own.
    """
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool = False, raw: bool = False, arrow: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (code per word, bounds per text, distinct words, as bytes if ``raw``, as an Arrow array if ``arrow``)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    if lower:
        flat = pc.ascii_lower(flat)
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    words = coded.dictionary.cast(pa.large_binary() if raw else pa.string() if arrow else pa.large_string())
    words = words if arrow else words.to_numpy(zero_copy_only=False).tolist()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        codes, bounds = codes[full], kept[bounds]
    return codes, bounds, words


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two hash arrays."""
    return mix(a * _LEFT + b * _RIGHT + np.uint64(1))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive elements; shorter input gives none.

    Doubles the width, so it takes log2(k) passes.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, span, width = None, 0, h, 1
    while True:
        if k & width:
            left = len(h) - (done + width) + 1
            out = span if out is None else pair_hash(out[:left], span[done : done + left])
            done += width
        if done == k:
            return out
        span = pair_hash(span[:-width], span[width:])
        width *= 2


def crc_held_out(column: str, modulus: int, remainder: int):
    """Column: crc32 of the id as text leaves ``remainder`` (a null id counts as crc 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % modulus == remainder


#: Bits of a membership table: 8 MB, whatever the number of members.
TABLE_BITS, _ROW_BITS = 1 << 26, 1 << 15


def slot(*columns) -> Column:
    """The bit of a membership table that a key has."""
    return F.pmod(F.xxhash64(*columns), F.lit(TABLE_BITS))


def membership(keys: DataFrame, *columns):
    """A broadcast bit table of fixed size with the bits of ``keys`` set.

    It lets scans leave out rows that a later join would drop; it may let others through, more
    as it fills, but never leaves a member out.
    """
    return bit_table(keys.select(slot(*columns).alias("s")))


def bit_table(at: DataFrame):
    """``membership`` for bits that are numbered already, in a column ``s``."""
    rows = at.groupBy((F.col("s") / _ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("s") % _ROW_BITS).alias("bits")).collect()
    table = np.zeros((TABLE_BITS // _ROW_BITS, _ROW_BITS // 8), np.uint8)
    for r in rows:
        table[r.row] = np.frombuffer(r.bits, np.uint8)
    return at.sparkSession.sparkContext.broadcast(table.ravel())


def members(batch: pa.RecordBatch, table: np.ndarray, column: str = "slot", inside: bool = True) -> pa.RecordBatch:
    """The rows of ``batch`` whose slot is set, or with ``inside`` false the others."""
    return batch.filter(pa.array(in_table(table, np.asarray(batch.column(column), np.int64)) == inside))


def in_table(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the numbered bits are set."""
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
