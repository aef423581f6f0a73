"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise
interactions in time linear in a text's features.  Features are computed in the tasks
for whole texts; the machine is fitted with numpy on a bounded sample of labelled rows, and
its margins are calibrated on halves that it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import bound_batches, crc_held_out, hash_words, slices, split_words, tidy

WORD_BUCKETS = 1 << 15
FACTORS = 8
#: Most labelled rows that the machine is fitted on.
SAMPLE_ROWS = 6000
RATIO_EDGES = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
SIZE_EDGES = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536])
LENGTH_EDGES = np.array([1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 16, 24])
#: Name and bin edges of each structure statistic; the last is metadata.
STRUCTURE = [
    ("upper", RATIO_EDGES), ("digit", RATIO_EDGES), ("space", RATIO_EDGES), ("plain_punctuation", RATIO_EDGES), ("symbol", RATIO_EDGES), ("non_ascii", RATIO_EDGES),
    ("bar", RATIO_EDGES), ("distinct_words", RATIO_EDGES), ("commonest_word", RATIO_EDGES), ("words_ending_in_symbol", RATIO_EDGES), ("repeated_lines", RATIO_EDGES), ("adjacent_repeats", RATIO_EDGES),
    ("words", SIZE_EDGES), ("lines", SIZE_EDGES), ("word_length", LENGTH_EDGES), ("words_per_line", SIZE_EDGES), ("declared_chars", SIZE_EDGES),
]
_WIDTH = max(len(e) for _, e in STRUCTURE) + 1
DIMENSION = WORD_BUCKETS + _WIDTH * len(STRUCTURE)

_CLASS = np.full(256, 7, np.uint8)  # letters and other
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("0") : ord("9") + 1] = 1
_CLASS[[32, 9, 10, 11, 12, 13]] = 2
_CLASS[[ord(c) for c in ".,;:'\"!?-()"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 4
_CLASS[128:] = 5
_CLASS[ord("|")] = 6


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), sorted by row."""
    n_rows = batch.num_rows
    texts = batch.column("text").cast(pa.large_string())
    texts = pc.fill_null(texts, "").take(pa.array(range(n_rows), pa.int64()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: n_rows + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    size = np.diff(offsets)
    chars = np.bincount(np.repeat(np.arange(n_rows) * 8, size) + _CLASS[raw], minlength=8 * n_rows).reshape(n_rows, 8)

    codes, bounds, words = split_words(texts, raw=True)
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    n = np.maximum(np.diff(bounds), 1)
    length = np.fromiter(map(len, words), np.int64, len(words))
    odd_end = np.fromiter((len(w) > 0 and (_CLASS[w[-1]] in (4, 6) or w[-2:] == b"!!") for w in words), bool, len(words))
    bucket = (hash_words(words) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    per_row = lambda x: np.bincount(row, x, n_rows)
    key, count = np.unique(row * WORD_BUCKETS + (bucket[codes] if len(codes) else codes), return_counts=True)
    owner, word = key // WORD_BUCKETS, key % WORD_BUCKETS
    distinct = np.bincount(owner, minlength=n_rows)
    top = np.zeros(n_rows, np.int64)
    np.maximum.at(top, owner, count)

    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])

    lines = pc.split_pattern(texts, "\n")
    line_row = np.repeat(np.arange(n_rows), np.diff(np.asarray(lines.offsets, np.int64)))
    line_code = np.asarray(lines.flatten().dictionary_encode().indices, np.int64)
    n_lines = np.bincount(line_row, minlength=n_rows)
    own_lines = np.bincount(np.unique(line_row * (len(line_code) + 1) + line_code) // (len(line_code) + 1), minlength=n_rows)

    ratio = chars / np.maximum(size, 1)[:, None]
    declared = np.asarray(pc.fill_null(batch.column("n_chars").cast(pa.int64()), -1)) if "n_chars" in batch.schema.names else np.full(n_rows, -1)
    stats = [
        ratio[:, 0], ratio[:, 1], ratio[:, 2], ratio[:, 3], ratio[:, 4], ratio[:, 5], ratio[:, 6] * 4,
        distinct / n, top / n, per_row(odd_end[codes].astype(float) if len(codes) else codes) / n, 1 - own_lines / np.maximum(n_lines, 1), per_row(again.astype(float)) / n,
        np.diff(bounds), n_lines, per_row(length[codes].astype(float) if len(codes) else codes) / n, n / np.maximum(n_lines, 1), declared,
    ]
    structure = np.stack([WORD_BUCKETS + i * _WIDTH + np.searchsorted(edges, x, "right") for i, ((_, edges), x) in enumerate(zip(STRUCTURE, stats, strict=True))], axis=1)
    rows = np.concatenate([owner, np.repeat(np.arange(n_rows), len(STRUCTURE))])
    ids = np.concatenate([word, structure.ravel()])
    values = np.concatenate([1 / np.sqrt(distinct[owner]), np.full(structure.size, 0.5)])
    order = np.argsort(rows, kind="stable")
    return rows[order], ids[order], values[order].astype(np.float32)


@dataclass
class Machine:
    """``slope`` and ``shift`` turn a margin into the log odds of label 1."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
        first = np.searchsorted(row, np.arange(n_rows))
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, first, axis=0)
        q = np.add.reduceat((vx * vx).sum(axis=1), first)
        return self.w0 + np.add.reduceat(self.w[ids] * x, first) + 0.5 * ((s * s).sum(axis=1) - q)


def fit(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss with both labels of equal weight, Adagrad over mini-batches; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    weight = np.where(y > 0.5, 0.5 / max(share, 0.02), 0.5 / max(1 - share, 0.02)).astype(np.float32)
    m = Machine(0.0, np.zeros(DIMENSION, np.float32), rng.normal(0, 0.01, (DIMENSION, FACTORS)).astype(np.float32))
    gw, gv = np.full(DIMENSION, 1e-4, np.float32), np.full((DIMENSION, FACTORS), 1e-4, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            ids, x = np.concatenate([rows[i] for i in part]), np.concatenate([values[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            first = np.searchsorted(row, np.arange(len(part)))
            error = (1 / (1 + np.exp(-m.margin(row, ids, x, len(part)))) - y[part]).astype(np.float32) * weight[part] / len(part)
            vx = m.v[ids] * x[:, None]
            s = np.add.reduceat(vx, first, axis=0)
            u, inv = np.unique(ids, return_inverse=True)
            dw, dv = np.zeros(len(u), np.float32), np.zeros((len(u), FACTORS), np.float32)
            e = error[row] * x
            np.add.at(dw, inv, e)
            np.add.at(dv, inv, e[:, None] * (s[row] - vx))
            dw += decay * m.w[u]
            dv += decay * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= rate * dv / np.sqrt(gv[u])
            m.w0 -= rate * float(error.sum())
    return m


def likelihood(margin: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40)))


def calibrate(margin: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> tuple[float, float]:
    """Slope and shift of the logistic fit of labels to margins of rows that the machine did not see.

    The fit weighs both labels alike, this gives their shares back.  A little ridge keeps slopes finite where the margins part the labels.
    """
    beta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], axis=1)
    prior = np.array([1.0, 0.0])
    for _ in range(steps):
        p = likelihood(x @ beta)
        slope = x.T @ (p - y) + ridge * len(y) * (beta - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(2)
        beta = beta - np.linalg.solve(curve, slope)
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit_calibrated(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> Machine:
    """A machine of all rows; each half of them, seen by a machine of the other half, calibrates it.  Under 40 rows of either label nothing is calibrated."""
    machine = fit(rows, values, y)
    if min((y > 0.5).sum(), (y <= 0.5).sum()) < 40:
        return machine
    margin, half = np.zeros(len(y)), np.arange(len(y)) % 2
    for side in (0, 1):
        seen, unseen = np.flatnonzero(half != side), np.flatnonzero(half == side)
        part = fit([rows[i] for i in seen], [values[i] for i in seen], y[seen])
        row = np.repeat(np.arange(len(unseen)), [len(rows[i]) for i in unseen])
        margin[unseen] = part.margin(row, np.concatenate([rows[i] for i in unseen]), np.concatenate([values[i] for i in unseen]), len(unseen))
    machine.slope, machine.shift = calibrate(margin, y)
    return machine


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            row, ids, x = features(batch)
            bounds = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(x, pa.float32()))], ["quality", "ids", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on at most ``sample_rows`` labelled ids, those with the smallest hashes, and their whole texts."""
    bound_batches(docs.sparkSession)
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample_rows)
    ids = [(r.doc_id, r.quality) for r in sample.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).collect()]
    picked = docs.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")), "doc_id")
    wide = [c for c in ("text", "n_chars") if c in docs.columns]
    got = picked.select("quality", *wide).mapInArrow(tidy(_extract), "quality int, ids array<int>, x array<float>").toArrow()
    # Tasks may end in any order; the fit does not depend on it.
    rows, xs, y = [np.asarray(v.values) for v in got.column("ids")], [np.asarray(v.values) for v in got.column("x")], np.asarray(got.column("quality"), np.float32)
    order = sorted(range(len(y)), key=lambda i: (float(y[i]), rows[i].tobytes()))
    return fit_calibrated([rows[i] for i in order], [xs[i] for i in order], y[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with a column ``score``: likelihood of label 1 from the whole text and n_chars alone."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    carried = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                m: Machine = shared.value
                margin = m.margin(*features(batch), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(likelihood(margin, m.slope, m.shift), pa.float64())], [*carried, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.select(*carried).mapInArrow(tidy(run), StructType([*(docs.schema[c] for c in carried), StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text, n_chars if there is one).

    Learns only from labels of ids whose crc32 as text leaves a remainder by ``modulus`` (the others, and a null
    id, are held out).  Null, empty and blank texts have structure features only and get a score like any
    other; repeated rows get the same score; without labels every score is about 0.5.
    """
    wide = [c for c in ("n_chars",) if c in docs.columns]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *wide)
    held = crc_held_out("doc_id", modulus, 0)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null").where(~held)
    scored = score(docs.withColumn("held_out", held), train(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
