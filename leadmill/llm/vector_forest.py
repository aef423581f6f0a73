"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree splits by the projection on a random direction at the median, level after level.
Rows close to a split go to both sides, so a near pair is parted only if it lies across
the split by more than the overlap; several trees make that unlikely in all of them at
once.  Medians come from a bounded sample of each label's rows, in a task per label; every row is put
in its leaves.  Inside a leaf all pairs are compared in double precision.  A pair is counted in the
first leaf that both rows share and nowhere else, so counts are exact without listing
pairs; of a leaf's links a spanning forest is kept, which joins what the links join.

A node whose rows lie so close to every split tried that splitting would not lessen the pairs is a leaf.  Where such a leaf is
large, its tight groups have a representative: rows within half the angle of it are linked with one another, so they are
counted, not compared, and only rows further out meet them.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import materialize, tidy
from leadmill.llm.graph import components

TREES = 4
LEAF_ROWS = 512
#: About the most vectors, and bytes of them, that one label's medians are taken from, and the fewest a median is taken from.
SAMPLE_ROWS, SAMPLE_BYTES, LEAST_MEDIAN = 20_000, 32 << 20, 24
#: Leaves above this many rows, or bytes, are compared in pairs of slices; a label's rows are put in their leaves by a task per so many.
SLICE_ROWS, SLICE_BYTES, PART_ROWS = 16_384, 16 << 20, 100_000
#: Share of a node's rows in both of its halves from which on splitting makes more pairs than it parts, 2 ((1 + s) / 2)^2 = 1; the
#: directions tried before a node becomes a leaf; the fewest rows of a tight group with a representative.
MOST_SPILL, DIRECTIONS, GROUP_ROWS = math.sqrt(2) - 1, 4, 4096
SEED = 11


@functools.lru_cache(maxsize=4096)
def direction(tree: int, level: int, dimension: int, pick: int = 0) -> np.ndarray:
    """The unit vectors that a level of a tree splits by, the same for all labels; the first but where it parts badly."""
    d = np.random.default_rng((SEED, tree, level, pick) if pick else (SEED, tree, level)).normal(size=dimension)
    return d / np.linalg.norm(d)


@dataclass
class Forest:
    """The trees of one label: per tree, level and node the direction and the median, or None for a leaf."""

    dimension: int
    depth: int
    spill: float
    trees: int
    splits: dict[tuple[int, int, int], tuple[int, float] | None] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, spill: float, trees: int, leaf_rows: int) -> Forest:
        """``x``: unit rows of the sample; ``rows``: how many rows the label has."""
        out = cls(x.shape[1], depth_of(rows, leaf_rows), spill, trees)
        for t in range(trees):
            nodes = {1: np.arange(len(x))}
            for level in range(out.depth):
                below = {}
                for node, members in nodes.items():
                    if len(members) >= LEAST_MEDIAN:
                        split = out.splits[t, level, node] = out.best_split(x[members], t, level)
                        if split is not None:
                            low = x[members] @ direction(t, level, out.dimension, split[0]) <= split[1]
                            below[2 * node], below[2 * node + 1] = members[low], members[~low]
                nodes = below
            if out.splits.get((t, 0, 1), 0) is None:
                break
        return out

    def best_split(self, x: np.ndarray, tree: int, level: int) -> tuple[int, float] | None:
        """The first direction whose median parts enough of the rows; None if none does."""
        for pick in range(DIRECTIONS):
            p = x @ direction(tree, level, self.dimension, pick)
            m = float(np.median(p))
            if np.mean(np.abs(p - m) <= self.spill) < MOST_SPILL:
                return pick, m
        return None

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf id) of unit rows ``x`` over all trees."""
        whole = next((t for t in range(self.trees) if self.splits.get((t, 0, 1), 0) is None), None)
        if whole is not None:  # one leaf has every pair
            return np.arange(len(x)), np.full(len(x), self.trees + whole)
        rows_out, leaf_out = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                known, at = np.unique(node, return_inverse=True)
                # Below the sample's reach a node splits at 0.
                split = [self.splits.get((t, level, int(n)), (0, 0.0)) for n in known]
                pick, cut = np.array([-1 if c is None else c[0] for c in split])[at], np.array([0.0 if c is None else c[1] for c in split])[at]
                p = np.zeros(len(row))
                for d in np.unique(pick[pick >= 0]).tolist():
                    mine = pick == d
                    p[mine] = (x @ direction(t, level, self.dimension, d))[row[mine]]
                done = pick < 0  # a leaf is a leaf on every level below; its left child has its rows
                low, high = done | (p <= cut + self.spill), ~done & (p > cut - self.spill)
                for n in known[[c is None for c in split]].tolist():
                    self.splits[t, level + 1, 2 * n] = None
                row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
            rows_out.append(row)
            leaf_out.append(node * self.trees + t)
            if not self.depth:
                break
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def depth_of(rows: int, leaf_rows: int) -> int:
    return max(0, math.ceil(math.log2(rows / leaf_rows))) if rows > leaf_rows else 0


def _matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    x = np.asarray(vectors.flatten().cast(pa.float64())).reshape(-1, dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_label(spill: float, trees: int, leaf_rows: int):
    """The forest of one label from its sample, a bounded number of rows."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("embedding").combine_chunks(), int(table.column("dim")[0].as_py()))
        forest = Forest.fit(x, int(table.column("n")[0].as_py()), spill, trees, leaf_rows)
        return pa.table({"grp": table.column("grp")[:1], "model": pa.array([pickle.dumps(forest)], pa.binary())})

    return run


def place(trees: int):
    """Rows sorted by label, its model before its vectors, to one row per vector and leaf, with all leaves of the vector in ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, forest = None, None
        for batch in batches:
            grp, models = np.asarray(batch.column("grp")), batch.column("model")
            cuts = np.flatnonzero(np.diff(grp)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
                if grp[a] != now:
                    now, forest = grp[a], None
                while a < b and models[a].is_valid:
                    forest, a = pickle.loads(models[a].as_py()), a + 1
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                dim = int(part.column("dim")[0].as_py())
                row, leaf = (forest or Forest(dim, 0, 0.0, trees)).leaves(_matrix(part.column("embedding"), dim))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                cells = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(leaf)).take(pa.array(row))
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("h1", "grp", "dim", "copies", "embedding")), cells, pa.array(leaf)], ["h1", "grp", "dim", "copies", "embedding", "cells", "leaf"])

    return run


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (the smallest member of each row's component) once rows i and j are joined too."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]


def compare_leaf(threshold: float):
    """Links of one leaf, or of two slices of one: per row how many vectors it is linked with, and the first row of its component here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("embedding").combine_chunks(), int(table.column("dim")[0].as_py()))
        h1, copies = np.asarray(table.column("h1")), np.asarray(table.column("copies"))
        leaf = int(table.column("leaf")[0].as_py())
        lists = table.column("cells").to_pylist()
        side, lo, hi = np.asarray(table.column("side")), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        wide = max(map(len, lists))
        cells = np.array([c + [-1] * (wide - len(c)) for c in lists], np.int64)
        count, label = np.zeros(len(h1), np.int64), np.arange(len(h1))
        first, second = (np.flatnonzero(side == lo), np.flatnonzero(side == hi)) if lo != hi else (np.arange(len(h1)), np.arange(len(h1)))
        for at in range(0, len(first), 512):
            block = first[at : at + 512]
            i, j = np.nonzero(x[block] @ x[second].T >= threshold)
            i, j = block[i], second[j]
            keep = i < j if lo == hi else i != j
            i, j = i[keep], j[keep]
            label = unite(label, i, j)
            for b in range(0, len(i), 20_000):
                p, q = i[b : b + 20_000], j[b : b + 20_000]
                both = np.zeros((len(p), wide), bool)
                for c in range(wide):
                    both |= (cells[p] == cells[q][:, c : c + 1]) & (cells[p] >= 0)
                earliest = np.where(both, cells[p], np.iinfo(np.int64).max).min(axis=1)
                mine = earliest == leaf
                np.add.at(count, p[mine], copies[q[mine]])
                np.add.at(count, q[mine], copies[p[mine]])
        some = (label != np.arange(len(h1))) | (count > 0)
        return pa.table({"h1": pa.array(h1[some]), "links": pa.array(count[some]), "under": pa.array(h1[label][some])})

    return run


def forest_leaves(classes: DataFrame, threshold: float, trees: int, leaf_rows: int) -> DataFrame:
    """``classes`` (h1, grp, dim, copies, embedding) in all their leaves.

    A label's sample is about ``SAMPLE_ROWS`` rows by a hash and fits in one task; a large label's rows
    are placed by several tasks, each with a copy of the label's model.
    """
    sizes = classes.groupBy("grp", "dim").agg(F.count("*").alias("n"))
    deep = materialize(sizes.where(F.col("n") > leaf_rows).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")))
    spill = F.lit(math.sqrt(2 - 2 * threshold)) / F.sqrt("dim")
    most = F.least(F.lit(SAMPLE_ROWS), F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))
    chance = F.pmod(F.xxhash64("h1", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = classes.join(deep.drop("dim"), "grp").where(chance < most / F.col("n")).select("grp", "dim", "n", spill.alias("spill"), "embedding")
    models = sample.groupBy("grp").applyInArrow(lambda t: fit_label(t.column("spill")[0].as_py(), trees, leaf_rows)(t), "grp long, model binary")
    models = models.join(deep.select("grp", "parts"), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "model")
    rows = classes.join(deep.select("grp", "parts"), "grp", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("h1", F.lit(3)), F.col("parts")), F.lit(0)).cast("int"))
    both = rows.select("grp", "part", "h1", "dim", "copies", "embedding").unionByName(models, allowMissingColumns=True)
    both = both.repartition("grp", "part").sortWithinPartitions("grp", F.col("model").isNull(), "h1")
    return both.mapInArrow(tidy(place(trees)), "h1 long, grp long, dim int, copies long, embedding array<double>, cells array<long>, leaf long")


def close_to(bound: float):
    """Rows whose cosine with their representative (``centre``) is over ``bound``."""

    def run(batches):
        for batch in batches:
            for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                part = batch.filter(pa.array(np.asarray(batch.column("dim")) == dim))
                near = np.einsum("ij,ij->i", _matrix(part.column("embedding"), dim), _matrix(part.column("centre"), dim)) >= bound
                kept = part.filter(pa.array(near))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("h1", "copies", "unit", "under")], ["h1", "copies", "unit", "under"])

    return run


def tight_groups(placed: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """(h1, unit, links, under) of the rows of tight groups in ``large`` leaves (grp, leaf).

    A group are rows with all leaves in common that lie within half the threshold's angle of one of them, ``under``: any two of them are
    linked, by more than rounding could change.  ``links`` counts the group's other vectors.
    """
    first = placed.where(F.col("leaf") == F.col("cells")[0]).join(large, ["grp", "leaf"]).select("h1", "dim", "copies", "embedding", F.xxhash64("grp", "cells").alias("unit"))
    centres = first.groupBy("unit").agg(F.count("*").alias("n"), F.min("h1").alias("under"), F.min_by("embedding", "h1").alias("centre")).where(F.col("n") >= GROUP_ROWS).drop("n")
    bound = math.cos(math.acos(threshold) / 2) + 1e-9
    core = materialize(first.join(centres, "unit").mapInArrow(tidy(close_to(bound)), "h1 long, copies long, unit long, under long"))
    sizes = core.groupBy("unit").agg(F.count("*").alias("n"), F.sum("copies").alias("total")).where(F.col("n") >= GROUP_ROWS).drop("n")
    return materialize(core.join(sizes, "unit").select("h1", "unit", (F.col("total") - F.col("copies")).alias("links"), "under"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Rows with equal labels are linked if their cosine in double precision is at least ``threshold``.  Vectors
    that are null, empty, all zero or hold a null or non-finite component, and rows with a null label, link with
    nothing.  Equal vectors of one label are one class with a number of copies; vectors of different
    lengths never meet.  A vec_id that repeats has a row each time; component_id is the smallest vec_id of
    the component, a null one only where there is no other.  An empty table gives no rows.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda e: e != 0), F.lit(False))
    keyed = v.withColumns({"usable": usable, "h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64("embedding", F.lit(1), "label"), "dim": F.size("embedding")})
    good = keyed.where("usable")
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"))
    classes = materialize(classes.withColumn("grp", F.xxhash64("label", "dim")).drop("label"))

    placed = materialize(forest_leaves(classes, threshold, trees, leaf_rows))
    most = F.least(F.lit(SLICE_ROWS), F.lit(SLICE_BYTES) / (8 * F.any_value("dim"))).alias("most")
    sizes = materialize(placed.groupBy("grp", "leaf").agg(F.count("*").alias("members"), most).where("members > 1"))
    large = sizes.where("members > most").select("grp", "leaf")
    groups = None if large.isEmpty() else tight_groups(placed, large, threshold)
    # A group's rows have slices of their own, which never meet each other.
    rows = placed.withColumn("unit", F.lit(0).cast("long")) if groups is None else placed.join(groups.select("h1", F.col("unit").alias("_u")), "h1", "left").withColumn("unit", F.coalesce("_u", F.lit(0))).drop("_u")
    rows = rows.join(sizes, ["grp", "leaf"])
    in_slices = rows.where("members > most")
    units = in_slices.groupBy("grp", "leaf", "unit").agg(F.ceil(F.count("*") / F.any_value("most")).cast("int").alias("parts"))
    sides = units.select("grp", "leaf", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("no"))
    sides = sides.groupBy("grp", "leaf").agg(F.collect_list(F.struct("unit", F.xxhash64("unit", "no").alias("side"))).alias("sides"))
    cut = in_slices.join(units, ["grp", "leaf", "unit"]).withColumn("side", F.xxhash64("unit", F.pmod(F.xxhash64("h1", F.lit(7)), F.col("parts")).cast("int"))).join(sides, ["grp", "leaf"])
    cut = cut.withColumn("other", F.explode(F.transform(F.filter("sides", lambda o: (o["unit"] != F.col("unit")) | (o["unit"] == 0)), lambda o: o["side"])))
    columns = ["h1", "grp", "dim", "copies", "embedding", "cells", "leaf", "side", "lo", "hi"]
    cut = cut.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).select(*columns)
    zero = F.lit(0).cast("long")
    small = rows.where("members <= most").withColumns({"side": zero, "lo": zero, "hi": zero}).select(*columns)
    found = small.unionByName(cut).groupBy("grp", "leaf", "lo", "hi").applyInArrow(compare_leaf(threshold), "h1 long, links long, under long")
    found = materialize(found if groups is None else found.unionByName(groups.select("h1", "links", "under")))

    links = found.groupBy("h1").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("h1").alias("a"), F.col("under").alias("b")))
    tops = classes.select("h1", "h2", "rep").join(label, F.col("h1") == F.col("node")).select("h1", "h2", "rep", "label")
    tops = tops.join(tops.groupBy("label").agg(F.min("rep").alias("top")), "label").select("h1", "top")
    merged = classes.select("h1", "h2", "rep", "copies").join(links, "h1", "left").join(tops, "h1", "left")
    merged = merged.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("top", "rep").alias("component"))
    out = keyed.select("vec_id", "usable", "h1", "h2").join(merged.withColumn("usable", F.lit(True)), ["usable", "h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
