"""N-gram Jaccard join on the rarest shingles.

All sets are sorted by one order of shingles, rare ones first.  Two linked sets of n and m
shingles share a = t/(1+t) * (n+m) at least, and none of them comes before the first one that
they share: from there on, each of the two has a shingles or more.  So a shingle with r
shingles from it on (itself included) can be the first of a link only if the partner has
r * (1+t)/t - n shingles at most, and that is t * n or more for the first quarter of a set
alone (at t = 0.75).  These are the keys: whatever a set's size, linked sets share one
whose bounds hold on both sides, and no link is lost.

Which order it is decides the work and never the result.  It goes by a table of counts of
fixed size over all rows, so that a line, passage or licence that many texts have comes last
and is no key of a text that has enough of its own; rows that only such a line has in
common don't meet, however many there are.

Size bands are 1/t wide: a partner is in the same or the next band, so a shared key stands in
its row's own band and in the one below, and a pair is looked for in the band of its smaller set.
Pairs of a key whose bounds hold are compared by parity sketches of some bits a shingle before
anything else: each shingle toggles a bit, so their Hamming distance is at most the symmetric
difference of the sets, which is (1-t)/(1+t) * (n+m) at most for a link.  Sets that merely
share a rare shingle end here.  What is left falls into small groups, which are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import TABLE_BITS, bit_table, hash_words, in_table, materialize, members, membership, mix, pair_hash, slices, slot, split_words, tidy, window_hash
from leadmill.llm.graph import components

#: Every band's T is below it: no band's keys are left to chance.
EXACT = 1 << 62
CELL_SHINGLES = 2_000_000
CELL_MEMBERS = 4096
#: Pairs of a key that so many rows share are made by a join; beyond, its rows are compared in cells.
FEW = 64
#: A table of counts has 2 to the COUNT_BITS places (4 MB), in rows of COUNT_ROW.
COUNT_BITS, COUNT_ROW = 22, 1 << 13
INFO = "doc_id long, mark long, n_shingles long, h1 long, h2 long, keys array<long>, sketch binary"


def text_mark(text: Column) -> Column:
    """A hash that tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bands(num: int, den: int, upto: int = 1 << 40) -> list[tuple[int, int]]:
    """(smallest size, greatest symmetric difference of a linked pair whose smaller set is in it) per band."""
    out, low = [], 1
    while low < upto:
        high = low * den // num + 1
        top = high - 1
        out.append((low, (den - num) * (top + top * den // num) // (den + num)))
        low = high
    return out


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text is one shingle."""
    codes, bounds, words = split_words(texts, lower=True, raw=True)
    h = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    w = window_hash(h, width)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = e - s
        if n >= width:
            out.append(np.unique(w[s : e - width + 1]))
        elif n:
            out.append(window_hash(h[s:e], n) ^ np.uint64(n))
        else:
            out.append(h[:0])
    return out


def place(shingles: np.ndarray) -> np.ndarray:
    """Where a table of counts has a shingle."""
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_counts(width: int):
    """Texts to the rows of a table: how often they have a shingle of each place, 255 at the most a task; a few that span two texts count too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNT_BITS, np.int32)
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, _, words = split_words(batch.column("text"), lower=True, raw=True)
                at = np.sort(place(window_hash(hash_words(words)[codes], width) if len(codes) else np.zeros(0, np.uint64)).astype(np.int32))
                first = np.flatnonzero(np.diff(at, prepend=-1))
                table[at[first]] += np.diff(first, append=len(at)).astype(np.int32)
        rows = np.minimum(table, 255).astype(np.uint8).reshape(-1, COUNT_ROW)
        some = np.flatnonzero(rows.any(axis=1))
        for part in np.array_split(some, -(-len(some) // 64)) if len(some) else []:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([rows[i].tobytes() for i in part], pa.binary())], ["part", "counts"])

    return run


def add_counts(table: pa.Table) -> pa.Table:
    """One row of a table of counts, a byte a place: the logarithm to the base 2 of the tasks' sum in eighths."""
    total = np.zeros(COUNT_ROW, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.uint8)
    steps = np.minimum(np.log2(total + 1) * 8, 255).astype(np.uint8)
    return pa.table({"part": table.column("part").slice(0, 1), "steps": pa.array([steps.tobytes()], pa.binary())})


def frequencies(docs: DataFrame, width: int):
    """A broadcast table that tells how common a shingle is among the texts of ``docs``; of fixed size, so rare ones share their places."""
    counts = docs.select("text").mapInArrow(tidy(shingle_counts(width)), "part long, counts binary")
    table = np.zeros(((1 << COUNT_BITS) // COUNT_ROW, COUNT_ROW), np.uint8)
    for r in counts.groupBy("part").applyInArrow(add_counts, "part long, steps binary").collect():
        table[r.part] = np.frombuffer(r.steps, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(table.ravel())


def partner_bound(n, at, num: int, den: int):
    """The greatest set that one of ``n`` shingles can be linked with, if the first shingle that they share is its ``at``-th from 0 on."""
    return (num + den) * (n - at) // num - n


def rare_keys(shingles: np.ndarray, steps: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of one sorted set that can be the first of a link, rarest first; equally rare ones by their hash."""
    n = len(shingles)
    # Bounds fall with the place: those that allow a partner at all stand first.
    keys = int((partner_bound(n, np.arange(n), num, den) >= -(-num * n // den)).sum())
    return shingles[np.argsort(steps[place(shingles)], kind="stable")[:keys]]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def parity(shingles: np.ndarray) -> bytes:
    """A sketch of two to four bits a shingle, a power of 2 and 64 at the least; each shingle toggles one."""
    size = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    at = (mix(shingles + np.uint64(0x2545F491)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> int:
    """The sketch of the same set with ``size`` bytes."""
    x, now = int.from_bytes(sketch, "little"), len(sketch)
    while now > size:
        now //= 2
        x = (x >> 8 * now) ^ (x & ((1 << 8 * now) - 1))
    return x


def described(width: int, num: int, den: int, steps):
    """Texts to their sets' sizes, hashes, keys and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), width)
                h1 = [int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                h2 = [int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        batch.column("mark"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_signed(np.array(h1, np.uint64))),
                        pa.array(_signed(np.array(h2, np.uint64))),
                        pa.array([_signed(rare_keys(s, steps.value, num, den)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([parity(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "mark", "n_shingles", "h1", "h2", "keys", "sketch"],
                )

    return run


def key_slot(keys):
    """The bit of a table that a key has, for a column or an array: a key is a hash itself."""
    return F.pmod(keys, F.lit(TABLE_BITS)) if isinstance(keys, Column) else keys & (TABLE_BITS - 1)


def shared_keys(num: int, den: int, wanted):
    """Classes to those of their keys that the table ``wanted`` lets through, and whether the key may have a partner ``here``, in the class's own band, or ``below``.

    ``most`` is the partner's greatest size.
    """
    edges = bands(num, den)
    lows = np.array([low for low, _ in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            count = np.diff(np.asarray(keys.offsets)).astype(np.int64)
            flat = np.asarray(keys.flatten(), np.int64)
            row = np.repeat(np.arange(batch.num_rows), count)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            kept = in_table(wanted.value, key_slot(flat))
            flat, row, at = flat[kept], row[kept], at[kept]
            n, h1 = np.asarray(batch.column("n"))[row], np.asarray(batch.column("h1"))[row]
            most, home = partner_bound(n, at, num, den), np.searchsorted(lows, n, "right") - 1
            here, below = most >= lows[home], -(-num * n // den) < lows[home]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat, h1, n, most, home, here, below)], ["key", "h1", "n", "most", "band", "here", "below"])

    return run


def _nodes(h1, band) -> np.ndarray:
    return _signed(pair_hash(np.asarray(h1).view(np.uint64), np.asarray(band).astype(np.uint64)))


def sketched_pairs(num: int, den: int):
    """Pairs of classes to edges between their nodes in the pair's band, if their sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                size = min(len(x), len(y))
                near.append((folded(x, size) ^ folded(y, size)).bit_count() * (den + num) <= (den - num) * (n + m))
            kept = batch.filter(pa.array(near, pa.bool_()))
            ends = [pa.array(_nodes(kept.column(c), kept.column("band"))) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return run


def sketched_cell(num: int, den: int):
    """The rows of one key in one band (or of two slices of them) to a spanning forest of the pairs whose bounds and sketches allow a link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("h1", "ascending")]).combine_chunks()
        n, most, own, side = (np.asarray(table.column(c)) for c in ("n", "most", "own", "side"))
        node, two = _nodes(table.column("h1"), table.column("band")), table.column("lo")[0] != table.column("hi")[0]
        sketches = table.column("sketch").to_pylist()
        size = min(len(x) for x in sketches)
        sk = np.frombuffer(b"".join(folded(x, size).to_bytes(size, "little") for x in sketches), np.uint64).reshape(len(n), -1)
        label = np.arange(len(n))
        left, right = [], []
        for i in np.flatnonzero(own).tolist():
            js = np.arange(i + 1, int(np.searchsorted(n, most[i], "right")))
            js = js[(label[js] != label[i]) & (most[js] >= n[i])]
            if two:
                js = js[side[js] != side[i]]
            for at in range(0, len(js), 512):
                part = js[at : at + 512]
                far = np.bitwise_count(sk[part] ^ sk[i]).sum(axis=1, dtype=np.int64)
                for j in part[far * (den + num) <= (den - num) * (n[part] + n[i])].tolist():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        left.append(node[i])
                        right.append(node[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def near_pairs(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes of classes that share a key and whose bounds and sketches allow a link; of what a common key joins, a spanning forest."""
    shared = materialize(classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    wanted = bit_table(shared.select(key_slot(F.col("key")).alias("s")))
    # The table lets other keys through by chance; the join drops them.
    keyed = classes.select("h1", F.col("n_shingles").alias("n"), "keys").mapInArrow(tidy(shared_keys(num, den, wanted)), "key long, h1 long, n long, most long, band long, here boolean, below boolean")
    # ``own``: the row can be the smaller set of a link, as the band is its own and the key allows a partner of its size.
    home = F.struct("band", F.col("here").alias("fits"), (F.col("most") >= F.col("n")).alias("own"))
    under = F.struct((F.col("band") - 1).alias("band"), F.col("below").alias("fits"), F.lit(False).alias("own"))
    keyed = keyed.join(shared, "key").select("key", "h1", "n", "most", F.explode(F.array(home, under)).alias("at")).where("at.fits")
    keyed = materialize(keyed.select("key", "at.band", "h1", "n", "most", "at.own"))
    rows = keyed.groupBy("key", "band").agg(F.count("*").alias("rows"), F.max("own").alias("met")).where("rows > 1 and met").drop("met")
    met = materialize(keyed.join(rows, ["key", "band"]))
    sketch = classes.select("h1", "sketch")

    few = met.where(F.col("rows") <= FEW).drop("rows")
    other = few.select("key", "band", F.col("h1").alias("b"), F.col("n").alias("m"), F.col("most").alias("other_most"))
    pairs = few.where("own").withColumnRenamed("h1", "a").join(other, ["key", "band"]).where("m <= most and n <= other_most and (m > n or m = n and b > a)")
    pairs = pairs.select("band", "a", "b", "n", "m").distinct()
    pairs = pairs.join(sketch.select(F.col("h1").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("h1").alias("b"), F.col("sketch").alias("y")), "b")
    near = pairs.mapInArrow(tidy(sketched_pairs(num, den)), "a long, b long")

    many = met.where(F.col("rows") > FEW)
    many = many.withColumn("parts", F.ceil(F.col("rows") / CELL_MEMBERS).cast("int")).withColumn("side", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int"))
    cells = many.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("key", "band", "h1", "n", "most", "own", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    return near.unionByName(cells.join(sketch, "h1").groupBy("key", "band", "lo", "hi").applyInArrow(sketched_cell(num, den), "a long, b long"))


def node_bands(num: int, den: int):
    """The graph nodes of a class, one per band it has keys in."""
    edges = bands(num, den)
    lows = np.array([low for low, _ in edges])

    def run(batches):
        for batch in batches:
            h1 = np.asarray(batch.column("h1")).view(np.uint64)
            own = np.searchsorted(lows, np.asarray(batch.column("n_shingles")), "right") - 1
            for step in (0, 1):
                here = own - step >= 0
                band = (own - step)[here].astype(np.uint64)
                kept = batch.filter(pa.array(here))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(_signed(pair_hash(h1[here], band))), pa.array(band.astype(np.int64))], [*kept.schema.names, "node", "band"])

    return run


def packed_sets(width: int, wanted):
    """Texts of rows in the membership table to (h1 and h2 of the class, the row's ``rep``, sorted shingle hashes as bytes)."""

    def run(batches):
        for whole in batches:
            for batch in slices(members(whole, wanted.value), "text"):
                sets = shingle_sets(batch.column("text"), width)
                h1 = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
                h2 = np.array([int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h1)), pa.array(_signed(h2)), batch.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "rep", "shingles"])

    return run


def compare_cell(num: int, den: int):
    """Verified links of one cell, a spanning forest of them.

    The cell holds the sets of one cluster (or of two slices of a large one).  The
    whole sketches rule out pairs by their Hamming distance; of the rest, those
    not yet connected here are verified on the sets.
    """

    edges = bands(num, den)
    lows = np.array([low for low, _ in edges])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        ids, side = np.asarray(table.column("h1")), np.asarray(table.column("side"))
        two, home = table.column("lo")[0] != table.column("hi")[0], int(table.column("band")[0].as_py())
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets, ids, side = [sets[i] for i in order], ids[order], side[order]
        n = np.array([len(s) for s in sets], np.int64)
        own = np.searchsorted(lows, n, "right") - 1
        words = max(1, -(-int(n[-1]) // 4))
        sk = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(sets):
            spread = mix(s + np.uint64(0x2545F491))
            cell = ((((spread >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)) * np.uint64(64) + (spread & np.uint64(63))).astype(np.int64)
            odd = (np.bincount(cell, minlength=words * 64) & 1).astype(np.uint8)
            sk[i] = np.packbits(odd, bitorder="little").view(np.uint64)
        label = np.arange(len(sets))
        left, right = [], []
        for i in range(len(sets)):
            if own[i] != home:
                break
            last = int(np.searchsorted(n, n[i] * den // num, "right"))
            js = np.arange(i + 1, last)
            js = js[label[js] != label[i]]
            if two:
                js = js[side[js] != side[i]]
            for at in range(0, len(js), 512):
                part = js[at : at + 512]
                part = part[label[part] != label[i]]
                far = np.bitwise_count(sk[part] ^ sk[i]).sum(axis=1, dtype=np.int64)
                for j in part[far * (den + num) <= (den - num) * (n[part] + n[i])].tolist():
                    if label[j] == label[i]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if den * both >= num * (n[i] + n[j] - both):
                        label[label == label[j]] = label[i]
                        left.append(int(ids[i]))
                        right.append(int(ids[j]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, mark) of every row of ``docs`` (doc_id, text; other columns are ignored); ``mark`` is the text's ``text_mark``.

    Words are lower-cased in A-Z only; fewer than ``width`` words make one shingle.
    A null, empty or blank text has no shingle, is linked with nothing and is its own
    component.  Rows with equal sets are one class (a row per class takes part
    in the join).  Repeated doc_ids are separate rows; a null doc_id takes part and is
    never the smallest of a component unless all are null.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark(F.col("text")).alias("mark"))
    info = materialize(docs.mapInArrow(tidy(described(width, num, den, frequencies(docs, width))), INFO))

    full = info.where("n_shingles > 0")
    # One row per class from here on: copies, however many, are grouped where they are read and never meet again.
    classes = materialize(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    clusters = components(near_pairs(classes, num, den)).withColumnRenamed("label", "cluster")
    classes = classes.drop("keys", "sketch")

    member = classes.mapInArrow(node_bands(num, den), "h1 long, h2 long, rep long, n_shingles long, node long, band long")
    member = materialize(member.join(clusters, "node"))
    size = member.groupBy("cluster", "band").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("members"))
    parts = F.greatest(F.ceil(F.col("total") / CELL_SHINGLES), F.ceil(F.col("members") / CELL_MEMBERS)).cast("int")
    placed = member.join(size.where("members > 1").select("cluster", "band", parts.alias("parts")), ["cluster", "band"])
    placed = placed.withColumn("side", F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    # A null id is named like the smallest: both would be of one class, whose set is the same.
    named = lambda c: F.coalesce(c, F.lit(-(1 << 63))).alias("rep")
    cells = placed.select("cluster", "band", "h1", "h2", named("rep"), "side", other)
    cells = cells.select("cluster", "band", "h1", "h2", "rep", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    # The table lets other copies of a class through by chance; the join drops them, so that a cell has one set per class.
    sets = docs.select("text", named("doc_id"), slot("doc_id").alias("slot")).mapInArrow(tidy(packed_sets(width, membership(placed, "rep"))), "h1 long, h2 long, rep long, shingles binary")
    sets = sets.groupBy("h1", "h2", "rep").agg(F.first("shingles").alias("shingles"))
    links = (
        cells.join(sets, ["h1", "h2", "rep"])
        .select("cluster", "band", "lo", "hi", "side", "h1", "shingles")
        .groupBy("cluster", "band", "lo", "hi")
        .applyInArrow(compare_cell(num, den), "a long, b long")
    )
    linked = components(links)

    tops = classes.join(linked, classes["h1"] == linked["node"]).select("h1", "h2", "label", "rep")
    tops = tops.join(tops.groupBy("label").agg(F.min("rep").alias("top")), "label").select("h1", "h2", "top")
    merged = classes.join(tops, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("top", "rep").alias("component"))
    out = info.select("doc_id", "mark", "n_shingles", "h1", "h2").join(merged, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "mark")
