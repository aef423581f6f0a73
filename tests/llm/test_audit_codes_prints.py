"""Filter audit, vector codes and fingerprints against SQL and plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import DOCS, awkward_documents
from pyspark.sql import functions as F

from leadmill.llm import filter_audit, vector_codes, winnowing


# Filter interaction audit


def plain_audit(cells: dict[tuple[str, frozenset], Counter], letters: str) -> set[tuple]:
    """Every order is applied, document class by document class."""
    removed_in, rows = Counter(), []
    for part in {p for p, _ in cells}:
        own = [(bad, c) for (p, bad), c in cells.items() if p == part]
        for order in map("".join, itertools.permutations(letters)):
            left = own
            for step, f in enumerate(order, 1):
                gone, early = [c for bad, c in left if f in bad], [c for bad, c in own if f in bad and bad & set(order[: step - 1])]
                left = [(bad, c) for bad, c in left if f not in bad]
                n = sum(c["n"] for c in gone)
                removed_in[part, f] += n
                rows.append((part, order, step, sum(c["n"] for _, c in left), n, sum(c["n"] for c in early), sum(c["n"] for bad, c in own if bad == {f}), sum(c["good"] for c in gone), sum(c["toxic"] for c in gone), f))
    return {(*r[:-1], removed_in[r[0], r[-1]]) for r in rows}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("letters", ["A", "ABC", "ABCDE"])
def test_every_order_is_read_off_the_cells(spark, letters):
    r = random.Random(3)
    rows = [(r.choice(["", "en"]), sum(1 << i for i in range(len(letters)) if r.random() < 0.4), r.random() < 0.3, r.random() < 0.2) for _ in range(400)]
    cells = defaultdict(Counter)
    for part, mask, good, toxic in rows:
        cells[part, frozenset(c for i, c in enumerate(letters) if mask >> i & 1)].update(n=1, good=good, toxic=toxic)
    masks = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
    out = filter_audit.interactions(filter_audit.histogram(masks), letters).select(*COLUMNS).collect()
    assert len(out) == 2 * math.factorial(len(letters)) * len(letters)
    assert {tuple(x) for x in out} == plain_audit(cells, letters)


def test_audit_of_awkward_rows(spark, documents):
    """Nulls, copies, ties of an id, several labels of one id, labels of nobody: the SQL says the same."""
    ids = [r[0] for r in awkward_documents()]
    labels = [(i, j % 2, (j // 2) % 2) for j, i in enumerate(ids[:12])] + [(ids[0], 1, None), (None, 1, 1), (999, 1, 1), (ids[13], None, 1)]
    docs, labels = documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype("Int64"))
    want = con.execute(filter_audit.SQL)
    names = [d[0] for d in want.description]
    out = filter_audit.audit(docs, labels)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(want.fetchall())
    assert {r.part for r in out.collect()} == {"", "en", "de"}
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_repeats_fail_by_the_smallest_id_alone(spark):
    rows = [(5, "a"), (3, "a"), (3, "a"), (None, "a"), (9, "b"), (None, "c"), (None, "c")]
    marks = spark.createDataFrame([(i, bytes(t, "ascii"), 0) for i, t in rows], "doc_id long, digest binary, mask int")
    got = sorted(((r.doc_id or -1), r.mask) for r in filter_audit.with_repeat_bit(marks, 2).collect())
    assert got == [(-1, 0), (-1, 0), (-1, 4), (3, 0), (3, 0), (5, 4), (9, 0)]


# Vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256.0):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted(((i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [[tuple((v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            by = defaultdict(list)
            for c in cut:
                by[nearest(p, c[p])].append(c[p])
            for e, xs in by.items():
                new[p][e] = tuple(sum(t) // len(xs) for t in zip(*xs, strict=True))
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, lab, [nearest(p, c[p]) for p in range(parts)], c) for (i, _, lab), c in zip(kept, cut, strict=True)]
    out = [(i, lab, bytes(code).hex(), sum(far(c[p], books[p][e]) for p, e in enumerate(code))) for i, lab, code, c in out]
    sums = Counter()
    for _, lab, _, error in out:
        sums[lab] += error
    return sorted(((i, code, error, sums[lab], digest) for i, lab, code, error in out), key=repr)


def vectors_with_trouble(dim: int, n: int = 150) -> list[tuple]:
    r = random.Random(dim)
    rows = [(3 * i % 401, [r.gauss(0, 0.3) for _ in range(dim)], r.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(500 + i, list(rows[i % 5][1]), 1) for i in range(40)]  # copies
    rows += [(600, None, 1), (601, [None] + [0.0] * (dim - 1), 1), (602, [float("nan")] * dim, 1), (603, [float("inf")] * dim, None), (604, [0.0] * dim, None)]
    return [*rows, rows[0], (None, [0.25] * dim, 2), (rows[1][0], [-0.5] * dim, 2)]


def coded(df, **kw):
    out = vector_codes.compress(df, **kw)
    return sorted(((r.vec_id, r.code.hex(), r.error, r.label_error, r.codebooks_sha256) for r in out.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("dim", [64, 16, 40, 7])
def test_codes_equal_a_plain_search(spark, dim):
    rows = vectors_with_trouble(dim)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit("x"), "error": F.lit("x")}).repartition(3)
    assert coded(df) == plain_codes(rows)
    assert coded(df, parts=4, entries=9, rounds=3, scale=8.0) == plain_codes(rows, 4, 9, 3, 8.0)


def test_code_cases(spark):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert vector_codes.compress(df([(1, None, 1), (2, [float("nan")], 1)])).count() == 0
    few = [(i, [float(i % 3)] * 16, None) for i in range(5)]  # fewer rows than entries, ties between entries
    assert coded(df(few)) == plain_codes(few)
    empty = [(1, [], 1), (2, [], None)]
    assert coded(df(empty)) == plain_codes(empty)
    mixed = [(1, [0.5] * 16, 1), (2, [0.25] * 20, 1), (3, [], 1)]
    assert coded(df(mixed)) == plain_codes(mixed)
    r = random.Random(1)
    wide = [(i, [r.choice([-1, 1]) * 2.0 ** r.randint(40, 52) if i % 4 else 2.0**45 for _ in range(16)], 0) for i in range(30)]
    if max(e for _, _, e, _, _ in plain_codes(wide, entries=30)) < 1 << 63:
        assert coded(df(wide), entries=30) == plain_codes(wide, entries=30)
    far = [(i, [2.0**50 + 256.0 * (i % 7)] * 16, 0) for i in range(40)]  # sums of squares beyond 63 bits, small errors
    assert coded(df(far), entries=3) == plain_codes(far, entries=3)
    with pytest.raises(Exception, match="62 bits"):
        vector_codes.compress(df([(1, [1e300] * 16, 1)])).collect()


def test_bounds_leave_out_no_nearest_entry_and_most_others():
    g = np.random.default_rng(2)
    for width in (1, 2, 4, 5, 48):
        entries = g.integers(-200, 200, (64, width))
        entries[10] = entries[3]
        part = vector_codes.Part(tuple(map(tuple, entries.tolist())))
        x = np.concatenate((g.integers(-300, 300, (500, width)), entries))
        at, far, measured = part.nearest(x)
        every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
        assert measured.min() >= 1
        if width in (2, 4):
            assert measured.mean() < 26


def test_codes_equal_sql_and_decode_nearly(spark, smoke_dir):
    v = spark.read.parquet(f"{smoke_dir}/embeddings.parquet")
    books = vector_codes.fit(v)
    codes = vector_codes.encode(v, books)
    back = vector_codes.decode(codes, books).join(v.select("vec_id", F.col("embedding").alias("given")), "vec_id").collect()
    assert back and all(len(r.embedding) == len(r.given) for r in back)
    error = np.mean([np.square(np.array(r.embedding) - np.array(r.given)).sum() for r in back])
    assert error < 0.5 * np.mean([np.square(r.given).sum() for r in back])
    con = duckdb.connect()
    con.register("embeddings", v.toPandas())
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vector_codes.sql()})").fetchall()
    assert coded(v) == sorted(want, key=repr)


# Winnowing


def plain_winnow(hashes: list[int], window: int) -> list[int]:
    window = min(window, len(hashes))
    out = []
    for i in range(len(hashes) - window + 1) if hashes else []:
        low = min(hashes[i : i + window])
        at = max(j for j in range(i, i + window) if hashes[j] == low)
        if not out or out[-1] != at:
            out.append(at)
    return out


def plain_print(text: str, k: int, window: int):
    points = [ord(c) for c in text]
    grams = [tuple(points[i : i + k]) for i in range(max(1, len(points) - k + 1))] if points else []
    one = {g: int(winnowing.gram_hashes(np.array(g, np.uint32), k)[0]) for g in set(grams)}
    hashes = [one[g] for g in grams]
    own = min(window, 1 + len(hashes) // winnowing.GRAMS_PER_WINDOW)
    return hashes, plain_winnow(hashes, own), own


def plain_likeness(a: str, b: str, k: int, window: int) -> float:
    (x, _, p), (y, _, q) = plain_print(a, k, window), plain_print(b, k, window)
    x, y = ({h[i] for i in plain_winnow(h, max(p, q))} for h in (x, y))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_prints_are_those_of_a_plain_winnower():
    r = random.Random(8)
    for n in (0, 1, 5, 12, 13, 60, 300, 2000):
        for letters in ("ab", "abcdefgh É日😀"):
            text = "".join(r.choice(letters) for _ in range(n))
            f = winnowing.fingerprint_points(winnowing.code_points(text), 12, 40)
            hashes, at, own = plain_print(text, 12, 40)
            assert f.positions.tolist() == at and f.hashes.tolist() == [hashes[i] for i in at] and (f.window, f.grams) == (own, len(hashes))
            assert f.coarser(60).tolist() == [hashes[i] for i in plain_winnow(hashes, 60)]


def test_a_long_shared_passage_shares_a_print_at_its_place():
    r = random.Random(9)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    k, w = 12, 40
    for _ in range(60):
        shared, head, other = prose(w + k - 1), prose(r.randint(400, 900)), prose(r.randint(400, 900))
        a, b = (winnowing.fingerprint_points(winnowing.code_points(x), k, w) for x in (head + shared + prose(200), other + shared + prose(90)))
        at = {(h, p - len(head)) for h, p in zip(a.hashes.tolist(), a.positions.tolist(), strict=True)}
        assert any((h, p - len(other)) in at for h, p in zip(b.hashes.tolist(), b.positions.tolist(), strict=True))


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edited_and_next_texts(spark, documents, ranges, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGES", ranges)
    rows = [(i, t or "") for i, t, *_ in awkward_documents()]
    mark = lambda t: winnowing.xxhash.xxh3_64_intdigest(t.encode())
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, mark(x[1])))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        long = len(t) > 20_000
        near = () if long else (plain_likeness(t, edited, 12, 40), plain_likeness(t, after, 12, 40) if len(after) < 20_000 else None)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), near))
    got = winnowing.edited_and_next(documents).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted((i or -1, n, h) for i, n, h, _ in want)
    by = {(i, n, h): near for i, n, h, near in want}
    for r in got:
        near = by[r.doc_id, r.n_chars, r.edited_sha256]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if near:
            assert math.isclose(r.near_edited, near[0]) and (near[1] is None or math.isclose(r.near_next, near[1]))
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1 and r.n_chars < 4) or r.n_chars >= 4
    same = defaultdict(set)
    for r in spark.createDataFrame([(x.doc_id, x.fingerprint) for x in got], "doc_id long, f string").join(documents.select("doc_id", "text"), "doc_id").collect():
        same[r.text].add(r.f)
    assert len(same["one two three"]) == 1


def test_neighbours_in_small_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, DOCS)
    assert winnowing.edited_and_next(df([])).count() == 0
    assert winnowing.fingerprints(df([])).count() == 0
    one = winnowing.edited_and_next(df([(7, "abcdefgh", None, None, 3)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    two = {r.doc_id: r for r in winnowing.edited_and_next(df([(7, "abcdefgh", None, None, 3), (2, None, None, None, None)])).collect()}
    assert two[7].edited_sha256 == hashlib.sha256(b"abcdef").hexdigest() and two[7].near_next == 0.0
    assert (two[2].n_chars, two[2].near_edited, two[2].fingerprint) == (0, 1.0, "1.0.")
    prints = winnowing.fingerprints(df([(1, "same text here, the same", None, None, 1), (2, None, None, None, 1)])).collect()
    assert {r.doc_id: len(r.hashes) == len(r.positions) for r in prints} == {1: True, 2: True}


def test_edits_are_near_and_others_far(spark, smoke_dir):
    rows = winnowing.edited_and_next(spark.read.parquet(f"{smoke_dir}/documents.parquet")).where("n_chars >= 200").collect()
    near, far = np.mean([r.near_edited for r in rows]), np.mean([r.near_next for r in rows])
    assert 0.5 < near < 0.75 and far < 0.15
