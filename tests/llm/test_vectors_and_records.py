"""Vector search and near copies, archives and chats on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import chat, topk, vector_forest, warc
from leadmill.llm.queries import tokenizer_path

VOCABULARY = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors():
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + r.normal(scale=0.02 * (i % 5), size=16)).astype(np.float32).tolist(), i % 3) for i in range(120)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [math.nan] + [1.0] * 15, 1), (203, [math.inf] + [1.0] * 15, 1), (204, [0.0] * 16, 1), (205, [0.0] * 16, 1)]
    rows += [(206, rows[0][1], None), (207, rows[0][1], rows[0][2]), (208, rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2]), (210, [], 1)]
    return rows


def test_top_k(spark):
    rows = [x for x in vectors() if x[1] != []]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as part").repartition(3)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = {i: np.floor(64 * np.array(e, float)) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = {}
    for q in (i for i in usable if i % 20 == 0):
        best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:7]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_top_k_where_own_rows_fill_the_block(spark):
    """A query whose vec_id has more rows in a block than k, all above the other candidates."""
    r = np.random.default_rng(4)
    others = [(i, r.normal(size=8).astype(np.float32).tolist(), 0) for i in range(60)]
    own = [(900, (9 * np.ones(8)).tolist(), 0)] * 30
    df = spark.createDataFrame(own + others, SCHEMA).coalesce(1)
    got = sorted((x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.where("vec_id = 900"), k=5).collect())
    q = np.full(8, 9 * 64)
    best = sorted((-int(q @ np.floor(64 * np.array(e, float)).astype(int)), i) for i, e, _ in others)[:5]
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    alone = df.where("vec_id = 900")
    assert topk.top_k(alone, alone, k=5).count() == 0


def test_top_k_keeps_large_weights_apart(spark):
    """Components of 1e9 and scores past 63 bits in between: sums are exact, and what no long can hold raises."""
    rows = [(0, [3e8, 0.0], 0), (1, [1e9, 1.0], 0), (2, [1e9, 0.0], 0), (3, [2e9, 0.0], 0), (4, [5e9, -5e9], 0), (20, [4.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(df, df.where("vec_id = 20"), k=9, scale=64.0).collect()}
    want = sorted((-sum(math.floor(64 * a) * 256 for a in e), i) for i, e, _ in rows if i != 20)
    assert got == {(20, n + 1): (i, -s) for n, (s, i) in enumerate(want)}
    big = topk.top_k(df, df.where("vec_id = 0"), k=9, scale=1.0)
    assert [(x.vec_id, x.score) for x in big.orderBy("rank").collect()] == [(4, 1500000000000000000), (3, 600000000000000000), (1, 300000000000000000), (2, 300000000000000000), (20, 1200000000)]
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(df, df.where("vec_id = 4"), k=9, scale=64.0).collect()


def chain(n, step, at=0):
    return [(at + i, [math.cos(math.radians(step * i)), math.sin(math.radians(step * i))] + [0.0] * 6, at) for i in range(n)]


@pytest.mark.parametrize("leaf_rows", [512, 8])
def test_chains_of_vectors_are_one_component(spark, leaf_rows):
    """Each is linked with its neighbours alone, or with few: components hold the whole chain."""
    rows = chain(9, 10) + [(i, e, 1000) for i, e, _ in chain(90, 4, 1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_forest.near_vectors(df, leaf_rows=leaf_rows).collect()}
    e = np.array([r[1] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    near = (e @ e.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    assert got == {r[0]: (int(near[n].sum()) - 1, 0 if r[2] == 0 else 1000) for n, r in enumerate(rows)}


def test_many_labels_and_lengths_have_trees(spark):
    """2,000 labels, some of another dimension; large ones are split by trees of their own."""
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=6 if i % 7 else 9).round(2).tolist(), i % 2000) for i in range(4000)]
    rows += [(5000 + i, r.normal(size=5).tolist(), 5000 + i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in vector_forest.near_vectors(df, leaf_rows=64).collect()}
    want = {}
    for label in {r[2] for r in rows}:
        mine = [(i, np.array(e) / np.linalg.norm(e)) for i, e, l in rows if l == label]
        for i, a in mine:
            want[i] = sum(i != j and len(a) == len(b) and a @ b >= 0.98 for j, b in mine)
    assert set(got) == set(want) and all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


def cloud(n, dim, noise, seed, label, at=0):
    """Rows around one direction."""
    r = np.random.default_rng(seed)
    return [(at + i, e.tolist(), label) for i, e in enumerate(np.eye(dim)[0] + r.normal(size=(n, dim)) * noise)]


def counted(rows, threshold=0.98):
    """Links and components by blocks of all pairs."""
    links, top = {}, {}
    for label in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in mine])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = [x[a : a + 1000] @ x.T >= threshold for a in range(0, len(x), 1000)]
        for i, n in zip((r[0] for r in mine), np.concatenate([b.sum(axis=1) for b in near]).tolist(), strict=True):
            links[i] = n - 1
        low = np.arange(len(x))
        while True:
            new = np.concatenate([np.where(b, low[None], len(x)).min(axis=1) for b in near])
            new = np.minimum(new, low)[np.minimum(new, low)]
            if (new == low).all():
                break
            low = new
        for r, m in zip(mine, low.tolist(), strict=True):
            top[r[0]] = mine[m][0]
    return links, top


@pytest.mark.parametrize("noise", [0.004, 0.011, 0.02])
def test_large_leaves_have_representatives(spark, monkeypatch, noise):
    """A tight group, a group near the threshold or a loose one in a label with others: links are those of all pairs."""
    monkeypatch.setattr(vector_forest, "SLICE_ROWS", 150)
    monkeypatch.setattr(vector_forest, "GROUP_ROWS", 40)
    r = np.random.default_rng(1)
    rows = cloud(700, 64, noise, 5, 1) + cloud(300, 64, noise, 6, 2, 1000) + [(2000 + i, e.tolist(), 1) for i, e in enumerate(r.normal(size=(500, 64)))] + [(3000 + i, rows_[1], 1) for i, rows_ in enumerate(cloud(30, 64, noise, 5, 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    links, top = counted(rows)
    got = {x.vec_id: (x.n_links, x.component_id) for x in vector_forest.near_vectors(df, leaf_rows=64).collect()}
    found, there = sum(n for n, _ in got.values()), sum(links.values())
    assert all(got[i][0] <= n for i, n in links.items()) and found >= 0.995 * there
    if noise < 0.02:
        assert got == {i: (links[i], top[i]) for i in links}


def test_a_group_of_near_copies_is_copied_few_times(spark, monkeypatch):
    """20,000 vectors around one direction in one label: every pair is counted, no row is copied thrice."""
    rows = cloud(20_000, 64, 0.005, 2, 7)
    df = spark.createDataFrame([(i, e, l) for i, e, l in rows], "vec_id long, embedding array<double>, label int").repartition(4)
    seen = {}
    leaves = vector_forest.forest_leaves
    monkeypatch.setattr(vector_forest, "forest_leaves", lambda *a: (lambda placed: (seen.update(placed=placed.count()), placed)[1])(leaves(*a)))
    got = vector_forest.near_vectors(df).agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first()
    assert seen["placed"] < 3 * len(rows) and tuple(got) == (19_999, 19_999, 0)


def test_near_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as h1", "2 as leaf", "3 as links").repartition(3)
    ok = [i for i, (_, e, l) in enumerate(rows) if l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    links = [(i, j) for i in ok for j in ok if i < j and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    from brute import groups

    top = groups(len(rows), links)
    low = {}
    for i, g in enumerate(top):
        low[g] = min((x for x in (low.get(g), rows[i][0]) if x is not None), default=None)
    count = [sum(i in l for l in links) for i in range(len(rows))]
    want = sorted(((rows[i][0], count[i], low[top[i]]) for i in range(len(rows))), key=str)
    for leaf_rows in (512, 8):
        got = vector_forest.near_vectors(df, leaf_rows=leaf_rows).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vector_forest.near_vectors(df.where("false")).count() == 0


def pages():
    r = random.Random(2)
    html = [f"<p>{r.random()}</p>" * n for n in (1, 5, 2000)]
    rows = [(i * 3 % 31, f"http://a/{i}", html[i % 3] if i % 4 else f"<b>é{i}</b>") for i in range(30)]
    return rows + [(40, None, None), (41, "http://b/\r\nX: y%0d", ""), (42, "u", "x"), (None, "u", "x"), (43, "u", "\r\n\r\n" * 9)]


def test_archives(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as digest").repartition(3)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        own = first.get(h or "") in (i, None)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first[h or ""]))
    got = [tuple(r) for r in warc.archive_pages(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_pages(df.where("false")).count() == 0


def test_archive_headers_and_pushdown(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    back = warc.read_archives(spark, f"file://{tmp_path}/w", "keep")
    got = {r.page_id: (r.target_uri, None if r.payload is None else bytes(r.payload).decode()) for r in back.where("record_type = 'response'").collect()}
    for i, u, h in rows:
        if i in got and i is not None:
            assert got[i] == (u, h or "")
    revisits = back.where("record_type = 'revisit'")
    assert revisits.where("payload is not null").count() == 0 and revisits.count() + len(got) == len(rows)


def conversations():
    shared = [("system", "be kind"), ("user", "hi"), ("assistant", "hello <|im_end|> <\\|x|>")]
    rows = []
    for c in range(9):
        for t, (role, text) in enumerate(shared[: 1 + c % 3] + [("user", f"q{c % 4}"), ("assistant", "ä" * (c % 3))]):
            rows.append((c, t, role, text))
    return rows + [(50, 0, None, None), (50, None, "assistant", "first"), (51, 0, "assistant", "x" * 200_000), (52, 1, "role\nwith%0A", "t"), (53, 2, "user", "tie"), (53, 2, "user", "tie"), (None, 0, "user", "no id")]


def digests(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or "", role is not None, text is not None))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_chats(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as chain", "3 as offset").repartition(3)
    forest = chat.build(df, VOCABULARY)
    got = [tuple(r)[:5] for r in chat.digest(forest, VOCABULARY).collect()]
    assert sorted(got, key=str) == sorted(digests(rows), key=str)
    nodes = forest.segments.collect()
    at = 0
    for n in sorted(nodes, key=lambda n: n.offset):
        assert n.offset == at
        at += n.length
    assert len(nodes) < len(rows)
    assert all(len(n.ids) == n.length for n in nodes)
    assert chat.digest(chat.build(df.where("false"), VOCABULARY), VOCABULARY).count() == 0


def test_a_hot_chain_meets_each_turn_once(spark):
    """A long conversation whose first turn many others share: the join back makes a row per turn, no more."""
    rows = [(0, t, "user", f"t{t}") for t in range(300)] + [(c, t, "user", "t0" if t == 0 else f"c{c}") for c in range(1, 300) for t in range(2)]
    forest = chat.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), VOCABULARY)
    assert forest.paths.selectExpr("sum(turns)").first()[0] == len(rows)
    got = [tuple(r)[:5] for r in chat.digest(forest, VOCABULARY).collect()]
    assert sorted(got) == sorted(digests(rows))


def test_attention_sees_the_path_alone(spark):
    """What a chain attends to, laid out by position, is its conversation's text before the chain."""
    df = spark.createDataFrame(conversations()[:30], "conv_id long, turn long, role string, text string")
    forest = chat.build(df, VOCABULARY)
    stream = [i for n in sorted(forest.segments.collect(), key=lambda n: n.offset) for i in n.ids]
    paths = {}
    for p in forest.paths.collect():
        paths.setdefault(p.conv, []).append((p.position, stream[p.offset : p.offset + p.length]))
    for c in forest.chains.collect():
        seen = [i for a in c.attends for i in stream[a.offset : a.offset + a.length]] + stream[c.offset : c.offset + c.length]
        assert seen == [i for _, t in sorted(paths[c.chain]) for i in t]
