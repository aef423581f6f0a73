"""Stateful loops keep what they say and nothing else; bucketed tables and views change what a batch touches and nothing else."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from leadmill.operators.buckets import BUCKET, Buckets
from leadmill.plans import flows
from leadmill.streaming import gather
from leadmill.streaming.loops import Parts

T0 = datetime.datetime(2024, 1, 1)
ROW = "key string, member string, expected int, failed boolean, found array<string>, ts timestamp"


def at(minutes: int) -> datetime.datetime:
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def chain(spark):
    """Keys that are complete, late, repeated, empty or never complete, in three parts."""
    parts = [
        [("full", "a", 2, False, ["x@a.de"], at(0)), ("full", "a", 2, False, ["x@a.de"], at(1)), ("slow", "a", 3, True, None, at(5)), (None, "n", 1, None, [None, "z"], at(6)), ("none", None, 1, False, None, at(7))],
        [("full", "b", 2, True, ["b@a.de", "x@a.de"], at(70)), ("slow", "b", 3, False, ["s"], at(100)), ("new", "a", 1, False, [], at(300))],
        [("full", "c", 2, False, ["late"], at(80)), ("slow", "c", 3, False, ["too late"], at(90)), ("again", "a", 2, False, ["q"], at(500)), ("full", "z", 2, False, ["second round"], at(510))],
    ]
    frames = Parts([spark.createDataFrame(p, ROW) for p in parts])
    whole = lambda s: s.select(F.lit("all").alias("key"), F.concat("key", "reason").alias("member"), F.lit(5).alias("expected"), (F.col("reason") == "timeout").alias("failed"), "found", "ts").where("key is not null")
    return gather.run_chain(frames, [lambda s: s, whole], "60 minutes", (200 * 60_000, 10**10), datetime.datetime(2026, 1, 1))


def test_a_key_comes_out_once_per_round(chain):
    got = sorted(((r.key or "", r.reason, r.members, r.failed, tuple(r.found), r.ts) for r in chain[0].result().collect()), key=lambda x: (x[0], x[5]))
    assert got == [
        ("", "complete", 1, 0, ("z",), at(6)),
        ("again", "timeout", 1, 0, ("q",), at(700)),
        ("full", "complete", 2, 1, ("b@a.de", "x@a.de"), at(70)),
        ("full", "timeout", 1, 0, ("second round",), at(710)),  # its first round's marker went with its deadline
        ("new", "complete", 1, 0, (), at(300)),
        ("slow", "timeout", 2, 1, ("s",), at(205)),  # what came behind the watermark is not in it
    ]


def test_the_next_stage_takes_each_output_once(chain):
    got = chain[1].result().collect()
    assert [(r.key, r.reason, r.members, r.failed) for r in got] == [("all", "complete", 5, 3)]
    assert set(got[0].found) == {"b@a.de", "x@a.de", "s", "q", "second round"}


@pytest.mark.parametrize("stage", [0, 1])
@pytest.mark.parametrize("name", ["round", "members", "found"])
def test_state_is_cleared(spark, chain, stage, name):
    read = spark.read.format("statestore").option("stateVarName", name)
    with gather.rocksdb(spark):
        assert read.load(chain[stage].state).count() == 0


def test_a_wait_ends_with_the_watermark(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "kind string, user string, id long, ts timestamp")
    parts = Parts([
        rows(("ask", "u", 1, at(0)), ("ask", "v", 2, at(0)), ("ask", None, 3, at(1)), ("answer", "u", 10, at(3))),
        rows(("answer", "u", 11, at(5)), ("answer", "u", 12, at(6)), ("answer", "v", 13, at(9)), ("ask", "w", 4, at(20))),
        rows(("answer", "w", 14, at(19)), ("answer", "w", 15, at(22))),
        rows(("ask", "-", 0, at(900)), ("answer", "-", 0, at(900))),
    ])
    side = lambda kind: lambda s: s.where(F.col("kind") == kind).select("user", "id", "ts")
    pairs = gather.wait_for_answers(parts, side("ask"), side("answer"), "user", "300 SECONDS", "10 minutes")
    got = sorted((r.user or "", r.ask_id, r.answer_id, r.waited_ms) for r in pairs.where("user is null or user <> '-'").collect())
    assert got == [("", 3, None, None), ("u", 1, 10, 180_000), ("u", 1, 11, 300_000), ("v", 2, None, None), ("w", 4, 15, 120_000)]
    first = sorted((r.user or "", r.answer_id) for r in gather.first_answers(pairs.where("user is null or user <> '-'"), "user").collect())
    assert first == [("", None), ("u", 10), ("v", None), ("w", 15)]


def test_each_capture_is_worked_on_once(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "page long, ts timestamp, text string")
    parts = Parts([rows((1, at(0), "a"), (2, at(1), "b")), rows((1, at(2), "again"), (3, at(100), "c"), (8, at(99), "crawled after all")), rows((1, at(101), "outside the delay, and done"), (9, at(102), "too late"))])
    seen = []
    lost = spark.createDataFrame([(8, at(90)), (9, at(50)), (2, at(0)), (7, at(500))], "page long, ts timestamp")

    def work(batch):
        seen.extend(r.page for r in batch.select("page").collect())
        return batch.select("page", "ts", F.length("text").alias("found"))

    out = gather.extract_once(parts, "page", "10 minutes", work, lost, 2)
    assert sorted((r.page, r.status, r.found) for r in out.collect()) == [(1, "succeeded", 1), (2, "succeeded", 1), (3, "succeeded", 1), (8, "succeeded", 17), (9, "failed", None)]
    assert sorted(seen) == [1, 1, 2, 3, 8, 9]  # the repeat within the delay is gone before the work


def files(path: str) -> dict[str, dict[str, float]]:
    """Files and their times by bucket."""
    path = path.removeprefix("file://")
    return {d: {f: os.stat(f"{path}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith(BUCKET)}


def changed(before: dict, after: dict) -> set[int]:
    return {int(d.split("=")[1]) for d in before.keys() | after.keys() if before.get(d) != after.get(d)}


def test_a_change_rewrites_its_buckets_alone(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    t = Buckets(df([(i, "old") for i in range(500)]), f"file://{tmp_path}/t", ["k"], count=32)
    steps = [
        (lambda: t.upsert(df([(3, "a"), (3, "b"), (900, "new")]), [F.desc("v")]), {3: "b", 900: "new"}), (lambda: t.replace(df([(7, "r"), (7, "s")])), {7: ("r", "s")}), (lambda: t.delete(df([(9, "")]).select("k")), {9: None}),
    ]
    want = {i: "old" for i in range(500)}
    for step, new in steps:
        before = files(t.path)
        touched = step()
        assert changed(before, files(t.path)) == set(touched) and len(touched) <= 2
        want |= new
        got: dict = {}
        for r in t.read().collect():
            got.setdefault(r.k, []).append(r.v)
        assert {k: tuple(sorted(v)) for k, v in got.items()} == {k: v if isinstance(v, tuple) else (v,) for k, v in want.items() if v is not None}
    assert t.upsert(df([]), [F.desc("v")]) == [] and t.read().count() == sum(len(v) if isinstance(v, tuple) else 1 for v in want.values() if v)


def test_a_bucket_can_become_empty_and_full_again(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    t = Buckets(df([]), f"file://{tmp_path}/t", ["k"], count=4)
    assert t.read().count() == 0
    t.upsert(df([(1, "x"), (None, "y"), (None, "z")]), [F.desc("v")])
    assert t.read().count() == 3
    t.delete(df([(1, "")]).select("k"))
    assert sorted(r.v for r in t.read().collect()) == ["y", "z"]
    t.replace(df([(1, "w")]), df([(1, ""), (2, "")]).select("k"))
    assert sorted(r.v for r in t.read().collect()) == ["w", "y", "z"]


def test_a_view_is_read_and_written_where_it_changed(spark, smoke_dir):
    view, touched = flows.leads_by_deltas(spark, smoke_dir)
    assert all(0 < len(t) <= 8 for t in touched)  # of 64; three or four keys change per batch
    state = files(view.view.path)
    ids = view.apply([F.desc("seen")], right=spark.createDataFrame([(3, 10**9, "purchase")], "lead_id long, seen long, what string"))
    assert changed(state, files(view.view.path)) == set(ids) and len(ids) == 1
    assert view.view.read().where("lead_id = 3").first().send_status == "CONTACTED"
    plan = view.view.rows_of(ids)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    full = view.combine(view.left.read(), view.right.read())
    assert sorted(map(str, full.collect())) == sorted(map(str, view.view.read().select(full.columns).collect()))


def test_a_key_comes_in_pieces_of_any_size(monkeypatch):
    """A key's rows are never put together; of a member's rows the earliest counts, whatever piece it is in, and what it expects too."""
    import pandas as pd

    from leadmill.streaming import gather

    class State:
        def __init__(self):
            self.value, self.items, self.map, self.timers = None, [], {}, []

        exists = lambda self: self.value is not None or bool(self.items)
        get = lambda self: self.value if self.value is not None else iter(self.items)
        update = lambda self, v: setattr(self, "value", v)
        appendList = lambda self, v: self.items.extend(v)
        containsKey = lambda self, k: k in self.map
        updateValue = lambda self, k, v: self.map.__setitem__(k, v)
        clear = lambda self: (self.items.clear(), self.map.clear())
        registerTimer = lambda self, t: self.timers.append(t)

    rows = [("b", 4, True, ["x@b.de"], 5000), (None, 0, False, None, 1), ("a", 4, False, ["y@a.de", None, "x@b.de"], 3000), ("b", 9, False, ["early@b.de"], 2000), ("c", None, None, None, 9000), ("a", 50, True, ["late@a.de"], 4000)]
    frame = pd.DataFrame(rows, columns=["member", "expected", "failed", "found", "ts"]).assign(ts=lambda d: pd.to_datetime(d["ts"], unit="ms"))
    monkeypatch.setattr(gather.pd, "concat", lambda *_: pytest.fail("a key's rows were put together"))
    for pieces in ([frame], [frame[:2], frame[2:3], frame[3:]], [frame[i : i + 1] for i in range(6)]):
        g = gather.Gather(1000)
        g.round, g.members, g.found, g.handle = (State() for _ in range(4))
        assert list(g.handleInputRows(("k",), iter(pieces), None)) == []
        assert g.round.value == (9, 3, 0, 9000, 3000, False) and g.handle.timers == [3000]
        assert {x for (x,) in g.found.items} == {"early@b.de", "y@a.de", "x@b.de"} and {m for (m,) in g.members.map} == {"a", "b", "c"}
