"""Stateful loops: gather all that belongs to a key and hand it on once, and chain such stages.

A stage keeps, per key, who has come in (a map), what they brought (a list) and the round's state (a value) in RocksDB.  A round
begins with a key's first row.  It ends when as many members are in as the key expects, or when the watermark has passed its
deadline; then the key goes out once, and its marker stays until the deadline, so that what is repeated or comes after is
ignored.  Nothing of a key is kept past its deadline.  Rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from leadmill.operators.ranks import scratch
from leadmill.streaming.loops import Parts

#: What a stage takes: key, member, how many members the key has, whether this one failed, what it brings, and when.
ROWS = "key string, member string, expected int, failed boolean, found array<string>, ts timestamp"
#: What it gives: the time is the last member's for a complete key, the deadline for one that was waited for in vain.
GATHERED = "key string, reason string, members long, failed long, found array<string>, ts timestamp"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State goes to RocksDB, on the executors' disks and in checkpoints, as long as this lasts."""
    name, value = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Gather(StatefulProcessor):
    """Rows of a key to one row, when the key is complete or its patience is over."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms
        self.shared: dict[tuple, tuple] = {}

    def init(self, handle) -> None:
        self.handle = handle
        self.round = handle.getValueState("round", "expected int, count long, failed long, last long, deadline long, closed boolean")
        self.members = handle.getMapState("members", "member string", "failed boolean")
        self.found = handle.getListState("found", "item string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.round.exists()
        expected, count, failed, last, deadline, closed = self.round.get() if known else (0, 0, 0, 0, None, False)
        begin, fresh, items = None, {}, set()
        for some in rows:  # in pieces: a key may have most of a batch
            some = some[some["member"].notna()]  # a beat has no member
            if some.empty:
                continue
            ms = some["ts"].astype("datetime64[ms]").astype("int64")
            begin = int(ms.min()) if begin is None else min(begin, int(ms.min()))
            if closed:
                continue
            for member, wants, bad, found, at in zip(some["member"], some["expected"], some["failed"], some["found"], ms, strict=True):
                # Of a member's rows in a batch the earliest counts.
                if (old := fresh.get(member)) is not None and old[0] <= at:
                    continue
                brought = tuple(sorted({sys.intern(x) for x in (() if found is None else found) if x is not None}))
                fresh[member] = (int(at), not pd.isna(bad) and bool(bad), 0 if pd.isna(wants) else int(wants), self.shared.setdefault(brought, brought))
        self.shared.clear()
        if begin is None:
            return
        if not known:
            deadline = begin + self.patience_ms
            self.handle.registerTimer(deadline)
        if not closed:
            for member, (at, bad, wants, found) in fresh.items():
                expected = max(expected, wants)
                if not self.members.containsKey((member,)):
                    self.members.updateValue((member,), (bad,))
                    count, failed, last = count + 1, failed + bad, max(last, at)
                    items.update(found)
            if items:
                self.found.appendList([(x,) for x in sorted(items)])
            if count >= expected:
                closed = True
                yield self._row(key, "complete", count, failed, last)
                self._drop()
        self.round.update((expected, count, failed, last, deadline, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.round.exists():
            _, count, failed, _, deadline, closed = self.round.get()
            if not closed:
                yield self._row(key, "timeout", count, failed, deadline)
        self._drop()
        self.round.clear()

    def _row(self, key, reason: str, count: int, failed: int, ms: int) -> pd.DataFrame:
        found = sorted({x for (x,) in self.found.get()}) if self.found.exists() else []
        return pd.DataFrame({"key": [key[0]], "reason": [reason], "members": [count], "failed": [failed], "found": [found], "ts": [pd.Timestamp(ms, unit="ms")]})

    def _drop(self) -> None:
        self.members.clear()
        self.found.clear()

    def close(self) -> None:
        pass


def gathered(rows: DataFrame, delay: str, patience_ms: int) -> DataFrame:
    """The stream of ``GATHERED`` of a stream of ``ROWS``; a null key is a key, a null member only moves time on."""
    keyed = rows.select("key", "member", "expected", "failed", "found", "ts").withWatermark("ts", delay).groupBy("key")
    return keyed.transformWithStateInPandas(Gather(patience_ms), outputStructType=GATHERED, outputMode="append", timeMode="EventTime")


class Stage:
    """One stage of a chain: a folder that it reads as a stream, and the folder it appends to."""

    def __init__(self, spark: SparkSession, name: str, source: str, schema: str, shape: Callable[[DataFrame], DataFrame], delay: str, patience_ms: int):
        self.spark, self.source, self.schema, self.shape, self.delay, self.patience_ms = spark, source, schema, shape, delay, patience_ms
        self.path = f"{scratch(spark)}/{name}"
        self.beats = f"{self.path}/beats"
        spark.createDataFrame([], ROWS).write.parquet(self.beats)

    @property
    def state(self) -> str:
        """Where the state's checkpoint is."""
        return f"{self.path}/state"

    @property
    def out(self) -> str:
        return f"{self.path}/out"

    def advance(self) -> None:
        """Go on from the checkpoint to the end of what there is."""
        read = self.spark.readStream.schema(self.schema).parquet(self.source)
        rows = self.shape(read).unionByName(self.spark.readStream.schema(ROWS).parquet(self.beats))
        q = gathered(rows, self.delay, self.patience_ms).writeStream.format("parquet").outputMode("append").option("checkpointLocation", self.state).option("path", self.out)
        q.trigger(availableNow=True).start().awaitTermination()

    def beat(self, time) -> None:
        """Time is ``time`` by now: open deadlines before it pass."""
        row = self.spark.createDataFrame([(None, None, 0, False, None, time)], ROWS)
        row.write.mode("append").parquet(self.beats)
        self.advance()

    def result(self) -> DataFrame:
        return self.spark.read.schema(GATHERED).parquet(self.out)


def run_chain(parts: Parts, shapes: Sequence[Callable[[DataFrame], DataFrame]], delay: str, patience_ms: Sequence[int], end) -> list[Stage]:
    """Chained stages over a source that comes part by part: the first of ``shapes`` makes its rows ``ROWS``, each other one the output of the
    stage before.  At ``end`` all deadlines are past.

    Each stage has its checkpoint, so each goes on where it was after a failure; the folder between them is a stream sink,
    which holds each output once.
    """
    spark = parts.parts[0].sparkSession
    with rocksdb(spark):
        stages: list[Stage] = []
        for stream_path in parts.paths():
            for n, shape in enumerate(shapes if not stages else ()):
                stages.append(Stage(spark, f"stage{n}", stages[-1].out if n else stream_path, GATHERED if n else parts.schema, shape, delay, patience_ms[n]))
            for s in stages:
                s.advance()
        for n, s in enumerate(stages):
            if n:
                s.advance()
            s.beat(end)
    return stages


def answered(asks: DataFrame, answers: DataFrame, key: str, within: str, delay: str) -> DataFrame:
    """Each ask (key, id, ts) beside every answer (key, id, ts) of its key within that time after it: (key, ask_id, answer_id, waited_ms).

    A stream-stream left outer join under two watermarks: both sides' state goes once no partner can come, and an ask without an answer comes out
    with nulls once the watermark has passed its time.  A null key is answered by nobody.
    """
    a = asks.select(F.col(key).alias("_k"), F.col("id").alias("ask_id"), F.col("ts").alias("_asked")).withWatermark("_asked", delay)
    b = answers.select(F.col(key).alias("_l"), F.col("id").alias("answer_id"), F.col("ts").alias("_came")).withWatermark("_came", delay)
    near = (F.col("_k") == F.col("_l")) & (F.col("_came") >= F.col("_asked")) & (F.col("_came") <= F.col("_asked") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "left_outer").select(F.col("_k").alias(key), "ask_id", "answer_id", (F.unix_millis("_came") - F.unix_millis("_asked")).alias("waited_ms"))


def first_answers(pairs: DataFrame, key: str) -> DataFrame:
    """(key, ask_id, answer_id, waited_ms): of each ask the answer that came first, the smaller id of equals."""
    best = pairs.groupBy(key, "ask_id").agg(F.min(F.when(F.col("answer_id").isNotNull(), F.struct("waited_ms", "answer_id"))).alias("b"))
    return best.select(key, "ask_id", "b.answer_id", "b.waited_ms")


def wait_for_answers(parts: Parts, asks: Callable[[DataFrame], DataFrame], answers: Callable[[DataFrame], DataFrame], key: str, within: str, delay: str) -> DataFrame:
    """``answered`` over a source that comes part by part; the last part should move time past all waits."""
    spark = parts.parts[0].sparkSession
    path = scratch(spark)
    for source in parts.paths():
        read = lambda: spark.readStream.schema(parts.schema).parquet(source)  # noqa: B023, E731
        out = answered(asks(read()), answers(read()), key, within, delay)
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def extract_once(parts: Parts, key: str, delay: str, work: Callable[[DataFrame], DataFrame], failed: DataFrame, every: int) -> DataFrame:
    """The model loop: (``key``, epoch, status, and what ``work`` gives) of a stream of captures (``key``, domain, ts and others).

    A capture that is repeated within ``delay`` goes before any work is done (its state lasts that long and no longer).  Each batch leaves out
    keys that are done already.  Every n-th batch folds in the crawls that failed by then (``failed``: key, domain, ts, of the captures'
    time up to the batch's end), as rows without a result, unless their key is done.  A null key is done each time it comes.
    """
    spark = parts.parts[0].sparkSession
    path = scratch(spark)
    done_schema = None

    def step(batch: DataFrame, epoch: int) -> None:
        nonlocal done_schema
        new = work(batch).withColumns({"status": F.lit("succeeded"), "epoch": F.lit(epoch)})
        done_schema = done_schema or new.schema
        known = spark.read.schema(done_schema).parquet(*[f"{path}/done/{e}" for e in range(epoch)]) if epoch else spark.createDataFrame([], done_schema)
        known = known.select(key, "ts")
        out = new.join(known.select(key), key, "left_anti")
        if epoch % every == every - 1:
            until = known.select("ts").unionByName(batch.select("ts")).agg(F.max("ts").alias("_until"))
            lost = failed.join(known.select(key).unionByName(batch.select(key)), key, "left_anti").join(until, F.col("ts") <= F.col("_until")).drop("_until")
            out = out.unionByName(lost.dropDuplicates([key]).withColumns({"status": F.lit("failed"), "epoch": F.lit(epoch)}), allowMissingColumns=True)
        out.select(done_schema.names).write.mode("overwrite").parquet(f"{path}/done/{epoch}")

    for source in parts.paths():
        once = spark.readStream.schema(parts.schema).parquet(source).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
        once.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    epochs = [r.getPath().getName() for r in _children(spark, f"{path}/done")]
    return spark.read.schema(done_schema).parquet(*[f"{path}/done/{e}" for e in epochs])


def _children(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return list(p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
