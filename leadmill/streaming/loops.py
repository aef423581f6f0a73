"""Polling workers as micro-batches: each batch is folded into a state table that the next one reads.

A batch writes the state of its own epoch, so a batch that is run again after a failure overwrites what it wrote.  A state is
rewritten per batch; with a v2 table the fold is a MERGE INTO.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadmill.functions import extraction as X
from leadmill.operators import funnel
from leadmill.operators.ranks import scratch

Fold = Callable[[DataFrame, DataFrame], DataFrame]


def _state(spark: SparkSession, path: str, epoch: int, schema: StructType) -> DataFrame:
    """The state before ``epoch``: of the last epoch there is, empty before the first."""
    if epoch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/epoch={epoch - 1}")


@dataclass(frozen=True)
class Parts:
    """A source that is fed part by part: each part's files are dropped into one folder, and a stream that goes on from its checkpoint reads them as a batch."""

    parts: Sequence[DataFrame]

    @property
    def schema(self) -> StructType:
        return self.parts[0].schema

    def select(self, *columns) -> Parts:
        return Parts([p.select(*columns) for p in self.parts])

    def paths(self) -> Iterator[str]:
        """The folder, as often as there are parts, each time with one part more in it."""
        path = scratch(self.parts[0].sparkSession)
        for part in self.parts:
            part.write.mode("append").parquet(path)
            yield path

    def streams(self) -> Iterator[DataFrame]:
        for path in self.paths():
            yield self.parts[0].sparkSession.readStream.schema(self.schema).parquet(path)


def in_parts(df: DataFrame, *cuts: Column) -> Parts:
    """``df`` in parts: the rows of the first cut that holds, the rest last."""
    parts, rest = [], F.lit(True)
    for cut in [*cuts, F.lit(True)]:
        parts.append(df.where(rest & F.coalesce(cut, F.lit(False))))
        rest = rest & ~F.coalesce(cut, F.lit(False))
    return Parts(parts)


def fold_stream(source: DataFrame | Parts, fold: Fold, schema: StructType, report: Fold | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(last state, all reports by epoch) of ``fold(state, batch)`` over a stream, or over parts, run to the end.

    ``report(state, batch)`` sees the state before the batch and gives rows to keep; an empty source leaves an empty state.
    """
    spark = source.parts[0].sparkSession if isinstance(source, Parts) else source.sparkSession
    path = scratch(spark)
    said: list[tuple[int, StructType]] = []

    def step(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        before = _state(spark, f"{path}/state", epoch, schema)
        if report is not None:
            rows = report(before, batch)
            rows.write.mode("overwrite").parquet(f"{path}/report/epoch={epoch}")
            said.append((epoch, rows.schema))
        fold(before, batch).select(schema.fieldNames()).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")
        batch.unpersist()
        said.append((epoch, None))

    for stream in source.streams() if isinstance(source, Parts) else [source]:
        stream.writeStream.option("checkpointLocation", f"{path}/offsets").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    last = max((e for e, _ in said), default=-1)
    reports = None
    for epoch, rows_schema in said:
        if rows_schema is not None:
            part = spark.read.schema(rows_schema).parquet(f"{path}/report/epoch={epoch}").withColumn("epoch", F.lit(epoch))
            reports = part if reports is None else reports.unionByName(part)
    if report is not None and reports is None:
        reports = report(_state(spark, path, 0, schema), spark.createDataFrame([], source.schema)).limit(0).withColumn("epoch", F.lit(0))
    return _state(spark, f"{path}/state", last + 1, schema), reports


def greatest_marks(state: DataFrame, batch: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """High-water marks folded: per key the greatest of old and new."""
    return state.unionByName(batch.select(key, *marks)).groupBy(key).agg(*(F.max(m).alias(m) for m in marks))


def watch_changes(stream: DataFrame | Parts, key: str, enrichment: str, mail: str) -> DataFrame:
    """(epoch, key, enrichment_changed, mail_changed, any_changed): each batch's keys against the marks of the batches before it."""
    schema = stream.select(key, enrichment, mail).schema
    now = lambda batch: batch.groupBy(key).agg(F.max(enrichment).alias(enrichment), F.max(mail).alias(mail))
    _, said = fold_stream(stream, lambda s, b: greatest_marks(s, b, key, [enrichment, mail]), schema, lambda s, b: funnel.change_flags(now(b), s, key, enrichment, mail))
    return said


CRAWLED = "page_id long, domain string, status string, emails array<string>"


def crawl_loop(pages: DataFrame | Parts) -> tuple[DataFrame, DataFrame]:
    """(pages done, domains) of a stream of captured pages: stage one per page, the last capture of a page counts; a domain fails if a page did.

    Each batch is extracted and upserted by page; the roll-up of domains and their e-mails is one aggregate over the state.
    """
    schema = StructType.fromDDL(CRAWLED)

    def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
        blank = X.page_text(F.col("cleaned_html"), F.col("markdown")) == ""
        failed = (F.coalesce("error", F.lit("")) != "") | blank
        new = X.page_emails(batch).select("page_id", "domain", F.when(failed, "failed").otherwise("succeeded").alias("status"), "emails")
        new = new.groupBy("page_id").agg(F.max(F.struct("status", "domain", "emails")).alias("n")).select("page_id", "n.domain", "n.status", "n.emails")
        return state.join(new, "page_id", "left_anti").unionByName(new)

    done, _ = fold_stream(pages, fold, schema)
    domains = done.groupBy("domain").agg(
        F.count("*").alias("pages"), F.when(F.max(F.col("status") == "failed"), "failed").otherwise("succeeded").alias("status"), F.sum(F.size("emails")).alias("found"),
    )
    return done, domains


def mail_loop(requests: DataFrame | Parts, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The mail table after a stream of its rows: of each key the last row, approved rows without content written by ``write``."""
    schema = requests.schema

    def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
        waits = (F.coalesce("content", F.lit("")) == "") & F.coalesce(F.upper("send_status") == "OK", F.lit(False))
        last = batch.groupBy("request_id", "domain").agg(F.max_by(F.struct(*schema.fieldNames()), F.struct("updated_us")).alias("r")).select("r.*")
        ready = write(last.where(waits)).withColumn("send_status", F.lit("READY")).unionByName(last.where(~waits))
        return state.join(ready, ["request_id", "domain"], "left_anti").unionByName(ready)

    return fold_stream(requests, fold, schema)[0]
