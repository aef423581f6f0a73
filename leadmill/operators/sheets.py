"""View exports: a fixed header, hidden columns, chunks of rows, blank rows at the tail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.operators.merge import sheet_rows
from leadmill.operators.ranks import numbered

CHUNK_ROWS, TAIL_BLANKS = 1000, 2


@dataclass(frozen=True)
class Spec:
    """Columns of a view in order, the headers they are shown under, and which of them are hidden."""

    columns: Sequence[str]
    headers: Sequence[str]
    hidden: Sequence[str] = ()

    def shown(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c).alias(h) for c, h in zip(self.columns, self.headers, strict=True) if c not in self.hidden))


#: Headers of the exported views.
SPECS = {
    "maps": Spec(["organization", "domain", "location", "query"], ["Organization", "Domain", "Location", "Search Query"]),
    "hunter": Spec(["organization", "domain", "location", "headcount", "query"], ["Organization", "Domain", "Location", "Headcount", "Search Query"]),
    "tracker": Spec(
        ["request_id", "thread_id", "company", "domain", "contacts", "email", "send_status", "sent_at", "reply_status", "received_at", "action", "comments"],
        ["request_id", "thread_id", "Company", "Domain", "Contacts", "E-Mail", "Send Status", "Sent At", "Reply Status", "Received At", "Action", "comments"], ["request_id", "thread_id"],
    ),
}


def export(df: DataFrame, columns: Sequence[str], order: Sequence[Column], path: str, mode: str = "overwrite", rows: int = CHUNK_ROWS) -> DataFrame:
    """Write ``df`` under ``path`` as text rows in ``order``, a folder per ``rows`` of them; (chunk, n_rows) of what was written.

    Every value is text, a missing one empty.  Two blank rows end the last chunk, or are all there is of an empty table.  ``append`` adds chunks.
    """
    spark = df.sparkSession
    ranked = numbered(df, order, "_row")
    total = ranked.agg(F.coalesce(F.max("_row"), F.lit(0)).alias("_total"))
    blanks = total.select(F.explode(F.sequence(F.col("_total") + 1, F.col("_total") + TAIL_BLANKS)).alias("_row"), F.greatest(F.lit(1), "_total").alias("_last"))
    chunk = lambda c: F.floor((c - 1) / rows)
    body = sheet_rows(ranked, [*columns, "_row"]).withColumns({"_row": F.col("_row").cast("long")}).withColumn("chunk", chunk(F.col("_row")))
    tail = sheet_rows(blanks.select("_row"), [*columns, "_row"]).withColumn("_row", F.col("_row").cast("long"))
    tail = tail.join(F.broadcast(blanks.select("_row", chunk(F.col("_last")).alias("chunk"))), "_row")
    out = body.unionByName(tail).repartitionByRange("chunk", "_row").sortWithinPartitions("chunk", "_row")
    out.drop("_row").write.mode(mode).partitionBy("chunk").option("emptyValue", "").csv(path)
    written = spark.read.option("mode", "PERMISSIVE").schema(", ".join(f"`{c}` string" for c in columns) + ", chunk long").csv(path)
    return written.groupBy("chunk").agg(F.count("*").alias("n_rows"))
