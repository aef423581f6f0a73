"""Rate limits, counters and telemetry over all events, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.operators import scans
from leadmill.operators.ranks import scratch
from leadmill.plans.registry import micros, query, table

SPAN = 3 * 3600 * 1_000_000


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"))


@query(f"SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN {SPAN} PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_requests(spark, sf_dir):
    """Requests of the last three hours at each request: the rate limiter's count."""
    return scans.sliding_counts(_events(spark, sf_dir), "event_id", "us", SPAN)


@query(f"SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN {8 * SPAN} PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_requests_by_type(spark, sf_dir):
    """The same over a day for each type of request by itself."""
    return scans.sliding_counts(_events(spark, sf_dir), "event_id", "us", 8 * SPAN, ["event_type"])


@query("""WITH e AS (SELECT event_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents, CAST(event_type = 'error' AS BIGINT) AS bad FROM events),
r AS (SELECT event_id, count(*) OVER w AS done, CAST(sum(bad) OVER w AS BIGINT) AS failed, CAST(coalesce(sum(cents) OVER w, 0) AS BIGINT) AS spent FROM e WINDOW w AS (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT *, round(failed / done::DOUBLE, 6) AS failure_rate FROM r""")
def running_counters(spark, sf_dir):
    """What had been done, failed and spent at each event, and the share that had failed."""
    cents = F.round(F.col("value") * 100).cast("long")
    r = scans.running(_events(spark, sf_dir), [F.col("us"), F.col("event_id")], done=F.lit(1), failed=(F.col("event_type") == "error").cast("int"), spent=cents)
    return r.select("event_id", "done", "failed", "spent", F.round(F.col("failed") / F.col("done"), 6).alias("failure_rate"))


WANTED = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def telemetry(spark, sf_dir, batches: int = 3):
    """The events' summaries, written batch by batch to a table that only grows, a row per type and batch."""
    e, path = _events(spark, sf_dir), scratch(spark)
    for k in range(batches):
        scans.summary(e.where(F.col("event_id") % batches == k), ["event_type"], "value").withColumn("batch", F.lit(k)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY 1")
def telemetry_summary(spark, sf_dir):
    """What the telemetry table says of all batches, and that each estimated percentile's rank is within a hundredth of the wanted one."""
    e = _events(spark, sf_dir)
    said = scans.estimates(scans.merged(telemetry(spark, sf_dir), ["event_type"]), WANTED)
    off = scans.rank_errors(e, ["event_type"], "value", said, WANTED).select(F.col("event_type").alias("_t"), *((F.col(n) <= scans.RANK_ERROR).alias(f"{n}_near") for n in WANTED))
    out = said.join(off, F.col("event_type").eqNullSafe(F.col("_t")), "left")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), "low", "high", *(f"{n}_near" for n in WANTED))
