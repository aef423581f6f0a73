"""Streams as registered queries: windows and sessions under watermarks, and the polling loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators.ranks import scratch
from leadmill.streaming import loops


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: its file or folder, read to the end by ``availableNow``."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    one_file = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = one_file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(one_file).isFile()
    reader = spark.readStream.schema(schema)
    events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


BEAT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run_windows(spark: SparkSession, sf_dir: str, windows: Callable[[DataFrame], DataFrame], delay: str = "1 day") -> DataFrame:
    """Windows of the events in append mode, all of them closed: state goes once the watermark is past it.

    The query runs to the end of its input, then once more from its checkpoint with one beat of a later time, which
    moves the watermark past every window; ``windows`` leaves the beat out.
    """
    path = scratch(spark)
    beats = f"{path}/beats"
    none = spark.createDataFrame([], BEAT)
    none.write.parquet(beats)

    def once() -> None:
        both = event_stream(spark, sf_dir).select(*none.columns).unionByName(spark.readStream.schema(none.schema).parquet(beats))
        out = windows(both.withWatermark("ts", delay))
        q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        once.schema = out.schema

    once()
    end = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.max("ts").cast("timestamp").alias("end"))
    end.where("end is not null").select(F.lit(None).cast("long").alias("event_id"), (F.col("end") + F.expr("INTERVAL 30 DAYS")).alias("ts"), *(F.lit(None).cast(t).alias(c) for c, t in (("user_id", "long"), ("event_type", "string"), ("value", "double"), ("props", "string")))).write.mode("append").parquet(beats)
    once()
    return spark.read.schema(once.schema).parquet(f"{path}/out")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda e: e.where("event_id is not null or event_type is null").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("event_id").alias("n"))
    return run_windows(spark, sf_dir, lambda e: count(e).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")).where("n > 0")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the last two days, by day: the rate limiter's count."""
    count = lambda e: e.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("event_id").alias("n"))
    return run_windows(spark, sf_dir, lambda e: count(e).select(F.unix_micros("w.start").alias("start_us"), "n")).where("n > 0")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda e: e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("event_id").alias("n"))
    return run_windows(spark, sf_dir, lambda e: count(e).select(F.unix_micros("w.start").alias("start_us"), "user_id", "n")).where("n > 0")


def stream_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change flags of each batch's users against the marks of the batches before: the events come in three parts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mark = lambda t, n: F.when(F.col("event_type") == t, F.col("event_id")).alias(n)
    marks = e.select("user_id", "event_id", mark("view", "enrichment"), mark("click", "mail"))
    return loops.watch_changes(loops.in_parts(marks, F.col("event_id") % 5 < 3, F.col("event_id") % 5 == 3), "user_id", "enrichment", "mail")


def stream_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages in two batches, the second with new captures of some: what became of each domain."""
    from leadmill.plans.enrich import captured_pages

    p = captured_pages(spark, sf_dir)
    return loops.crawl_loop(loops.in_parts(p, F.col("page_id") % 2 == 0))[1]


def stream_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail rows in two batches; approved ones without content are written by a rule, as there is no model here."""
    from leadmill.plans.leads import lead_table

    m = lead_table(spark, sf_dir, "mail_content").select("request_id", "domain", "organisation", "content", "send_status", "updated_us")
    write = lambda d: d.withColumn("content", F.concat(F.lit("Dear "), "organisation"))
    done = loops.mail_loop(loops.in_parts(m, F.col("updated_us") % 20 == 0), write)
    return done.select("request_id", "domain", "content", "send_status")


def _mail_sql() -> str:
    from leadmill.plans.leads import sql

    return f"SELECT request_id, domain, CASE WHEN w THEN 'Dear ' || organisation ELSE content END AS content, CASE WHEN w THEN 'READY' ELSE send_status END AS send_status FROM (SELECT *, coalesce(content, '') = '' AND coalesce(upper(send_status) = 'OK', false) AS w FROM {sql('mail_content')})"


_PART = "CASE WHEN event_id % 5 < 3 THEN 0 WHEN event_id % 5 = 3 THEN 1 ELSE 2 END"
QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_change_detect, stream_crawl, stream_mail)}
ORACLES = {
    "stream_tumbling": "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sliding": "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts) - to_days(d)) AS start_us, count(*) AS n FROM events, (VALUES (0), (1)) v(d) GROUP BY ALL",
    "stream_session": "WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n FROM s GROUP BY user_id, g",
    "stream_change_detect": f"""WITH m AS (SELECT {_PART} AS epoch, user_id, max(event_id) FILTER (event_type = 'view') AS e, max(event_id) FILTER (event_type = 'click') AS k FROM events GROUP BY 1, 2),
f AS (SELECT a.epoch, a.user_id, a.e IS NOT NULL AND (max(b.e) IS NULL OR a.e > max(b.e)) AS enrichment_changed, a.k IS NOT NULL AND (max(b.k) IS NULL OR a.k > max(b.k)) AS mail_changed FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND b.epoch < a.epoch GROUP BY a.epoch, a.user_id, a.e, a.k)
SELECT epoch::INTEGER AS epoch, user_id, enrichment_changed, mail_changed, enrichment_changed OR mail_changed AS any_changed FROM f""",
    "stream_mail": _mail_sql(),
}
