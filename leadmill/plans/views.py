"""Read views: leads and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators.merge import last_per_key


def send_status(contacted: Column, tracker: Column, mail: Column) -> Column:
    """CONTACTED before all; a failed tracker makes READY; else the mail's status; else VERIFY."""
    return F.when(contacted, "CONTACTED").when(F.upper(tracker) == "FAILED", "READY").otherwise(F.coalesce(mail, F.lit("VERIFY")))


def mail_status(tracker: Column, mail: Column) -> Column:
    """A failed tracker before the mail's own status, VERIFY where there is none."""
    return F.when(F.upper(tracker) == "FAILED", "FAILED").otherwise(F.coalesce(F.nullif(mail, F.lit("")), F.lit("VERIFY")))


def leads_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads: the latest order as enrichment, its line items as mail content, events as tracker."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    latest = last_per_key(read("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    mail = read("lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("mail_status"), F.count("*").alias("mails"))
    track = last_per_key(read("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    contacted = read("events").where("event_type = 'purchase'").select("user_id").distinct().withColumn("sent", F.lit(True))
    return (
        read("customer").select("c_custkey", "c_name")
        .join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(mail, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(track, F.col("c_custkey") == track["user_id"], "left").drop(track["user_id"])
        .join(contacted, F.col("c_custkey") == contacted["user_id"], "left")
        .select(
            F.col("c_custkey").alias("lead_id"), F.col("c_name").alias("company"), F.col("o_orderkey").alias("enrichment_id"), F.coalesce("mails", F.lit(0)).alias("mails"),
            send_status(F.coalesce("sent", F.lit(False)), F.when(F.col("event_type") == "click", "failed").otherwise(F.col("event_type")), F.col("mail_status")).alias("send_status"),
        )
    )


LEADS_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
m AS (SELECT l_orderkey, max(l_linestatus) AS s, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT c_custkey AS lead_id, c_name AS company, o_orderkey AS enrichment_id, coalesce(n, 0) AS mails,
CASE WHEN c.user_id IS NOT NULL THEN 'CONTACTED' WHEN event_type = 'click' THEN 'READY' ELSE coalesce(s, 'VERIFY') END AS send_status
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN m ON l_orderkey = o_orderkey LEFT JOIN t ON t.user_id = c_custkey LEFT JOIN c ON c.user_id = c_custkey
"""


def jobs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every job, and two progress rows appended."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    jobs = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    shown = jobs.select(F.col("user_id").cast("string").alias("job"), "state", F.lit(0).alias("ordinal"))
    crawl = e.agg(F.concat(F.lit("crawl ("), F.count_if(F.col("event_type") == "view").cast("string"), F.lit("/"), F.count("*").cast("string"), F.lit(")")).alias("job"))
    extract = e.agg(F.concat(F.lit("extraction ("), F.count_if(F.col("event_type") == "click").cast("string"), F.lit("/"), F.count("*").cast("string"), F.lit(")")).alias("job"))
    row = lambda d, n: d.select("job", F.lit("RUNNING").alias("state"), F.lit(n).alias("ordinal"))
    return shown.unionByName(row(crawl, 1)).unionByName(row(extract, 2))


JOBS_SQL = """
SELECT user_id::VARCHAR AS job, arg_max(event_type, (ts, event_id)) AS state, 0 AS ordinal FROM events GROUP BY user_id
UNION ALL SELECT 'crawl (' || count(*) FILTER (event_type = 'view') || '/' || count(*) || ')', 'RUNNING', 1 FROM events
UNION ALL SELECT 'extraction (' || count(*) FILTER (event_type = 'click') || '/' || count(*) || ')', 'RUNNING', 2 FROM events
"""
