"""The lead tables as projections of the driver's tables, for the views and the mail queries.

Each is a select list that reads the same in Spark and in the SQL twins: customer k of request r(k mod 5)
owns domain ck.de; its orders are its mail, its events the tracker's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.plans.registry import micros, shared, table

_KEY = {"request_id": "concat('r', k % 5)", "job_id": "concat('j', k % 5)", "domain": "concat('c', k, '.de')"}

ENRICHMENT = _KEY | {
    "sheet_id": "concat('s', k % 5)", "organization": "name",
    "company": """CASE WHEN k % 6 = 0 THEN NULL ELSE concat('{"name": "', name, '", "score": 0.75, "page_type": "home"}') END""",
    "email": """CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{"score": 0.1}' ELSE concat('{"email": "info@c', k, '.de", "score": 0.5, "page_type": "impressum"}') END""",
    "emails_json": """CASE k % 3 WHEN 0 THEN concat('[{"email": "info@c', k, '.de", "evidence": {"url": "https://c', k, '.de/impressum"}}]') WHEN 1 THEN concat('[{"email": "x@y.de", "evidence": {"url": "u"}}, {"email": "info@c', k, '.de", "evidence": [{"url": "https://c', k, '.de/a"}, {"url": "b"}]}]') ELSE NULL END""",
    "contacts": "CASE WHEN k % 2 = 0 THEN 'Ann Lee (CEO)' END", "description": "segment", "status": "CASE WHEN k % 11 = 0 THEN 'failed' ELSE 'succeeded' END",
    "created_us": "k * 1000", "updated_us": "k * 1000 + nation",
}
MAIL_CONTENT = _KEY | {
    "organisation": "concat('Firm ', k)", "company": "CASE WHEN o % 3 = 0 THEN NULL ELSE concat('Firm ', k) END", "email": "concat('info@c', k, '.de')", "subject": "concat('Offer ', o)",
    "content": "CASE o % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('Dear ', n) END", "send_status": "CASE o % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'ok' WHEN 2 THEN NULL WHEN 3 THEN 'READY' ELSE 'VERIFY' END",
    "comments": "CASE WHEN o % 2 = 0 THEN 'checked' END", "updated_us": "o * 10",
}
MAIL_TRACKER = _KEY | {
    "email": "CASE WHEN kind IN ('purchase', 'click') THEN concat('info@c', k, '.de') ELSE concat(kind, '@c', k, '.de') END", "thread_id": "concat('t', k, kind)",
    "send_status": "CASE kind WHEN 'purchase' THEN 'SENT' WHEN 'click' THEN 'failed' WHEN 'signup' THEN NULL ELSE 'OPENED' END", "sent_us": "CASE WHEN kind = 'purchase' THEN last_us END",
    "reply_status": "CASE WHEN n > 3 THEN 'replied' END", "received_us": "CASE WHEN n > 3 THEN last_us END", "created_us": "first_us", "updated_us": "last_us",
}
MASTER = {
    "request_id": "concat('r', k % 5)", "job_id": "concat('j', k % 5)", "organization": "CASE WHEN k % 17 = 0 THEN NULL ELSE name END", "source": "CASE k % 3 WHEN 0 THEN 'hunter' WHEN 1 THEN 'google_maps' ELSE 'hunter, google_maps' END",
    "domain": "CASE WHEN k % 13 = 0 THEN '' WHEN k % 9 = 0 THEN concat(' C', k, '.DE ') ELSE concat('c', k, '.de') END", "crawl_status": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'succeeded' ELSE 'failed' END",
    "extraction_status": "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'reused' END", "enrichment_status": "CASE k % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' END", "mail_write_status": "CASE WHEN k % 2 = 0 THEN 'succeeded' END", "mail_send_status": "CASE k % 6 WHEN 0 THEN 'contacted' WHEN 1 THEN '' END",
}
SOURCE = {
    "organization": "concat('Org ', p % 40)", "domain": "concat('p', p, '.de')", "location": "CASE p % 5 WHEN 0 THEN '-' WHEN 1 THEN NULL WHEN 2 THEN 'Austria/Wien' WHEN 3 THEN ' Germany / Berlin' ELSE 'Germany' END",
    "headcount": "CASE size % 5 WHEN 0 THEN '1-10' WHEN 1 THEN ' 11-50' WHEN 2 THEN '51-200' WHEN 3 THEN '201-500' ELSE 'huge' END", "query": "kind",
}

_BASES = {
    "enrichment": (ENRICHMENT, "(SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer)"),
    "mail_content": (MAIL_CONTENT, "(SELECT o_custkey AS k, max(o_orderkey) AS o, count(*) AS n FROM orders GROUP BY 1)"),
    "mail_tracker": (MAIL_TRACKER, "(SELECT user_id AS k, event_type AS kind, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2)"),
    "master": (MASTER, "(SELECT c_custkey AS k, c_name AS name FROM customer)"),
    "source": (SOURCE, "(SELECT p_partkey AS p, p_size AS size, p_type AS kind FROM part)"),
}


def sql(name: str) -> str:
    columns, base = _BASES[name]
    return f"(SELECT {', '.join(shared(columns))} FROM {base})"


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: table(spark, sf_dir, t)
    if name == "mail_content":
        return read("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("o"), F.count("*").alias("n"))
    if name == "mail_tracker":
        us = micros(F.col("ts"))
        return read("events").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    if name == "source":
        return read("part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    return read("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


def lead_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _base(spark, sf_dir, name).selectExpr(*shared(_BASES[name][0]))
