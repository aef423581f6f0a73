"""Planted rows for operators of ``plans.mailing``, with the rows they must give."""

from __future__ import annotations
from pyspark.sql import functions as F
from leadmill import schemas
from leadmill.operators import jobs
from leadmill.plans.registry import Sample

from planted import case

LINES = Sample(
    "value string",
    tuple((v,) for v in (
        '{"job_id": " j1 ", "tool": "Hunter IO", "request_id": "r1", "state": "QUEUED", "at_us": 1}', '{"job_id": "j1", "tool": "x", "request_id": "r1", "state": "RUNNING", "at_us": 2}', '{"job_id": "j1", "tool": "x", "request_id": "r1", "at_us": 3, "phase": "search", "current": 1, "total": 9, "metrics": {"a": "1", "b": "2"}}',
        '{"job_id": "j1", "tool": "x", "request_id": "r1", "at_us": 5, "current": 4, "metrics": {"a": "3"}}', '{"job_id": "j1", "tool": "x", "request_id": "r1", "state": "RUNNING", "at_us": 6}', '{"job_id": "j1", "tool": "x", "request_id": "r1", "state": "SUCCEEDED", "at_us": 9, "message": "done"}',
        '{"job_id": "j2", "tool": "hunter-io", "request_id": "r1", "state": "QUEUED", "at_us": 4}', '{"job_id": "j2", "tool": "hunter_io", "request_id": "r1", "state": "FAILED", "at_us": 8, "error": "boom"}', '{"job_id": "j3", "tool": " ", "request_id": "r2", "state": "QUEUED", "at_us": 7}',
        "not json", '{"job_id": "", "request_id": "r1", "at_us": 1}', '{"job_id": "j4", "request_id": "r1", "state": "LOST", "at_us": 1}', '{"job_id": "j5", "request_id": " ", "at_us": 1}', "", None,
    )),
)
FOLDED = Sample(
    "job_id string, tool string, request_id string, state string, started_us long, finished_us long, updated_us long, phase string, current long, total long, message string, metrics string, error string, latest_of string, rejected long",
    (
        ("j1", "hunter_io", "r1", "SUCCEEDED", 2, 9, 9, "search", 4, 9, "done", "a=3,b=2", None, "request+tool,tool,all", 6),
        ("j2", "hunter_io", "r1", "FAILED", None, 8, 8, None, None, None, None, "", "boom", "", 6), ("j3", "unknown", "r2", "QUEUED", None, None, 7, None, None, None, None, "", None, "request+tool,tool", 6),
    ),
)


@case(f"SELECT * FROM {FOLDED.sql}")
def job_log(spark, sf_dir):
    """A log of job entries folded to jobs, and which is the last of its request and tool, of its tool, of all; the outcome is stated beside."""
    log, bad = jobs.read_log(LINES.df(spark))
    j = jobs.fold(log)
    marks = [(["request_id", "tool"], "request+tool"), (["tool"], "tool"), ([], "all")]
    out = j
    for keys, name in marks:
        out = out.join(jobs.latest(j, keys).select("job_id", F.lit(name).alias(f"_{name[0]}")), "job_id", "left")
    rejected = bad.agg(F.count("*").alias("rejected"))
    shown = F.array_join(F.transform(F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.crossJoin(F.broadcast(rejected)).withColumns({"metrics": shown, "latest_of": F.concat_ws(",", "_r", "_t", "_a")}).drop("_r", "_t", "_a")

OLDER = Sample("request_id string, domain string, organisation string, updated_at string, gone string", (("r1", "a.de", "A", "2024-05-01 10:00:00", "x"), ("r2", None, None, None, None)))


@case("SELECT request_id, NULL::VARCHAR AS job_id, domain, organisation, NULL::VARCHAR AS company, NULL::VARCHAR AS send_status, epoch_us(updated_at::TIMESTAMP) AS updated_us FROM " + OLDER.sql)
def schema_conform(spark, sf_dir):
    """Rows of an older table in today's columns: missing ones null, others gone, types cast."""
    d = schemas.conform(OLDER.df(spark), schemas.TABLES["mail_content"])
    return d.select("request_id", "job_id", "domain", "organisation", "company", "send_status", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))
