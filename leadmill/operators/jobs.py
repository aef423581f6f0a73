"""Job records as the fold of an append-only log, and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions import text as T

LOG = "job_id string, tool string, request_id string, state string, at_us long, phase string, current long, total long, message string, metrics map<string,string>, error string"
STATES = ["QUEUED", "RUNNING", "SUCCEEDED", "FAILED"]


def read_log(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid entries, lines that are none): JSON objects with a job, a request, a known state or none, and a time.

    Tools are slugs, ``unknown`` where there is nothing to make one of.
    """
    # Exploded, as Spark would parse a line again for each field that a filter names.
    d = lines.select(F.col(column).alias("_line")).select("_line", F.explode(F.array(F.from_json("_line", LOG))).alias("e"))
    ok = (T.squeeze(F.col("e.job_id")) != "") & (T.squeeze(F.col("e.request_id")) != "") & F.col("e.at_us").isNotNull() & (F.col("e.state").isNull() | F.col("e.state").isin(STATES))
    ok = F.coalesce(ok, F.lit(False))
    tool = F.coalesce(T.blank_to_null(T.slugify(F.col("tool"))), F.lit("unknown"))
    return d.where(ok).select("e.*").withColumns({"tool": tool, "job_id": T.squeeze(F.col("job_id")), "request_id": T.squeeze(F.col("request_id"))}), d.where(~ok).select("_line")


def fold(log: DataFrame) -> DataFrame:
    """One row per job: the last state, the first start, the end of a terminal state, the last of every progress field, all metrics, the error.

    Later entries win; of one time the larger state in the order of life does.  The log is read once: entries are folded by job and name of a
    metric, and those by job.  Only partial aggregates meet: nothing per job is collected but its metrics, a value per name.
    """
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    at = F.struct("at_us", F.coalesce(rank, F.lit(0)).alias("r"))
    # An entry with several metrics is folded under each, which changes no least and no greatest.
    each = log.select(*(c for c in log.columns if c != "metrics"), at.alias("_at"), F.explode_outer("metrics").alias("_name", "_value"))
    fields = ["state", "phase", "current", "total", "message", "error"]
    terminal = F.col("state").isin("SUCCEEDED", "FAILED")
    pair = lambda c: F.struct("_at", F.col(c).alias("v"))
    named = each.groupBy("job_id", "_name").agg(
        F.min_by(pair("tool"), "_at").alias("tool"), F.min_by(pair("request_id"), "_at").alias("request_id"), F.min(F.when(F.col("state") == "RUNNING", F.col("at_us"))).alias("started_us"),
        F.max(F.when(terminal, F.col("at_us"))).alias("finished_us"), F.max("at_us").alias("updated_us"), *(F.max_by(pair(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in fields),
        F.max_by("_value", F.struct("at_us", "_value")).alias("_value"),
    )
    metrics = F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct(F.col("_name").alias("name"), F.col("_value").alias("value")))))
    jobs = named.groupBy("job_id").agg(
        *(F.min_by(f"{c}.v", f"{c}._at").alias(c) for c in ("tool", "request_id")), F.min("started_us").alias("started_us"), F.max("finished_us").alias("finished_us"), F.max("updated_us").alias("updated_us"),
        *(F.max_by(f"{c}.v", f"{c}._at").alias(c) for c in fields), metrics.alias("_named"),
    )
    jobs = jobs.withColumn("metrics", F.when(F.size("_named") > 0, F.map_from_entries("_named"))).drop("_named")
    # A new start clears the error; so it is the error of a failed job alone.
    return jobs.withColumn("error", F.when(F.col("state") == "FAILED", F.coalesce(F.substring("error", 1, 2000), F.lit("unknown error"))))


def latest(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The job updated last per key; without keys the last of all."""
    return jobs.groupBy(*keys).agg(F.max_by("job_id", F.struct("updated_us", "job_id")).alias("job_id"), F.max("updated_us").alias("updated_us"))
