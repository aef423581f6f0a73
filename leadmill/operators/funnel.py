"""Queues, status rollups, counters and change flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not done yet."""
    return items.join(done.select(*keys), list(keys), "left_anti")


def status_counts(df: DataFrame, keys: Sequence[str], status: str, succeeded: str, failed: str) -> DataFrame:
    """Total, completed, succeeded, failed and pending rows per key."""
    s = F.col(status)
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s.isin(succeeded, failed)).alias("completed"), F.count_if(s == succeeded).alias("succeeded"),
        F.count_if(s == failed).alias("failed"), F.count_if(s.isNull() | ~s.isin(succeeded, failed)).alias("pending"),
    )


def rollup_status(parents: DataFrame, children: DataFrame, key: str, pending_if: Column, failed_if: Column) -> DataFrame:
    """pending while a child is, failed if one failed, else succeeded; no child leaves it pending."""
    c = children.groupBy(key).agg(F.count("*").alias("n"), F.count_if(pending_if).alias("p"), F.count_if(failed_if).alias("f"))
    j = parents.select(key).join(c, key, "left")
    return j.select(key, F.when(F.coalesce("n", F.lit(0)) == 0, "pending").when(F.col("p") > 0, "pending").when(F.col("f") > 0, "failed").otherwise("succeeded").alias("status"))


def change_flags(now: DataFrame, seen: DataFrame, key: str, enrichment: str, mail: str) -> DataFrame:
    """(enrichment, mail, any) changed since the marks last seen; a first sight counts where there is a mark."""
    s = seen.select(key, F.col(enrichment).alias("_e"), F.col(mail).alias("_m"))
    j = now.join(s, key, "left")
    newer = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    return j.select(key, newer(enrichment, "_e").alias("enrichment_changed"), newer(mail, "_m").alias("mail_changed")).withColumn("any_changed", F.col("enrichment_changed") | F.col("mail_changed"))


def views_due(flags: DataFrame, key: str) -> DataFrame:
    """(key, view) of each view that the change flags call for; no change, no view."""
    e, m = F.coalesce("enrichment_changed", F.lit(False)), F.coalesce("mail_changed", F.lit(False))
    due = F.array(F.when(e, "jobs"), F.when(e | m, "master"), F.when(e | m, "leads"), F.when(m, "mails"))
    return flags.select(key, F.explode(F.array_compact(due)).alias("view"))


def release_stale(df: DataFrame, status: str, started: str, now: Column, minutes: int = 5) -> DataFrame:
    """Claims older than ``minutes``, or without a time, are given back."""
    stale = (F.col(status) == "processing") & (F.col(started).isNull() | (F.col(started) < now - F.expr(f"INTERVAL {minutes} MINUTES")))
    return df.withColumns({status: F.when(stale, F.lit(None)).otherwise(F.col(status)), started: F.when(stale, F.lit(None)).otherwise(F.col(started))})


def suffix_join(hosts: DataFrame, domains: DataFrame, host: str, domain: str) -> DataFrame:
    """host equal to domain or under it: an equi-join on the registrable domain and a residual, not a theta join.

    A parent is only found under one registrable domain: a domain that is a public suffix itself joins with itself alone.
    """
    from leadmill.functions.domain import domains_match, registrable_domain

    h = hosts.withColumn("_r", registrable_domain(F.col(host)))
    d = domains.withColumn("_q", registrable_domain(F.col(domain)))
    return h.join(d, (F.col("_r") == F.col("_q")) & domains_match(F.col(host), F.col(domain))).drop("_r", "_q")
