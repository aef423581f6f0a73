"""Records that a model returned: sections flattened, quotes cut, lengths checked, bad ones set aside with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadmill.functions.text import blank_to_null

#: The longest quote, and the shortest and longest text of each field.
MOST_QUOTE = 300
LENGTHS = {"quote": (5, 300), "name": (1, 160), "role": (0, 160), "company": (1, 200), "short_description": (20, 600), "long_description": (20, 1200)}
SECTION = "source_url string, extracted struct<emails:array<struct<email:string,evidence:struct<quote:string>>>,contacts:array<struct<name:string,role:string,evidence:struct<quote:string>>>>"


def short_quote(quote: Column) -> Column:
    """Trimmed, at most 300 characters; empty and NULL stay."""
    return F.when(F.coalesce(quote, F.lit("")) == "", quote).otherwise(F.substring(F.trim(quote), 1, MOST_QUOTE))


def section_emails(sections: DataFrame, keys: Sequence[str], column: str = "section") -> DataFrame:
    """(keys, pos, email, url, quote): well-formed addresses with evidence of sections that have a source."""
    s = F.from_json(column, SECTION)
    d = sections.select(*keys, s.alias("s")).where("s.source_url <> ''").select(*keys, F.col("s.source_url").alias("url"), F.posexplode("s.extracted.emails").alias("pos", "e"))
    d = d.where("e.evidence is not null").select(*keys, "pos", F.trim("e.email").alias("email"), "url", F.coalesce(F.col("e.evidence.quote"), F.lit("")).alias("quote"))
    return d.where(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))


def section_contacts(sections: DataFrame, keys: Sequence[str], column: str = "section") -> DataFrame:
    """(keys, pos, name, role, url, quote): people with evidence of sections that have a source."""
    s = F.from_json(column, SECTION)
    d = sections.select(*keys, s.alias("s")).where("s.source_url <> ''").select(*keys, F.col("s.source_url").alias("url"), F.posexplode("s.extracted.contacts").alias("pos", "c"))
    d = d.where("c.evidence is not null").select(*keys, "pos", blank_to_null(F.col("c.name")).alias("name"), F.col("c.role").alias("role"), "url", F.coalesce(F.col("c.evidence.quote"), F.lit("")).alias("quote"))
    return d.where("name is not null")


def checked(df: DataFrame, fields: dict[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``problems``: each field (column to rule) that is missing, too short or too long; none for a good record."""
    found = []
    for column, rule in fields.items():
        low, high = LENGTHS[rule]
        n = F.length(column)
        missing = F.lit(None) if column in optional else F.lit(f"{column} missing")
        found.append(F.when(F.col(column).isNull(), missing).when(n < low, f"{column} short").when(n > high, f"{column} long"))
    return df.withColumn("problems", F.array_compact(F.array(*found)))


def parted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, quarantine) of ``checked`` rows."""
    return df.where(F.size("problems") == 0).drop("problems"), df.where(F.size("problems") > 0)


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are there once an action has run over it; no pass of their own."""
    watch = Observation(name)
    return df.observe(watch, *(c.alias(n) for n, c in counters.items())), watch
