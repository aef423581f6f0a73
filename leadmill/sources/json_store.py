"""JSON files as tables: one object or one list per file, as small stores and indexes are kept; and JSON lines.

A file that is one object is one row until its entries are exploded, so it must fit in a task; stores that grow are logs of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of the files under ``path``, blank ones left out."""
    return spark.read.text(path).where("trim(value) <> ''")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of files that are one JSON object each: an entry's value as JSON text; a file that is none gives no rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of files that are one JSON list each: an item as JSON text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value"))


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """(name, embedding) of an index file, a list of {"industry", "embedding"}; items of another shape have nulls in their place."""
    item = F.from_json("value", "industry string, embedding array<double>")
    return items(spark, path).select(item.alias("i")).select(F.col("i.industry").alias("name"), F.col("i.embedding").alias("embedding"))
