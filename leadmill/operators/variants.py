"""JSON of any shape as VARIANT: parsed once, taken apart by what it holds, not by guesses about its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(v: Column) -> Column:
    """null, object, array, string, number, boolean or another type's name in lower case; NULL for NULL."""
    s = F.lower(F.schema_of_variant(v))
    numbers = s.startswith("bigint") | s.startswith("decimal") | s.startswith("double") | s.startswith("float")
    return F.when(v.isNull(), None).when(s == "void", "null").when(s.startswith("object"), "object").when(s.startswith("array"), "array").when(numbers, "number").otherwise(s)


def members(df: DataFrame, column: str) -> DataFrame:
    """``df`` with (pos, key, value) of each member of the VARIANT ``column``: an object's by key, in the order of keys, an array's with a NULL key; other values have none."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer()))


def text_of(v: Column) -> Column:
    """A string as it is, other values as JSON; NULL for null."""
    return F.when(kind_of(v) != "null", F.coalesce(F.when(kind_of(v) == "string", F.try_variant_get(v, "$", "string")), F.to_json(v)))


def leaves(df: DataFrame, column: str, depth: int = 3) -> DataFrame:
    """``df`` with (path, kind, text) of every value in the JSON text ``column`` that is no object or array down to ``depth`` levels, and of what lies deeper as JSON.

    Text that is no JSON has no row; empty objects and arrays have none.
    """
    keep = [c for c in df.columns if c != column]
    level = df.select(*keep, F.lit("$").alias("path"), F.try_parse_json(column).alias("_v")).where("_v is not null")
    out = None
    for n in range(depth + 1):
        nested = kind_of(F.col("_v")).isin("object", "array") if n < depth else F.lit(False)
        flat = level.where(~nested).select(*keep, "path", kind_of(F.col("_v")).alias("kind"), text_of(F.col("_v")).alias("text"))
        out = flat if out is None else out.unionByName(flat)
        if n < depth:
            step = members(level.where(nested), "_v")
            name = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
            level = step.select(*keep, F.concat("path", name).alias("path"), F.col("value").alias("_v"))
    return out


def links(df: DataFrame, column: str) -> DataFrame:
    """``df`` without ``column``, with (place, url): http URLs of a polymorphic list: strings, objects with href, url or link, or lists of those by name.

    ``place`` orders them: the list's key (empty for a bare list) and the position in it.
    """
    keep = [c for c in df.columns if c != column]
    whole = df.select(*keep, F.try_parse_json(column).alias("_v"))
    bare = whole.where(kind_of(F.col("_v")) == "array").select(*keep, F.lit("").alias("_list"), "_v")
    named = members(whole.where(kind_of(F.col("_v")) == "object"), "_v").where(kind_of(F.col("value")) == "array").select(*keep, F.col("key").alias("_list"), F.col("value").alias("_v"))
    items = members(bare.unionByName(named), "_v")
    of = lambda name: F.nullif(F.try_variant_get("value", f"$.{name}", "string"), F.lit(""))
    url = F.trim(F.when(kind_of(F.col("value")) == "object", F.coalesce(of("href"), of("url"), of("link"))).otherwise(F.try_variant_get("value", "$", "string")))
    rows = items.select(*keep, F.struct(F.col("_list").alias("list"), "pos").alias("place"), url.alias("url"))
    return rows.where(F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False)))
