"""How a chain of filters interacts: failure masks, their histogram, and every order read off its cells.

Each filter is a Boolean column that is true where a document fails it.  The columns of one document are
bits of a mask; the histogram counts documents per part and mask, 2^n cells a part however many
documents there are.  A filter f applied after a set S of others removes the cells whose mask has f and
nothing of S, so all orders are sums over cells: n * 2^(n-1) pairs (S, f) a part cover the n! orders.

Main path: DataFrame functions alone.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import materialize

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII blanks; none of a blank text."""
    return F.array_remove(F.split(F.btrim(text, F.lit(BLANKS)), "[ \\t-\\r]+"), F.lit(""))


def quality_conditions(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions by letter: A short, B repetitive, C shouting, D marks of code or tables."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def text_marks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest, good, toxic) of every row of ``docs``; a table in the shared folder, some 60 bytes a row.

    A text is known by its SHA-256 from here on.  ``mask`` has the conditions that a text meets by itself, lowest bit first.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    d = d.withColumn("words", words_of(F.col("text")))
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(quality_conditions(F.col("text"), F.col("words")).values())]
    d = d.select("doc_id", "part", sum(bits[1:], bits[0]).cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    return materialize(d.join(said, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}))


def with_repeat_bit(marks: DataFrame, bit: int) -> DataFrame:
    """``marks`` with ``bit`` set in the mask of rows whose text also has a smaller doc_id.

    The smallest doc_id per text is grouped, with partial aggregation for texts that are everywhere; only
    texts of more than one row are joined back.  A null doc_id is smaller than none: its row fails where any row with an id has the text.
    """
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("first") < F.col("doc_id")))
    return marks.join(first, "digest", "left").withColumn("mask", F.col("mask") + F.when(F.coalesce(later, F.lit(False)), 1 << bit).otherwise(0)).drop("first")


def histogram(masks: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 2^filters cells a part."""
    return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, with zeros, from the cells of ``histogram``.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): kept is what is left after
    the step, redundant what fails its filter but went earlier, unique_fails what fails no other filter, shapley the
    filter's removals summed over all orders.  No cells give no rows.
    """
    n = len(letters)
    bit = {c: 1 << i for i, c in enumerate(letters)}
    pairs = [(before, f) for f in bit.values() for before in range(1 << n) if not before & f]
    pair = F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit(math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())).alias("weight")) for s, f in pairs))).alias("p")
    met = cells.select("part", "mask", "n", "good", "toxic", pair).select("part", "mask", "n", "good", "toxic", "p.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("filter")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0))
    counts = met.groupBy("part", "before", "filter", "weight").agg(
        total(~gone & ~fails).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("filter")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    each = Window.partitionBy("part", "filter")  # 2^(n-1) rows
    counts = counts.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(each)).drop("weight")
    steps = [("".join(o), i + 1, sum(bit[c] for c in o[:i]), bit[c]) for o in itertools.permutations(letters) for i, c in enumerate(o)]
    orders = cells.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    return orders.join(counts, ["before", "filter"]).drop("before", "filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of five filters on ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).

    A to D are ``quality_conditions``; E fails a text that a smaller doc_id has too.  A null text is empty, a null lang the
    part ''; a doc_id that repeats is a document each time, rows of one doc_id with one text are none the other's copy, several labels of a
    doc_id count as 1 if one of them is; other columns are ignored.  An empty table gives no rows.
    """
    return interactions(histogram(with_repeat_bit(text_marks(docs, labels), 4)), "ABCDE")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < w.doc_id OR (w.doc_id IS NULL AND first IS NOT NULL), false) AS e
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
),
fails AS (SELECT part, good, toxic, list_concat(CASE WHEN a THEN ['A'] ELSE [] END, CASE WHEN b THEN ['B'] ELSE [] END, CASE WHEN c THEN ['C'] ELSE [] END, CASE WHEN d THEN ['D'] ELSE [] END, CASE WHEN e THEN ['E'] ELSE [] END) AS bad FROM f),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)
),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS letter, string_split(left(filter_order, s - 1), '') AS before FROM orders, range(1, 6) r(s)),
g AS (SELECT part, good, toxic, bad, count(*) AS n FROM fails GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN list_has_any(bad, before) OR list_contains(bad, letter) THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN list_contains(bad, letter) AND NOT list_has_any(bad, before) THEN n ELSE 0 END) AS removed, sum(CASE WHEN list_contains(bad, letter) AND list_has_any(bad, before) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bad = [letter] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN good AND list_contains(bad, letter) AND NOT list_has_any(bad, before) THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN toxic AND list_contains(bad, letter) AND NOT list_has_any(bad, before) THEN n ELSE 0 END) AS toxic_lost
  FROM g, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
