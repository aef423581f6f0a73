"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents fall into cells of source x language x topic.  The cells' token sums are
raked: scaled in turn so that each marginal meets its targets, which add up to a stated
share of all tokens, round after round until nothing moves.  No cell is given more than it has, as a document can be
taken once at most; what small cells can't give, the other cells of a marginal make up for, and the
default targets ask no value for more than most of what it has.  A document is sampled with the
probability that takes its cell from what there is to what is wanted; a hash of its id decides.
``reached`` sets the marginals beside their targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialize

#: Most rounds of raking, and how many make one job; the change of a probability under which nothing moves any more.
ROUNDS, ROUNDS_A_JOB, STILL = 12, 4, 1e-9
#: The flattening exponent of the default targets, the share of all tokens to keep, and how much of a value's tokens a default target may ask for.
FLATTEN, KEEP, MOST = 0.7, 0.5, 0.9
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: legal notices, tables, markup and symbols, short notes, prose."""
    return (
        F.when(text.contains("License"), "legal")
        .when(text.contains(" | "), "table")
        .when(text.contains("@") | text.contains("#"), "marked")
        .when(F.length(text) < 600, "note")
        .otherwise("prose")
    )


def describe(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with the words of each whole text and its cell: a null source, language or topic is ``(none)``; ``topic`` takes the place of the topic by form."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.withColumns({"_mix_source": named("source"), "_mix_lang": named("lang"), "_mix_topic": topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("(none)")), "_mix_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})


def flattened_targets(cells: DataFrame, dimension: str, power: float = FLATTEN, keep: float = KEEP, most: float = MOST) -> DataFrame:
    """(value, target): the shares of a dimension's token sums raised to ``power``, none above ``most`` of what ``keep`` leaves room for.

    What rare values can't take is shared out among the others in proportion: one factor for all that are not held back, the
    largest that any number of the rarest, held back, gives.
    """
    sums = _beside_total(cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("_n")), F.sum("_n"))
    sums = sums.select("value", (F.col("_n") / F.col("_total")).alias("_p"))
    sums = sums.withColumns({"_w": F.pow("_p", F.lit(power)), "_cap": F.col("_p") * F.lit(most / keep)})
    sums = _beside_total(sums, F.sum("_w"))
    rarest = Window.orderBy("_p", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = sums.select("_total", F.sum("_cap").over(rarest).alias("_s"), F.sum("_w").over(rarest).alias("_c"))
    factor = F.when((F.col("_s") < 1) & (F.col("_total") - F.col("_c") > 1e-9), (1 - F.col("_s")) / (F.col("_total") - F.col("_c"))).otherwise(0.0)
    best = held.agg(F.greatest(F.max(factor), F.max(1 / F.col("_total"))).alias("_f")).withColumn("_one", F.lit(1))
    return sums.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one").select("value", F.least("_cap", F.col("_f") * F.col("_w")).alias("target"))


def _beside_total(df: DataFrame, aggregate: Column) -> DataFrame:
    """``df`` with one aggregate over all of it in ``_total``; that is one row, joined on a constant."""
    total = df.agg(aggregate.alias("_total")).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """``cells`` (dimensions..., tokens > 0) with ``weight`` up to tokens, whose marginals meet ``targets`` (value, target share)
    of ``keep`` times all tokens as far as there are tokens.

    Values without a target get weight 0.  Targets become columns once; each job is a few rounds and writes a table, so
    plans stay short.  A marginal is a window over cells, of which there are as many as
    values meet, however many documents: a task holds the cells of a value, not its documents.  Raking ends when no probability moves, after
    ``rounds`` at the latest.
    """
    start = _beside_total(cells, F.sum("tokens").cast("double")).withColumn("weight", F.col("tokens").cast("double"))
    for dimension, wanted in targets.items():
        share = wanted.select(F.col("value").alias(dimension), F.col("target").alias(f"_wanted_{dimension}"))
        start = start.join(share, dimension, "left").withColumn(f"_wanted_{dimension}", F.coalesce(f"_wanted_{dimension}", F.lit(0.0)) * keep * F.col("_total"))
    now = materialize(start.drop("_total"))
    done = 0
    while done < rounds:
        step = now
        for turn in range(min(ROUNDS_A_JOB, rounds - done)):
            if turn == min(ROUNDS_A_JOB, rounds - done) - 1:
                step = step.withColumn("_before", F.col("weight"))
            for dimension in targets:
                margin = F.sum("weight").over(Window.partitionBy(dimension))
                weight = F.least(F.col("weight") * F.coalesce(F.try_divide(F.col(f"_wanted_{dimension}"), margin), F.lit(0.0)), F.col("tokens").cast("double"))
                step = step.withColumn("weight", weight)
        done += min(ROUNDS_A_JOB, rounds - done)
        nxt = materialize(step)
        discard(now)
        now = nxt.drop("_before")
        now._scratch_path = nxt._scratch_path
        moved = nxt.agg(F.max(F.abs(F.col("weight") - F.col("_before")) / F.col("tokens")).alias("m")).first()["m"]
        if moved is None or moved < STILL:
            break
    return now


def reached(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, share) of ``rake``'s cells: what each marginal was to be and is."""
    out = None
    for dimension, wanted in targets.items():
        part = _beside_total(raked.groupBy(F.col(dimension).alias("value")).agg(F.sum("weight").alias("_w")), F.sum("_w"))
        part = part.join(wanted, "value", "left").select(F.lit(dimension).alias("dimension"), "value", F.coalesce("target", F.lit(0.0)).alias("target"), F.try_divide("_w", "_total").alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


def default_targets(cells: DataFrame, keep: float = KEEP) -> dict[str, DataFrame]:
    return {d: materialize(flattened_targets(cells, d, keep=keep)) for d in DIMENSIONS}


def token_cells(described: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of ``describe``'s rows that have tokens."""
    keys = [F.col(f"_mix_{d}").alias(d) for d in DIMENSIONS]
    return described.where("_mix_tokens > 0").groupBy(*keys).agg(F.sum("_mix_tokens").alias("tokens"))


def probabilities(described: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, probability) per cell of ``describe``'s rows that has tokens."""
    cells = materialize(token_cells(described))
    raked = rake(cells, targets or default_targets(cells, keep), rounds, keep)
    return materialize(raked.select(*DIMENSIONS, F.round(F.col("weight") / F.col("tokens"), 6).alias("probability")))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone, the same at every run and size; a null id draws as an empty one."""
    head = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, lang and any others) with ``_mix_source``, ``_mix_lang``, ``_mix_topic``, ``_mix_tokens``,
    ``_mix_probability`` and ``_mix_kept``.

    A null source or language is the value ``(none)``; a text without a word has probability 1, as it weighs
    nothing; rows of one doc_id and cell are drawn together.  ``targets`` gives (value, target share) per dimension,
    by default each dimension's token shares to the power 0.7; a cell without a target goes.  About ``keep`` of all tokens
    stay, less where small cells fall short.  ``topic`` names a topic per row, by default one by form.  An empty table gives no rows.
    """
    return _drawn(describe(docs, topic), docs.columns, targets, rounds, keep)


def _drawn(described: DataFrame, columns: Sequence[str], targets: dict[str, DataFrame] | None, rounds: int, keep: float) -> DataFrame:
    cells = probabilities(described, targets, rounds, keep).select(*(F.col(d).alias(f"_mix_{d}") for d in DIMENSIONS), "probability")
    out = described.join(cells, [f"_mix_{d}" for d in DIMENSIONS], "left")
    out = out.withColumn("_mix_probability", F.when(F.col("_mix_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(1.0)))
    return out.withColumn("_mix_kept", draw(F.col("doc_id")) < F.col("_mix_probability")).select(*columns, *(f"_mix_{c}" for c in (*DIMENSIONS, "tokens", "probability", "kept")))


def mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of every row; the texts are read once."""
    described = materialize(describe(docs.select("doc_id", "text", "source", "lang")).drop("text", "source", "lang"))
    m = _drawn(described, ["doc_id"], targets, rounds, keep)
    return m.select("doc_id", *(F.col(f"_mix_{d}").alias(d) for d in DIMENSIONS), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_probability").alias("probability"), F.col("_mix_kept").alias("kept"))


def mixture_sql(rounds: int = ROUNDS, power: float = FLATTEN, keep: float = KEEP, most: float = MOST) -> str:
    """DuckDB SQL for ``mixture`` of the view ``documents``."""
    topic = "CASE WHEN contains(t, 'License') THEN 'legal' WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '@') OR contains(t, '#') THEN 'marked' WHEN length(t) < 600 THEN 'note' ELSE 'prose' END"
    steps = [
        "d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang FROM documents)",
        f"s AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM d)",
        "w0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM s WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(f"p_{d} AS (SELECT {d}, p, pow(p, {power}) AS w, p * {most / keep!r} AS cap FROM (SELECT {d}, sum(tokens) / (SELECT sum(tokens) FROM w0) AS p FROM w0 GROUP BY {d}))")
        steps.append(f"h_{d} AS (SELECT sum(cap) OVER o AS s, sum(w) OVER o AS c, sum(w) OVER () AS t FROM p_{d} WINDOW o AS (ORDER BY p, {d} ROWS UNBOUNDED PRECEDING))")
        steps.append(f"f_{d} AS (SELECT greatest(max(1 / t), max(CASE WHEN s < 1 AND t - c > 1e-9 THEN (1 - s) / (t - c) ELSE 0 END)) AS f FROM h_{d})")
        steps.append(f"g_{d} AS (SELECT {d}, least(cap, f * w) * {keep} * (SELECT sum(tokens) FROM w0) AS target FROM p_{d}, f_{d})")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"w{n + 1} AS (SELECT source, lang, topic, tokens, least(weight * target / sum(weight) OVER (PARTITION BY {d}), tokens) AS weight FROM w{n} JOIN g_{d} USING ({d}))")
            n += 1
    steps.append(f"p AS (SELECT source, lang, topic, round(weight / tokens, 6) AS probability FROM w{n})")
    body = "SELECT doc_id, source, lang, topic, n_tokens, CASE WHEN n_tokens > 0 THEN probability ELSE 1.0 END::DOUBLE AS probability FROM s LEFT JOIN p USING (source, lang, topic)"
    number = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE"
    return f"WITH {', '.join(steps)} SELECT *, {number} / {float(16**13)!r} < probability AS kept FROM ({body})"
