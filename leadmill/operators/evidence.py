"""Values found on pages, grouped with their evidence, and what is selected from them.

A group's evidence stays in rows, ranked: nothing is collected, so a value that a million pages name
is a sort, not an array.  Group figures are partial aggregates, joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions import email as E
from leadmill.functions import text as T
from leadmill.operators.select import guardrail, top_n

PAGE = ["url", "page_type", "seq"]
#: The order of page types and the raw scores that make confidence 0 and 1.
PAGE_TYPES = {"impressum": 0, "contact": 1, "privacy": 2, "home": 3, "other": 4}
EMAIL_RANGE, COMPANY_RANGE = (0, 155), (60, 155)


def grouped(found: DataFrame, keys: Sequence[str], impressum_first: bool = True) -> DataFrame:
    """(keys, key, value, value_rank, evidence_rank, url, page_type, quote) of ``found`` (keys, key, value, url, page_type, seq, pos, quote).

    The value is the first spelling by (seq, pos); values with evidence on an impressum come first if ``impressum_first``, and so does
    that evidence.  A value without evidence (a null quote) has one row without any.  Null keys are keys; no rows give none.
    """
    at, imp = F.struct("seq", "pos"), (F.col("page_type") == "impressum") & F.col("quote").isNotNull()
    groups = found.groupBy(*keys, "key").agg(F.min_by("value", at).alias("value"), F.min(at).alias("_first"), F.max(F.coalesce(imp, F.lit(False))).alias("_imp"))
    first = [F.desc("_imp")] if impressum_first else []
    groups = groups.withColumn("value_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*first, "_first", "key"))).drop("_first", "_imp")
    order = [F.col("page_type") != "impressum"] if impressum_first else []
    e = found.where("quote is not null").drop("value")
    e = e.withColumn("evidence_rank", F.row_number().over(Window.partitionBy(*keys, "key").orderBy(*order, "seq", "pos"))).drop("seq", "pos")
    same = [groups[c].eqNullSafe(e[c]) for c in (*keys, "key")]
    out = groups.join(e, same, "left")
    return out.select(*(groups[c] for c in (*keys, "key")), "value", "value_rank", "evidence_rank", "url", "page_type", "quote")


def _quote(evidence: Column) -> Column:
    """The quote of an evidence object, empty if it has none; NULL without an object."""
    return F.when(evidence.isNotNull(), F.coalesce(evidence["quote"], F.lit("")))


def companies(pages: DataFrame, keys: Sequence[str], column: str = "company_json") -> DataFrame:
    """Names (or descriptions) of pages as rows for ``grouped``: {value, evidence: {quote}}; a value without evidence is none."""
    v = F.from_json(column, "value string, evidence struct<quote:string>")
    d = pages.select(*keys, *PAGE, v.alias("v")).where("v.value is not null and v.value <> '' and v.evidence is not null")
    return d.select(*keys, F.lower(F.trim("v.value")).alias("key"), F.trim("v.value").alias("value"), *PAGE, F.lit(0).alias("pos"), _quote(F.col("v.evidence")).alias("quote"))


def emails(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Addresses of pages as rows for ``grouped``: [{email, evidence: {quote}}]."""
    items = F.from_json("emails_json", "array<struct<email:string,evidence:struct<quote:string>>>")
    d = pages.select(*keys, *PAGE, F.posexplode(items).alias("pos", "v")).where("v.email is not null and v.email <> ''")
    email = F.lower(F.trim("v.email"))
    return d.select(*keys, email.alias("key"), email.alias("value"), *PAGE, "pos", _quote(F.col("v.evidence")).alias("quote"))


def plain_emails(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Addresses of pages as rows for ``grouped``: ["email"]; the first spelling on a page and type is its evidence."""
    d = pages.select(*keys, *PAGE, F.posexplode(F.from_json("emails_json", "array<string>")).alias("pos", "v")).where("v is not null and v <> ''")
    email = F.lower(F.trim("v"))
    d = d.groupBy(*keys, email.alias("key"), "url", "page_type").agg(F.min(F.struct("seq", "pos", "v")).alias("f"))
    return d.select(*keys, "key", F.col("key").alias("value"), "url", "page_type", F.col("f.seq").alias("seq"), F.col("f.pos").alias("pos"), F.col("f.v").alias("quote"))


def contacts(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """People of pages as rows for ``grouped``: [{name, role, evidence}]; the same name in another role is another contact.

    The value is ``name (role)``, or the name where there is no role.
    """
    items = F.from_json("contacts_json", "array<struct<name:string,role:string,evidence:struct<quote:string>>>")
    d = pages.select(*keys, *PAGE, F.posexplode(items).alias("pos", "v")).where("v.name is not null and v.name <> ''")
    name, role = F.trim("v.name"), F.trim(F.coalesce("v.role", F.lit("")))
    shown = F.when(F.coalesce("v.role", F.lit("")) == "", name).when(role == "", name).otherwise(F.concat(name, F.lit(" ("), role, F.lit(")")))
    return d.select(*keys, F.concat(name, F.lit("\n"), F.lower(role)).alias("key"), shown.alias("value"), *PAGE, "pos", _quote(F.col("v.evidence")).alias("quote"))


def joined_values(groups: DataFrame, keys: Sequence[str], separator: str = ", ") -> DataFrame:
    """(keys, text): all values of a key in order; the list of one key's distinct values must fit in a row."""
    d = groups.select(*keys, "value_rank", "value").distinct()
    listed = F.array_sort(F.collect_list(F.struct("value_rank", "value")))
    return d.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["value"]), separator).alias("text"))


def first_value(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return groups.where("value_rank = 1").select(*keys, "value").distinct()


def select_emails(llm: DataFrame, det: DataFrame, keys: Sequence[str], domain: str) -> DataFrame:
    """(keys, rank, email, raw, support, page_type, score, selected) of all addresses of both sources.

    ``llm`` and ``det`` are rows of ``emails`` and ``plain_emails``.  Evidence counts once per (url, page type); the best is the first
    by raw score, impressum, support, both sources, address, unless one of an impressum is within 15 of it.
    """
    tagged = lambda d, s: d.select(*keys, E.normalize_email(F.col("key")).alias("email"), "url", "page_type", F.col("quote").isNotNull().alias("seen"), F.lit(s).alias("source"))
    d = tagged(llm, "llm").unionByName(tagged(det, "det")).where(F.col("email").contains("@"))
    place = F.when(F.col("seen"), F.struct("url", F.coalesce("page_type", F.lit("other")).alias("page_type")))
    per = d.groupBy(*keys, "email", place.alias("place")).agg(F.max(F.col("source") == "llm").alias("l"), F.max(F.col("source") == "det").alias("d"))
    ranks = F.create_map(*(F.lit(x) for kv in PAGE_TYPES.items() for x in kv))
    at = F.coalesce(F.try_element_at(ranks, F.col("place.page_type")), F.lit(99))
    c = per.groupBy(*keys, "email").agg(
        F.count("place").alias("support"), F.coalesce(F.max(F.col("place.page_type") == "impressum"), F.lit(False)).alias("impressum"), (F.max("l") & F.max("d")).alias("both"),
        F.coalesce(F.min_by("place.page_type", F.when(F.col("place").isNotNull(), F.struct(at.alias("r"), F.col("place.page_type")))), F.lit("other")).alias("page_type"),
    )
    c = c.withColumn("raw", E.candidate_score(F.col("email"), F.col("impressum"), F.col("support"), F.col("both"), F.col(domain)))
    order = [F.desc("raw"), F.desc("impressum"), F.desc("support"), F.desc("both"), F.asc("email")]
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    best = guardrail(c, keys, "raw", F.col("impressum"), [F.asc("rank")]).select(*keys, F.col("email").alias("_best"))
    c = c.join(best, list(keys))
    return c.select(*keys, "rank", "email", "raw", "support", "page_type", E.confidence(F.col("raw"), *EMAIL_RANGE).alias("score"), (F.col("email") == F.col("_best")).alias("selected"))


def select_company(groups: DataFrame, organizations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, company, raw, page_type, score): the best name of each key.

    ``groups`` is ``grouped`` names, ``organizations`` (keys, organization).  A name counts with its first evidence's page; order: raw
    score, impressum, longer name, first seen; a name of an impressum within 15 of the best wins.
    """
    d = groups.where("evidence_rank = 1").join(organizations, list(keys), "left")
    d = d.withColumn("raw", T.company_score(F.col("page_type"), F.col("value"), F.col("organization")))
    imp = F.col("page_type") == "impressum"
    order = [F.desc(imp), F.desc(F.length("value")), F.asc("value_rank")]
    best = guardrail(d, keys, "raw", imp, order)
    return best.select(*keys, F.col("value").alias("company"), "raw", F.coalesce("page_type", F.lit("unknown")).alias("page_type"), E.confidence(F.col("raw"), *COMPANY_RANGE).alias("score"))


def vote_structs(votes: DataFrame, keys: Sequence[str], voter: str, items: str, default: str, wins: int = 2) -> DataFrame:
    """(keys, position, name, value): lists of objects voted on field by field.

    ``items`` is array<map<string,string>>.  The result has the default voter's length; at each position a field gets the value that ``wins`` voters
    share (without case and blanks; the first voter's spelling, the earliest group of equals), else the default voter's.
    """
    d = votes.select(*keys, F.col(voter).alias("_v"), F.posexplode(items).alias("position", "_m"))
    names = d.select(*keys, "position", F.explode(F.map_keys("_m")).alias("name")).distinct()
    length = votes.where(F.col(voter) == default).groupBy(*keys).agg(F.max(F.size(items)).alias("_n"))
    cells = names.join(length, list(keys)).where("position < _n").drop("_n").join(d, [*keys, "position"])
    # A voter that has the object but not the field votes for none.
    cells = cells.withColumn("value", F.try_element_at("_m", F.col("name")))
    canon = T.canonical(F.coalesce("value", F.lit("None")))
    counted = cells.groupBy(*keys, "position", "name", canon.alias("_c")).agg(F.count("*").alias("_n"), F.min("_v").alias("_f"), F.min_by("value", "_v").alias("_w"))
    won = counted.where(F.col("_n") >= wins).groupBy(*keys, "position", "name").agg(F.min_by("_w", "_f").alias("_w"))
    own = cells.where(F.col("_v") == default).select(*keys, "position", "name", F.col("value").alias("_own"))
    out = names.join(length, list(keys)).where("position < _n").join(won, [*keys, "position", "name"], "left").join(own, [*keys, "position", "name"], "left")
    return out.select(*keys, "position", "name", F.coalesce("_w", "_own").alias("value"))


def best_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "_n").drop("_n")
