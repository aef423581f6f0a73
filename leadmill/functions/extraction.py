"""Address extraction as one chain of expressions: undo disguises, find candidates, clean, decode, check.

Only entities need Python: they alone go there, and only of texts that hold an ampersand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import email as E
from leadmill.functions.domain import domains_match
from leadmill.functions.idna import ENTITY, entities_undone
from leadmill.functions.text import blank_to_null

ADDRESS = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
# Fixed values of the extraction rules.
ZERO_WIDTH = r"[\u200B-\u200D\uFEFF\u00AD]"
MAILTO = r"""(?i)mailto:([^"'\s<>]+)"""
DISGUISES = [
    (r"\s*\[\s*at\s*\]\s*", "@"), (r"\s*\(\s*at\s*\)\s*", "@"), (r"\s+at\s+", "@"), (r"\s*\{\s*at\s*\}\s*", "@"),
    (r"\s*\[\s*dot\s*\]\s*", "."), (r"\s*\(\s*dot\s*\)\s*", "."), (r"\s+dot\s+", "."), (r"\s*\{\s*dot\s*\}\s*", "."),
    (r"\s*\[\s*punkt\s*\]\s*", "."), (r"\s*\(\s*punkt\s*\)\s*", "."), (r"\s+punkt\s+", "."),
]
BOUNDARY = r"""[ \t\r\n<>"'()\[\]{}.,;:!?]+"""
MAX_EMAILS, LEAST_QUALITY = 5, 50
# Fixed values of the older rules: their pattern, the words for @ and ., asset endings, a decoy.
OLD_ADDRESS = r"(?<![\w@])([a-zA-Z0-9._%+\-]{1,64}@(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,})(?![\w@])"
OLD_AT = r"\s*(?:\(|\[)?\s*(?:at|AT)\s*(?:\)|\])?\s*"
OLD_DOT = r"\s*(?:\(|\[)?\s*(?:dot|DOT)\s*(?:\)|\])?\s*"
OLD_ASSETS = ["jpg", "jpeg", "png", "webp", "avif", "gif", "svg", "bmp", "ico", "css", "js", "map", "woff", "woff2", "ttf", "eot"]
SPAM_TRAP = r"(?i)(\b[a-zA-Z0-9._%+\-]{1,64})\s*@spamverhindern\.de\s*@\s*"


#: A text without this has no disguised sign: the word of one behind a bracket or blank and before one.
SPELT = r"(?i)[\s\[({](?:at|dot|punkt)[\s\])}]"

#: Without one of these no address can come out of a text: the sign, an entity, a link, at as a word, or something invisible in between.
SIGN = r"(?i)@|&|mailto:|[\s\[({]at[\s\])}]|" + ZERO_WIDTH


def may_hold_address(text: Column) -> Column:
    """A cheap look at a text before all else: false only where there is no address, disguised or not."""
    return F.coalesce(text.rlike(SIGN), F.lit(False))


def unescaped(text: Column) -> Column:
    """Entities undone; no text reaches Python, only the entities of those with an ampersand."""
    some = text.contains("&")
    plain = entities_undone(F.when(some, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))))
    # The pieces between entities are one more than these.
    whole = F.zip_with(F.split(text, ENTITY, -1), plain, lambda piece, sign: F.concat(piece, F.coalesce(sign, F.lit(""))))
    return F.when(some, F.array_join(whole, "")).otherwise(text)


def undisguised(text: Column) -> Column:
    """Zero-width characters out, line breaks to blanks, at and dot in words to signs; empty for NULL.  Entities are undone before."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), ZERO_WIDTH, "")
    c = F.translate(c, "\r\n", "  ")
    # One look for any of the words beside a bracket or a blank; most texts have none and are spared the replacements.
    spelt = reduce(lambda c, p: F.regexp_replace(c, f"(?i){p[0]}", p[1]), DISGUISES, c)
    return F.when(c.rlike(SPELT), spelt).otherwise(c)


def cleaned(address: Column) -> Column:
    """Lower case, without the brackets, quotes and punctuation around it."""
    return F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), f"^{BOUNDARY}|{BOUNDARY}$", "")


def percent_decoded(text: Column) -> Column:
    """%xx undone, plus signs kept; a malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def between(text: Column, start: str, end: str) -> Column:
    """What stands between each pair of markers, the shortest, in order."""
    quoted = [f"\\Q{m}\\E" for m in (start, end)]
    t = F.coalesce(text, F.lit(""))
    # Up to the last end alone: each start after it would be read to the end of the text.
    ended = F.left(t, F.length(t) - F.length(F.substring_index(t, end, -1)))
    found = F.regexp_extract_all(ended, F.lit(f"(?s){quoted[0]}(.*?){quoted[1]}"), F.lit(1))
    return F.when(t.contains(start) & t.contains(end), found).otherwise(F.array().cast("array<string>"))


def plausible(address: Column) -> Column:
    return F.coalesce(E.reason(address).isNull() & ~address.rlike(r"[/\\]"), F.lit(False))


def mailto(text: Column) -> Column:
    """Targets of mailto links: without their query, decoded, the address in them if there is one."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MAILTO), F.lit(1))
    targets = F.transform(found, lambda t: F.trim(percent_decoded(F.substring_index(t, "?", 1))))
    first = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, ADDRESS, 0), F.lit("")), t)
    return F.transform(F.filter(targets, lambda t: t != ""), first)


def addresses(normalized: Column, distinct: bool = True) -> Column:
    """Plausible addresses of a text whose disguises are undone: mailto targets first, then in order."""
    candidates = F.concat(mailto(normalized), F.regexp_extract_all(normalized, F.lit(ADDRESS), F.lit(0)))

    def read(c: Column) -> Column:
        whole = cleaned(c)
        decoded = F.transform(F.regexp_extract_all(percent_decoded(whole), F.lit(ADDRESS), F.lit(0)), cleaned)
        plain = F.coalesce(F.nullif(F.lower(F.regexp_extract(whole, ADDRESS, 0)), F.lit("")), whole)
        return F.when(whole.contains("%"), decoded).otherwise(F.array(plain))

    out = F.filter(F.flatten(F.transform(candidates, read)), plausible)
    # Most texts have neither sign, and need no search.
    some = normalized.contains("@") | F.lower(normalized).contains("mailto:")
    return F.when(some, F.array_distinct(out) if distinct else out).otherwise(F.array().cast("array<string>"))


def spots(normalized: Column) -> Column:
    """[(email, start, end)] of each address as it stands, start from 1 and end behind it."""
    matches = F.regexp_extract_all(normalized, F.lit(ADDRESS), F.lit(0))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<email:string,start:int,end:int>>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        start = F.call_function("locate", m, normalized, state["at"])
        end = start + F.length(m)
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(F.lower(m).alias("email"), start.alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(matches, begin, step, lambda s: s["out"])


def in_context(normalized: Column, chars: int = 50) -> Column:
    """[(email, context)]: each plausible address with ``chars`` characters on both sides."""
    found = F.filter(spots(normalized), lambda s: plausible(s["email"]))
    left = lambda s: F.greatest(F.lit(1), s["start"] - chars)
    return F.transform(found, lambda s: F.struct(s["email"].alias("email"), F.trim(F.substr(normalized, left(s), s["end"] + chars - left(s))).alias("context")))


def near_words(normalized: Column, words: list[str], distance: int = 100) -> Column:
    """Plausible addresses with one of ``words`` at most ``distance`` characters away."""
    low = F.lower(normalized)
    longest = max(map(len, words))
    wanted = "|".join(f"\\Q{w.lower()}\\E" for w in words)

    def near(s: Column) -> Column:
        # A word that begins in the reach before, inside or behind; one that ends in the reach may begin a word's length earlier.
        a = F.greatest(F.lit(1), s["start"] - distance - longest)
        before, behind = F.substr(low, a, s["start"] - a), F.substr(low, s["end"], F.lit(distance + longest))
        tail = [before.rlike(f"(?s)(\\Q{w.lower()}\\E).{{0,{distance}}}$") for w in words]
        head = [behind.rlike(f"(?s)^.{{0,{distance}}}(\\Q{w.lower()}\\E)") for w in words]
        return reduce(lambda x, y: x | y, [*tail, *head, s["email"].rlike(wanted)])

    return F.array_distinct(F.transform(F.filter(spots(low), lambda s: plausible(s["email"]) & near(s)), lambda s: s["email"]))


# -- lists of addresses ------------------------------------------------------------------


def distinct_without_case(items: Column) -> Column:
    """The first spelling of each item, in order."""
    key = lambda x: F.lower(F.trim(x))
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def kept(emails: Column, system: bool = True, assets: bool = True, generic: bool = False) -> Column:
    """Addresses that no rule takes out."""
    bad = lambda e: (F.lit(system) & E.is_system(e)) | (F.lit(assets) & E.is_asset(e)) | (F.lit(generic) & E.is_free_mail(e)) | (e == "")
    return F.filter(emails, lambda e: ~F.coalesce(bad(e), F.lit(True)))


def in_domains(emails: Column, allowed: Column | None = None, blocked: Column | None = None) -> Column:
    """Addresses of allowed domains (NULL allows all) that are not blocked."""
    dom = E.domain_part
    ok = lambda e: F.lit(True) if allowed is None else F.coalesce(F.array_contains(allowed, dom(e)), allowed.isNull())
    bad = lambda e: F.lit(False) if blocked is None else F.coalesce(F.array_contains(blocked, dom(e)), F.lit(False))
    return F.filter(emails, lambda e: (dom(e) != "") & ok(e) & ~bad(e))


def preferring(emails: Column, company_domain: Column) -> Column:
    """Those of the company's domain if there are any, else all."""
    own = F.filter(emails, lambda e: domains_match(E.domain_part(e), company_domain))
    return F.when(F.size(own) > 0, own).otherwise(emails)


def good_enough(emails: Column, least: int = LEAST_QUALITY) -> Column:
    return F.filter(emails, lambda e: E.quality(e) >= least)


def standard_filters(emails: Column, company_domain: Column | None = None) -> Column:
    """Distinct, no system or asset address, quality, then the company's own if there are any."""
    out = good_enough(kept(distinct_without_case(emails)))
    return out if company_domain is None else preferring(out, company_domain)


# -- the older rules -----------------------------------------------------------------------


def old_asset(e: Column) -> Column:
    """File names that look like addresses."""
    dom, local = F.substring_index(e, "@", -1), F.regexp_replace(e, "@[^@]*$", "")
    return ~e.contains("@") | F.substring_index(dom, ".", -1).isin(OLD_ASSETS) & dom.contains(".") | local.rlike("@[23]x") | dom.rlike(r"\.[0-9a-f]{6,}$") | ~dom.rlike("[a-zA-Z]")


def old_addresses(text: Column) -> Column:
    """mailto, plain, at-dot and at-only addresses, rot13 undone, assets out; entities are undone before."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), SPAM_TRAP, "$1@")
    links = F.transform(F.regexp_extract_all(c, F.lit(r"""(?i)mailto:\s*([^"'\s>?]+)"""), F.lit(1)), lambda t: F.substring_index(percent_decoded(t), "?", 1))
    links = F.filter(links, lambda t: t.contains("@"))
    plain = F.regexp_extract_all(c, F.lit(OLD_ADDRESS), F.lit(1))
    parts = lambda p, n: [F.regexp_extract_all(c, F.lit(p), F.lit(i)) for i in range(1, n + 1)]
    local = r"([a-zA-Z0-9._%+\-]{1,64})"
    a, b, t = parts(local + OLD_AT + r"([a-zA-Z0-9.\-]+)" + OLD_DOT + "([a-zA-Z]{2,})", 3)
    dotted = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), t.alias("t")), lambda z: F.concat(z["a"], F.lit("@"), z["b"], F.lit("."), z["t"]))
    a, b = parts(local + OLD_AT + r"((?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,})", 2)
    spoken = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.concat(z["a"], F.lit("@"), z["b"]))
    found = F.transform(F.concat(links, plain, dotted, spoken), E.rot13)
    return F.array_distinct(F.filter(found, lambda e: (e != "") & ~old_asset(e)))


def outreach_score(email: Column, prefer: Column) -> Column:
    """Whom to write to: the own domain over others, partners over sales over greetings, no system, public or personal address."""
    local, dom = E.local_part(email), F.regexp_replace(email, "^[^@]*@", "")
    bare = lambda d: F.regexp_replace(F.lower(d), r"^www\.", "")
    wanted = F.coalesce(bare(F.trim(prefer)), F.lit(""))
    same = (bare(dom) == wanted) | F.endswith(bare(dom), F.concat(F.lit("."), wanted))
    return (
        F.when(wanted == "", 0).when(same, 80).otherwise(-40)
        + F.when(local.isin("partners", "partnerships"), 25).when(local.isin("sales", "bizdev", "business", "bd"), 20).when(local.isin("hello", "hi"), 15).when(local.isin("info", "contact", "support"), 10).otherwise(0)
        - F.when(local.isin("abuse", "webmaster", "postmaster", "noreply", "no-reply", "donotreply", "do-not-reply", "privacy", "legal", "security"), 50).otherwise(0)
        - F.when(dom.isin("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com"), 15).otherwise(0)
        - F.when(local.rlike(r"\d|\."), 2).otherwise(0)
    )


def best_outreach(emails: Column, prefer: Column) -> Column:
    """The address with the highest outreach score, the first of equals; NULL if there is none."""
    usable = F.filter(F.transform(emails, lambda e: F.lower(F.trim(e))), lambda e: e.contains("@"))
    scored = F.transform(usable, lambda e, i: F.struct(outreach_score(e, prefer).alias("s"), (-i).alias("i"), e.alias("e")))
    return F.array_max(scored)["e"]


# -- pages ---------------------------------------------------------------------------------


def page_text(first: Column, second: Column) -> Column:
    """The trimmed first text that is not blank; empty if neither has any."""
    return F.coalesce(blank_to_null(first), blank_to_null(second), F.lit(""))


def page_emails(pages: DataFrame, most: int | None = None) -> DataFrame:
    """``pages`` (domain, url, final_url, page_type, cleaned_html, markdown; others stay) with ``emails``: what stage one stores, perhaps empty.

    Whole texts are read, or their first ``most`` characters where that is given.
    """
    text = page_text(F.col("cleaned_html"), F.col("markdown"))
    text = text if most is None else F.substring(text, 1, most)
    d = pages.withColumn("_text", unescaped(text))
    return d.withColumn("_text", undisguised(F.col("_text"))).withColumn("emails", standard_filters(addresses(F.col("_text")))).drop("_text")


def asset_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.trim(url)).rlike(r"\.(" + "|".join(E.ASSET_TLDS) + ")$"), F.lit(False))


def emails_of_domains(pages: DataFrame, most: int = MAX_EMAILS) -> DataFrame:
    """(domain, rank, email, source_url, score): the best addresses of each domain over all of its pages.

    An address counts on its page of highest priority, the smallest URL of equals.  Only texts of pages that are no assets are read; the
    company's own addresses push out others where there are any; equal scores go by address.
    """
    url = F.coalesce(blank_to_null(F.col("final_url")), "url", F.lit(""))
    d = pages.withColumn("_url", url).where(~asset_url(F.col("_url"))).withColumn("_text", unescaped(F.trim(F.coalesce("cleaned_html", F.lit("")))))
    d = d.where(may_hold_address(F.col("_text"))).withColumn("_text", undisguised(F.col("_text")))
    # An outer explode, as Spark would add a filter on the list to an inner one, and make the list twice.
    d = d.select("domain", "_url", F.lower(F.trim("page_type")).alias("page_type"), F.explode_outer(addresses(F.col("_text"))).alias("email")).where("email is not null")
    d = d.where(~E.is_system(F.col("email")) & ~E.is_asset(F.col("email")) & (E.quality(F.col("email")) >= LEAST_QUALITY))
    best = d.withColumn("_p", E.page_priority(F.col("page_type"))).groupBy("domain", "email").agg(F.min_by(F.struct("_url", "page_type"), F.struct(-F.col("_p"), "_url", "page_type")).alias("b"))
    own = domains_match(E.domain_part(F.col("email")), F.col("domain"))
    any_own = best.groupBy("domain").agg(F.max(own).alias("any_own"))
    best = best.join(any_own, "domain").where(own | ~F.col("any_own")).withColumn("score", E.priority(F.col("email"), F.col("b.page_type"), F.col("domain")))
    from leadmill.operators.select import top_n

    return top_n(best, ["domain"], [F.desc("score"), F.asc("email")], most).select("domain", "rank", "email", F.col("b._url").alias("source_url"), "score")
