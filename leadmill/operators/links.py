"""Links of captured pages: found by tier, resolved, filtered, scored and chosen; contact cases.

Regular expressions over whole pages give rows; only joining a relative link to its page needs Python, and only
for links that are not absolute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.domain import host, page_type, same_site
from leadmill.functions.extraction import unescaped
from leadmill.functions.idna import url_join
from leadmill.functions.text import visible_text
from leadmill.operators.select import top_n

ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
BUTTON = r"(?is)<button\b[^>]*\bonclick\s*=\s*([\"'])(.*?)\1[^>]*>(.*?)</button>"
SCRIPTED = r"(?is)<a\b[^>]*\bonclick\s*=\s*([\"'])(.*?)\1[^>]*>(.*?)</a>"
GOES_TO = r"(?i)(?:location(?:\.href)?|window\.location|document\.location)\s*=\s*['\"]([^'\"]+)['\"]"
OPENS = r"(?i)(?:location(?:\.href)?\s*=|window\.open\s*\(|fetch\s*\(|\.load\s*\(|openModal\s*\()\s*[\"']([^\"']+)[\"']"
# Words of link texts and of URLs, endings that are no pages, scores of words in URLs.
KINDS = {
    "impressum": r"\b(impressum|imprint)\b", "contact": r"\b(kontakt|contact(\s*us)?|contact-us)\b", "privacy": r"\b(legal(\s*notice)?|datenschutz|datenschutzerkl[aä]rung|privacy(\s*policy)?)\b",
    "about": r"\b(ueber\s*uns|über\s*uns|ueber|about(\s*us)?)\b",
}
IN_URL = {"impressum": "impressum|imprint", "privacy": "datenschutz|privacy", "contact": "kontakt|contact", "about": "about|ueber|über|uber"}
DENIED = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".zip", ".css", ".js", ".webp", ".ico", ".mp4", ".mov"]
WORDS = {"impressum": 150, "imprint": 145, "datenschutz": 90, "privacy": 75, "privacy-policy": 85, "kontakt": 70, "contact": 60, "contact-us": 65}
ABOUT_URL, NOT_ABOUT = "ueber-uns|uber-uns|über-uns|about-us|about|/ueber", "team|jobs|karriere|career|people|story|geschichte|mission|werte|philosophie"
GUESSES = {"impressum": ["/impressum", "/impressum.php"], "privacy": ["/datenschutz", "/datenschutz.php", "/privacy", "/privacy-policy"]}
TOP_LINKS = 6

_ENDS = r"\.(" + "|".join(e[1:] for e in DENIED) + ")$"


def fetchable(href: Column) -> Column:
    """http or relative: no mail, phone, script or data, no mere fragment."""
    low = F.lower(F.trim(href))
    return F.coalesce((low != "") & ~low.rlike(r"^(mailto:|tel:|javascript:|data:|#)"), F.lit(False))


def admissible(url: Column) -> Column:
    """An absolute http URL that is no image, style, script, film or archive."""
    low = F.lower(F.trim(url))
    return F.coalesce(low.rlike("^https?://") & ~low.rlike(_ENDS), F.lit(False))


def page_like(text: Column) -> Column:
    """A string of a script that may be a page's address."""
    t = F.trim(text)
    low = F.lower(t)
    ok = ~t.contains(" ") & ~low.rlike(r"^(mailto:|tel:|javascript:|data:|#)") & ~low.rlike(_ENDS)
    return F.coalesce((t != "") & ok & (low.rlike("^(https?://|/)") | low.rlike(r"\.(php|html|htm|aspx)$") | low.contains("/") | low.contains("?")), F.lit(False))


def kinds_of(text: Column) -> Column:
    """All kinds whose words are in a link's text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(f"(?U){words}"), kind) for kind, words in KINDS.items())))


def joined(base: Column, href: Column) -> Column:
    """The absolute URL of a link; absolute ones never reach Python."""
    absolute = F.coalesce(href.rlike("^https?://"), F.lit(False))
    return F.coalesce(F.when(absolute, href), url_join(F.when(~absolute, base), F.when(~absolute, href)))


def _found(html: Column, pattern: str, *groups: int) -> Column:
    names = "abc"
    return F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), F.lit(g)).alias(names[i]) for i, g in enumerate(groups)))


def tagged_links(pages: DataFrame, pattern: str = ANCHOR, tier: int = 2) -> DataFrame:
    """(page_id, tier, pos, href, text) of each anchor of a page, in order."""
    d = pages.select("page_id", F.posexplode(_found(F.coalesce("html", F.lit("")), pattern, 1, 2)).alias("pos", "l"))
    return d.select("page_id", F.lit(tier).alias("tier"), "pos", F.col("l.a").alias("href"), visible_text(F.col("l.b")).alias("text"))


def object_links(pages: DataFrame, column: str = "links_json", tier: int = 1) -> DataFrame:
    """Links that the browser named: {"internal": [{href, text}], "external": [...]}, the internal ones first."""
    item = "array<struct<href:string,text:string>>"
    both = F.from_json(column, f"internal {item}, external {item}")
    none = F.array().cast(item)
    d = pages.select("page_id", F.posexplode(F.concat(F.coalesce(both["internal"], none), F.coalesce(both["external"], none))).alias("pos", "l"))
    return d.select("page_id", F.lit(tier).alias("tier"), "pos", F.trim("l.href").alias("href"), F.trim("l.text").alias("text")).where("href <> '' and text <> ''")


def flat_links(raw: Column) -> Column:
    """http URLs of a polymorphic list: strings, objects with href, url or link, or lists of those by name."""
    item = "array<string>"
    lists = F.when(F.trim(raw).startswith("["), F.array(F.from_json(raw, item))).otherwise(F.map_values(F.from_json(raw, f"map<string,{item}>")))
    named = lambda s: F.coalesce(*(F.nullif(F.get_json_object(s, f"$.{k}"), F.lit("")) for k in ("href", "url", "link")))
    urls = F.transform(F.flatten(F.filter(lists, lambda l: l.isNotNull())), lambda s: F.trim(F.when(s.startswith("{"), named(s)).otherwise(s)))
    return F.filter(F.coalesce(urls, F.array().cast(item)), lambda u: F.coalesce(u.rlike("(?i)^https?://"), F.lit(False)))


def button_links(pages: DataFrame, tier: int = 3) -> DataFrame:
    """Buttons whose onclick sets the location."""
    d = pages.select("page_id", F.posexplode(_found(F.coalesce("html", F.lit("")), BUTTON, 2, 3)).alias("pos", "l"))
    d = d.select("page_id", F.lit(tier).alias("tier"), "pos", F.regexp_extract("l.a", GOES_TO, 1).alias("href"), visible_text(F.col("l.b")).alias("text"))
    return d.where("href <> ''")


def script_links(pages: DataFrame, tier: int = 4) -> DataFrame:
    """Anchors whose onclick calls a function: the URL its body goes to, else the body's strings that are of the text's kind, else usual paths.

    (page_id, tier, pos, href, text, kind); only legal notices and privacy pages have usual paths, and only if the function is named so.
    """
    html = F.coalesce("html", F.lit(""))
    d = pages.select("page_id", html.alias("_h"), F.posexplode(_found(html, SCRIPTED, 2, 3)).alias("pos", "l"))
    d = d.select("page_id", "_h", "pos", visible_text(F.col("l.b")).alias("text"), F.regexp_extract("l.a", r"^\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", 1).alias("_f")).where("_f <> ''")
    d = d.withColumn("kind", F.explode(kinds_of(F.col("text"))))
    name = F.concat(F.lit(r"\Q"), F.col("_f"), F.lit(r"\E"))
    body = F.concat(F.lit(r"(?is)(?:function\s+"), name, F.lit(r"\s*\([^)]*\)|"), name, F.lit(r"\s*=\s*(?:function\s*\([^)]*\)|\([^)]*\)\s*=>))\s*\{(.*?)\}"))
    d = d.withColumn("_b", F.call_function("regexp_extract", F.col("_h"), body, F.lit(1))).drop("_h")
    return script_targets(d.withColumn("tier", F.lit(tier)))


def script_targets(calls: DataFrame) -> DataFrame:
    """``calls`` (page_id, tier, pos, text, kind, _f: a function's name, _b: its body) to the pages that they lead to; see ``script_links``."""
    straight = F.trim(F.regexp_extract("_b", OPENS, 1))
    quoted = F.transform(F.regexp_extract_all("_b", F.lit("['\"]([^'\"]{1,500})['\"]"), F.lit(1)), lambda s: F.trim(s))
    words = F.create_map(*(F.lit(x) for kv in IN_URL.items() for x in kv))
    alike = F.filter(quoted, lambda s: page_like(s) & F.call_function("rlike", F.lower(s), F.element_at(words, F.col("kind"))))
    fits = F.call_function("rlike", F.lower(F.col("_f")), F.element_at(words, F.col("kind")))
    guesses = F.when(fits & F.col("kind").isin(*GUESSES), F.element_at(F.create_map(*(x for k, v in GUESSES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("kind")))
    hrefs = F.when(page_like(straight), F.array(straight)).when(F.size(alike) > 0, alike).otherwise(guesses)
    return calls.select("page_id", "tier", "pos", "text", "kind", F.explode(hrefs).alias("href")).select("page_id", "tier", "pos", "href", "text", "kind")


def discovered(pages: DataFrame) -> DataFrame:
    """(page_id, kind, tier, pos, url) of all links of ``pages`` (page_id, url, html, links_json) by text, each once per kind, from the first tier that has any.

    Tiers: named links, anchors, buttons, called functions.
    """
    clear = pages.select("page_id", "links_json", unescaped(F.coalesce("html", F.lit(""))).alias("html"))
    plain = object_links(clear).unionByName(tagged_links(clear)).unionByName(button_links(clear))
    plain = plain.where(fetchable(F.col("href"))).withColumn("kind", F.explode(kinds_of(F.col("text"))))
    return resolved_tiers(plain.unionByName(script_links(clear)), pages)


def resolved_tiers(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Links made absolute, each once, of the first tier of each page and kind."""
    found = found.join(pages.select("page_id", "url"), "page_id")
    found = found.select("page_id", "kind", "tier", "pos", joined(F.col("url"), F.trim("href")).alias("url"))
    found = found.groupBy("page_id", "kind", "tier", "url").agg(F.min("pos").alias("pos"))
    return first_tier(found, ["page_id", "kind"])


def discovered_at_once(pages: DataFrame) -> DataFrame:
    """The links of ``discovered``, from one pass over each page's markup: anchors, buttons and calls are parts of one row set."""
    from leadmill.functions.markup import page_parts

    named = object_links(pages.select("page_id", "links_json")).where(fetchable(F.col("href"))).withColumn("kind", F.explode(kinds_of(F.col("text"))))
    parts = page_parts(pages.select("page_id", "html")).where("kind in ('anchor', 'button')").withColumnRenamed("kind", "_part")
    goes = F.regexp_extract(F.coalesce("onclick", F.lit("")), GOES_TO, 1)
    plain = F.when(F.col("_part") == "button", F.struct(F.lit(3).alias("tier"), F.nullif(goes, F.lit("")).alias("href"))).otherwise(F.struct(F.lit(2).alias("tier"), F.col("href").alias("href")))
    scripted = F.when((F.col("_part") == "anchor") & F.col("calls").isNotNull(), F.struct(F.lit(4).alias("tier"), F.lit(None).cast("string").alias("href")))
    d = parts.select("page_id", "pos", F.col("body").alias("text"), F.col("calls").alias("_f"), F.col("called").alias("_b"), F.array_compact(F.array(plain, scripted)).alias("_l")).withColumn("_l", F.explode("_l")).withColumn("kind", F.explode(kinds_of(F.col("text"))))
    d = d.select("page_id", "_l.tier", "pos", "_l.href", "text", "kind", "_f", "_b")
    straight = d.where("tier < 4").where(fetchable(F.col("href"))).select(named.columns)
    return resolved_tiers(named.unionByName(straight).unionByName(script_targets(d.where("tier = 4"))), pages)


def first_tier(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key only the lowest tier that found anything."""
    return found.withColumn("_t", F.min("tier").over(Window.partitionBy(*keys))).where("tier = _t").drop("_t")


def preference(url: Column, base_host: Column) -> Column:
    """Same site over all, then pages over homes, no fragment, https."""
    rest = F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*", "")
    path, query = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return (
        F.when(same_site(url, base_host), 100).otherwise(0) - F.when(F.regexp_extract(rest, "#(.*)$", 1) != "", 10).otherwise(0)
        + F.when(((path != "") & (path != "/")) | (query != ""), 10).otherwise(0) + F.when(F.lower(url).startswith("https://"), 1).otherwise(0)
    )


def best_urls(found: DataFrame, keys: Sequence[str], base_host: Column) -> DataFrame:
    """One URL per key: admissible ones alone, of the same site if there is any, by preference and then order."""
    d = found.where(admissible(F.col("url"))).withColumns({"_s": same_site(F.col("url"), base_host), "_p": preference(F.col("url"), base_host)})
    return top_n(d, keys, [F.desc("_s"), F.desc("_p"), F.asc("pos"), F.asc("url")], 1, "_n").drop("_n", "_s", "_p")


def about_by_url(links: DataFrame, keys: Sequence[str], base_host: Column) -> DataFrame:
    """The first link of the site whose URL says about and nothing that is another page: for pages without such a text."""
    low = F.lower("url")
    d = links.where(admissible(F.col("url")) & same_site(F.col("url"), base_host) & ~low.rlike(NOT_ABOUT) & low.rlike(ABOUT_URL))
    return top_n(d, keys, [F.asc("pos"), F.asc("url")], 1, "_n").drop("_n")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def score(url: Column) -> Column:
    """Points for words in a URL and for a short path, less for a deep one without a strong word."""
    low, path = F.lower(url), path_of(F.lower(url))
    points, strong = F.lit(0), F.lit(False)
    for word, value in WORDS.items():
        points = points + F.when(low.contains(word), value).otherwise(0)
        strong = strong | low.contains(word) if value >= 80 else strong
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return points + F.greatest(F.lit(0), 20 - F.length(path)) - F.when(strong, 0).otherwise(depth * 5)


def has_word(url: Column) -> Column:
    """A word of the list beside a slash, dash, underscore or dot."""
    words = "|".join(WORDS)
    return F.lower(url).rlike(rf"[/_.\-]({words})|({words})[/_.\-]")


def top_links(links: DataFrame, base_host: Column, keys: Sequence[str] = ("page_id",), most: int = TOP_LINKS) -> DataFrame:
    """(keys, rank, url, page_type, score): the best links of a site by their URLs, each once, the first seen of equals."""
    d = links.where((F.trim("url") != "") & ~F.lower("url").rlike(_ENDS) & same_site(F.col("url"), base_host) & has_word(F.col("url")))
    d = d.groupBy(*keys, "url").agg(F.min("pos").alias("pos")).withColumn("score", score(F.col("url")))
    return top_n(d, keys, [F.desc("score"), F.asc("pos"), F.asc("url")], most).select(*keys, "rank", "url", page_type(F.col("url")).alias("page_type"), "score")


def contact_case(imprint_text: Column, other_text: Column, imprint_url: Column, other_url: Column, tail: Column) -> Column:
    """How a site names itself: by a link's text (1 with, 2 without the notice's heading on its page, 3 contact or privacy alone), by a URL alone (5.1, 5.2, 5.3), or not (4)."""
    return (
        F.when(imprint_text & tail, "1").when(imprint_text, "2").when(other_text, "3").when(imprint_url & tail, "5.1").when(imprint_url, "5.2").when(other_url, "5.3").otherwise("4")
    )


def site_links(pages: DataFrame, tails: DataFrame) -> DataFrame:
    """(page_id, contact_case, imprint_url, about_url, about_case) of home pages (page_id, url, html, links_json).

    ``tails`` (url, tail) has what stands from the notice's heading on, by URL.
    """
    pages = pages.withColumn("base_host", host(F.col("url")))
    base = F.col("base_host")
    texts = discovered(pages).join(pages.select("page_id", "base_host"), "page_id")
    best = best_urls(texts, ["page_id", "kind"], base)
    of = best.groupBy("page_id").agg(F.max(F.when(F.col("kind") == "impressum", F.col("url"))).alias("imprint_text"), F.max(F.when(F.col("kind") == "about", F.col("url"))).alias("about_text"))
    said = texts.groupBy("page_id").agg(F.max(F.col("kind").isin("contact", "privacy")).alias("other_text"))
    clear = pages.select("page_id", unescaped(F.coalesce("html", F.lit(""))).alias("html"))
    hrefs = tagged_links(clear).where(fetchable(F.col("href"))).join(pages.select("page_id", "url", "base_host"), "page_id")
    hrefs = hrefs.select("page_id", "base_host", "pos", joined(F.col("url"), F.trim("href")).alias("url"))
    typed = hrefs.withColumn("_k", page_type(F.col("url")))
    by_url = typed.groupBy("page_id").agg(F.min_by("url", F.when(F.col("_k") == "impressum", F.struct("pos", "url"))).alias("imprint_url"), F.max(F.col("_k").isin("contact", "privacy")).alias("other_url"))
    about = about_by_url(hrefs, ["page_id"], base).select("page_id", F.col("url").alias("about_url"))
    d = pages.select("page_id")
    for side in (of, said, by_url, about):
        d = d.join(side, "page_id", "left")
    d = d.withColumn("_i", F.coalesce("imprint_text", "imprint_url")).join(tails.select(F.col("url").alias("_i"), "tail"), "_i", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    case = contact_case(F.col("imprint_text").isNotNull(), flag("other_text"), F.col("imprint_url").isNotNull(), flag("other_url"), F.coalesce(F.col("tail") != "", F.lit(False)))
    about_case = F.when(case == "4", F.lit(None)).when(F.col("about_text").isNotNull(), "about_anchor").when(F.col("about_url").isNotNull(), "about_link").otherwise("about_not_found")
    return d.select("page_id", case.alias("contact_case"), F.col("_i").alias("imprint_url"), F.when(case != "4", F.coalesce("about_text", "about_url")).alias("about_url"), about_case.alias("about_case"))
