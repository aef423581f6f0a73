"""Text and company-name expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the name rules.
LEGAL = ["gmbh", "ag", "se", "kg", "gbr", "ug", "ek", "e.k", "e k", "e.u", "ltd", "inc", "llc", "corp", "sarl", "bv", "nv", "co", "co kg", "und", "u", "co."]
STOPWORDS = ["online", "shop", "store", "official", "germany", "deutschland", "gmbh", "ag", "se", "kg", "ug", "ek", "gbr", "ltd", "inc", "llc", "corp", "sarl", "bv", "nv", "co", "und", "u"]


#: What a pattern's white space is.
SPACE = " \t\n\x0b\f\r"


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed; empty for NULL."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def canonical(text: Column) -> Column:
    """Without case and outer and repeated white space; ss for the sharp s, as case folding has it."""
    return F.replace(F.lower(squeeze(text)), F.lit("ß"), F.lit("ss"))


def truncated(text: Column, most: int, mark: str = "…") -> Column:
    """At most ``most`` characters, a mark where more were."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(mark))).otherwise(text)


def without_emphasis(text: Column) -> Column:
    """Model output without bold and italic marks, blank lines and blanks squeezed."""
    c = F.coalesce(text, F.lit(""))
    for pattern in (r"\*\*(.+?)\*\*", r"__(.+?)__", r"(?<!\w)\*(.+?)\*(?!\w)", r"(?<!\w)_(.+?)_(?!\w)"):
        c = F.regexp_replace(c, pattern, "$1")
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\n{3,}", "\n\n"), " {2,}", " ")


def impressum_tail(markdown: Column) -> Column:
    """From the heading of the legal notice to the end; empty without one."""
    t = F.coalesce(markdown, F.lit(""))
    # Only the heading's own line and no blank lines before it: what stands there is trimmed, and each of them would be tried as a start.
    found = F.regexp_extract(t, r"(?ims)(^[ \t\x0B\f]*+(#{1,6}+\s*+)?(impressum|imprint)[ \t]*+$.*+)", 1)
    return F.btrim(found, F.lit(SPACE))


_INVISIBLE = ["\u00ad", "\u200b", "\u200c", "\u200d", "\u2060"]


def _has(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def visible_text(html: Column) -> Column:
    """Tags and invisible characters out, white space squeezed."""
    t = F.coalesce(html, F.lit(""))
    # After the last > there are no tags; that rest is taken at once, where each < would be read to the end.
    c = F.replace(F.regexp_replace(t, r"<[^>]++>|(<[^>]*+\z)", "$1"), F.lit("\u00a0"), F.lit(" "))
    for sign in _INVISIBLE:
        c = F.replace(c, F.lit(sign), F.lit(""))
    return squeeze(F.when(_has(t, ["<", "\u00a0", *_INVISIBLE]), c).otherwise(t))


#: Parts of a browser's error and what they mean, the first that fits.
CRAWL_ERRORS = [
    ("ERR_NAME_NOT_RESOLVED", "Domain not found (DNS error)"), ("ERR_CONNECTION_REFUSED", "Connection refused"), ("ERR_CONNECTION_TIMED_OUT|Timeout", "Connection timeout"),
    ("ERR_NETWORK_CHANGED", "Network changed during request"), ("ERR_CONNECTION_RESET", "Connection reset"), ("ERR_CONNECTION_CLOSED", "Connection closed"),
    ("ERR_EMPTY_RESPONSE", "Empty response from server"), ("ERR_SSL|SSL", "SSL certificate error"), ("ERR_CERT", "Certificate error"), ("ERR_TOO_MANY_REDIRECTS", "Too many redirects"),
    ("ERR_UNSAFE_REDIRECT", "Unsafe redirect"), ("ERR_BLOCKED_BY_CLIENT", "Blocked by client"), ("ERR_BLOCKED_BY_RESPONSE", "Blocked by response"), ("404", "Page not found (404)"),
    ("403", "Access forbidden (403)"), ("500", "Server error (500)"), ("502", "Bad gateway (502)"), ("503", "Service unavailable (503)"), ("504", "Gateway timeout (504)"),
]


#: A text with none of these has none of the parts above.
_SIGNS = ["ERR_", "Timeout", "SSL", "40", "50"]
#: Lines that tell nothing, from the start, then the first that does; no match without one.
_TELLING = r"\A(?:\s*+(?:Error:|Call log:|Code context:|-|→)[^\n]*+)*+\s*+(\S(?:[^\n]*\S)?)(?s:.*+)"


def crawl_error(error: Column) -> Column:
    """A short name for an error; else its first telling line, at most 80 characters."""
    e = F.coalesce(error, F.lit(""))
    name = F.when(~_has(e, _SIGNS), None)
    for part, meaning in CRAWL_ERRORS:
        name = name.when(_has(e, part.split("|")), meaning)
    # By patterns that name the text once, as a condition on it would have it read again.
    short = F.regexp_replace(F.regexp_replace(e, _TELLING, "$1"), r"(?s)\A(.{80}).++", "$1...")
    return F.coalesce(name, F.when(e.contains("Empty content"), e), short)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def slugify(text: Column, max_length: int = 60) -> Column:
    s = F.regexp_replace(F.lower(squeeze(text)), r"[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(s, r"^_+|_+$", ""), 1, max_length)


def words(text: Column) -> Column:
    """Latin and German words, inner hyphens kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-zÄÖÜäöüß]+(?:-[A-Za-zÄÖÜäöüß]+)*)"), F.lit(1))


def strip_html(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return squeeze(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def normalize_name(name: Column) -> Column:
    """Lower case, & as and, punctuation out, legal forms out."""
    c = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(c, r"""[.,;:/()\[\]{}|\-\\_"'`]""", " ")
    return F.array_join(F.filter(F.split(squeeze(c), " "), lambda t: ~t.isin(LEGAL)), " ")


def brand_token(name: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(normalize_name(name), " "), lambda t: ~t.isin(STOPWORDS) & (t != "")), 1, 2), " ")


def has_legal_form(name: Column, strict: bool = False) -> Column:
    """Observed rule: a legal token anywhere as a substring; ``strict``: as a word of its own."""
    low = F.lower(F.coalesce(name, F.lit("")))
    if strict:
        return low.rlike(r"(^|[^\p{L}])(" + "|".join(t.replace(".", r"\.") for t in LEGAL) + r")($|[^\p{L}])")
    found = F.lit(False)
    for token in LEGAL:
        found = found | low.contains(token)
    return found


def organization_bonus(organization: Column, name: Column) -> Column:
    a, b = normalize_name(organization), normalize_name(name)
    brand = brand_token(organization)
    inside = (a != "") & (b != "")
    return (
        F.when(inside & (a == b), 30)
        .when(inside & (a.contains(b) | b.contains(a)), 20)
        .when(inside & (brand != "") & (brand == brand_token(name)), 10)
        .otherwise(0)
    )


def company_score(page_type: Column, name: Column, organization: Column, strict_legal_form: bool = False) -> Column:
    return F.when(page_type == "impressum", 100).otherwise(60) + F.when(has_legal_form(name, strict_legal_form), 25).otherwise(0) + organization_bonus(organization, name)


def status_or_not_started(status: Column) -> Column:
    return F.when(F.coalesce(status, F.lit("")) == "", "NOT_STARTED").otherwise(F.upper(status))


def a1_column(index: Column) -> Column:
    """Spreadsheet label of a zero-based column, up to three letters."""
    n = index.cast("int")
    letter = lambda c: F.char(F.lit(65) + c)
    two, three = F.floor(n / 26) - 1, F.floor((n / 26 - 1) / 26) - 1
    return F.concat(F.when(n >= 702, letter(three % 26)).otherwise(""), F.when(n >= 26, letter(two % 26)).otherwise(""), letter(n % 26))
