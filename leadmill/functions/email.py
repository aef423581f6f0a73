"""E-mail extraction, validation and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.domain import domains_match, registrable_domain

PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
VALID = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"

# Fixed values of the extraction rules.
SYSTEM_LOCALS = ["noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "postmaster", "bounce", "bounces", "daemon", "abuse", "spam", "webmaster"]
ASSET_TLDS = [
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "map", "json", "pdf", "zip", "rar", "7z", "gz", "tar", "woff", "woff2",
    "ttf", "eot", "otf", "mp3", "mp4", "mov", "avi", "mkv", "webm", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
]
FREE_MAIL = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.de", "hotmail.com", "hotmail.de", "outlook.com", "outlook.de", "aol.com", "icloud.com",
    "me.com", "protonmail.com", "proton.me", "gmx.de", "gmx.net", "web.de", "t-online.de", "freenet.de",
]
LOCAL_RANK = {"info": 0, "hallo": 1, "kontakt": 2, "contact": 2, "hello": 3, "mail": 4, "office": 5, "service": 6, "support": 7, "sales": 8, "inquiry": 9, "anfrage": 9}
PAGE_PRIORITY = {"impressum": 100, "imprint": 100, "contact": 90, "kontakt": 90, "privacy": 60, "datenschutz": 60, "home": 40, "about": 20, "ueber-uns": 20, "team": 20}
GENERIC_LOCALS = ["info", "kontakt", "hello", "office", "support", "mail", "contact"]
VENDOR_WORDS = ["valantic", "agency", "marketing", "digital", "web", "hosting", "media", "consulting"]
ROT13_FROM, ROT13_TO = "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm"


def only_local(email: Column) -> Column:
    """The part before the one @; empty if there is not exactly one."""
    parts = F.split(F.lower(F.trim(F.coalesce(email, F.lit("")))), "@")
    return F.when(F.size(parts) == 2, parts[0]).otherwise("")


def only_domain(email: Column) -> Column:
    """The part after the one @; empty if there is not exactly one."""
    parts = F.split(F.lower(F.trim(F.coalesce(email, F.lit("")))), "@")
    return F.when(F.size(parts) == 2, parts[1]).otherwise("")


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def domain_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(2))


def normalize_email(email: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(email, F.lit("")))), r"^[<>.,;:]+|[<>.,;:]+$", "")


def extract(text: Column) -> Column:
    """Distinct lower-case addresses of a text as it stands, in order; ``extraction.addresses`` undoes disguises."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)), F.lower))


def rot13(email: Column) -> Column:
    """Undo rot13 where the top level looks like a turned one and turns into a real one."""
    e = F.lower(F.trim(email))
    turned = F.translate(e, ROT13_FROM, ROT13_TO)
    last = lambda c: F.substring_index(c, ".", -1)
    return F.when(e.contains("@") & last(e).isin("bet", "qr", "pbz", "arg") & last(turned).isin("de", "com", "org", "net", "eu", "info"), turned).otherwise(e)


def is_system(email: Column) -> Column:
    return local_part(email).isin(SYSTEM_LOCALS)


def is_asset(email: Column) -> Column:
    dense = r"(?i)[@\-_]?\d+x\b"
    return local_part(email).rlike(dense) | domain_part(email).rlike(dense) | F.substring_index(domain_part(email), ".", -1).isin(ASSET_TLDS)


def is_free_mail(email: Column) -> Column:
    return domain_part(email).isin(FREE_MAIL)


def reason(email: Column) -> Column:
    """Why an address is not valid, or NULL; the texts are fixed values."""
    e = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    at = F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit("")))
    local, dom = local_part(e), domain_part(e)
    return (
        F.when(e == "", "Email is empty or None")
        .when(F.length(e) < 6, "Email too short (minimum 6 characters)")
        .when(F.length(e) > 254, "Email too long (maximum 254 characters)")
        .when(at == 0, "Missing @ symbol")
        .when(at > 1, F.concat(F.lit("Invalid number of @ symbols (found "), at.cast("string"), F.lit(")")))
        .when(local == "", "Local part (before @) is empty")
        .when(dom == "", "Domain part (after @) is empty")
        .when(~dom.contains("."), "Domain must contain at least one dot")
        .when(dom.contains("..") | dom.startswith(".") | dom.endswith("."), "Domain contains empty parts (consecutive dots)")
        .when(~e.rlike(VALID), "Email does not match valid pattern")
    )


def warnings(email: Column) -> Column:
    """What is odd about a valid address; the texts are fixed values."""
    e = F.lower(F.trim(email))
    odd = F.array(
        F.when(F.length(local_part(e)) < 2, "Local part is very short"),
        F.when(F.length(domain_part(e)) < 4, "Domain is very short"),
    )
    return F.when(reason(email).isNull(), F.array_compact(odd)).otherwise(F.array().cast("array<string>"))


def quality(email: Column) -> Column:
    """0 to 100; 0 for an invalid address."""
    local, dom = local_part(email), domain_part(email)
    score = (
        F.lit(100)
        - F.when(F.length(local) < 2, 10).otherwise(0)
        - F.when(F.length(dom) < 4, 10).otherwise(0)
        + F.when(local.rlike("info|contact|hello|mail|office"), 10).otherwise(0)
        - F.when(local.isin("a", "b", "c", "x", "y", "z"), 30).otherwise(0)
        + F.when(F.length(email).between(10, 50), 5).otherwise(0)
        - F.when(F.length(email) > 100, 20).otherwise(0)
    )
    return F.when(reason(email).isNull(), F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(0)


def _lookup(values: dict[str, int], key: Column, default: int) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def page_priority(page_type: Column) -> Column:
    return _lookup(PAGE_PRIORITY, F.lower(F.trim(F.coalesce(page_type, F.lit("")))), 10)


def local_rank(email: Column) -> Column:
    return _lookup(LOCAL_RANK, F.coalesce(local_part(email), F.lit("")), 99)


def priority(email: Column, page_type: Column, company_domain: Column) -> Column:
    """1000 for the company's domain, then page, local part and quality by 0.4, 0.2 and 0.1."""
    same = F.when(domains_match(domain_part(email), company_domain), 1000).otherwise(0)
    local = F.greatest(F.lit(0), 100 - local_rank(email) * 10)
    return F.round(same + page_priority(page_type) * 0.4 + local * 0.2 + quality(email) * 0.1, 4)


def is_personal(local: Column) -> Column:
    return local.rlike(r"^\p{L}{2,20}[._]\p{L}{2,20}$")


def candidate_score(email: Column, has_impressum: Column, support: Column, both_sources: Column, target: Column) -> Column:
    """Raw evidence score of an address, at most 155."""
    dom = domain_part(email)
    own, theirs = registrable_domain(dom), registrable_domain(target)
    same = F.coalesce(own == theirs, F.lit(False))
    sub = F.coalesce(F.endswith(dom, F.concat(F.lit("."), theirs)) | F.endswith(target, F.concat(F.lit("."), own)), F.lit(False))
    return (
        F.when(has_impressum, 100).otherwise(60)
        + F.when(support == 2, 10).when(support >= 3, 20).otherwise(0)
        + F.when(both_sources, 15).otherwise(0)
        + F.when(same, 15).when(sub, 10).otherwise(0)
        - F.when(~same & dom.rlike("|".join(VENDOR_WORDS)), 10).otherwise(0)
        + F.when(local_part(email).isin(GENERIC_LOCALS), 5).when(is_personal(local_part(email)), 3).otherwise(0)
    )


def confidence(raw: Column, low: int = 0, high: int = 155) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - low) / F.lit(float(high - low)))), 4)
