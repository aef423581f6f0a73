"""Domain and URL expressions: Column to Column, inside whole-stage code generation but for punycode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.idna import to_ascii

SOCIAL = r"(^|\.)(facebook|instagram)\.com$"
#: Second-level labels that are part of a public suffix.
PUBLIC_SECOND = ["co", "com", "org", "net", "gov", "edu"]
#: Scheme, www., a scheme without slashes (a name before a port is none), the host, trailing dots, port and the rest: one match, so that plans stay small.
URL = r"(?s)^(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:www\.)?(?:[a-z][a-z0-9+.-]*:(?!\d+(?:[/?#]|$)))?([^/?#:]*?)\.*(?::\d+)?(?:[/?#].*)?$"
HOST = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$"


def url_host(url: Column) -> Column:
    """Host of anything that looks like a URL or a bare domain, lower case, without www., port and path."""
    return F.regexp_extract(F.lower(F.trim(url)), URL, 1)


def valid_host(host: Column) -> Column:
    """The host if it is a well-formed domain with a dot, else NULL."""
    return F.when(host.contains(".") & host.rlike(HOST), host)


def normalize_domain(url: Column) -> Column:
    """Canonical domain or NULL; hosts outside ASCII are NULL here, see ``with_ascii_domain``."""
    return valid_host(url_host(url))


def with_ascii_domain(df: DataFrame, url: str, name: str = "domain") -> DataFrame:
    """``df`` with the canonical domain in ``name``, hosts outside ASCII as punycode.

    The host is a column of its own, so that the chain of expressions is generated once, before the Arrow UDF.
    """
    return df.withColumn("_host", url_host(F.col(url))).withColumn("_ascii", F.coalesce(to_ascii(F.when(F.col("_host").rlike(r"[^\x00-\x7F]"), F.col("_host"))), F.when(~F.col("_host").rlike(r"[^\x00-\x7F]"), F.col("_host")))).withColumn(name, valid_host(F.col("_ascii"))).drop("_host", "_ascii")


def normalize_domain_loose(url: Column) -> Column:
    """The looser reading: what stands before the first slash, port kept; never NULL."""
    c = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(c, r"/.*$", ""), r"^www\.", "")


def normalize_domain_text(url: Column) -> Column:
    """The literal reading of the extraction stage: schemes taken out, one www., trailing dots; empty for NULL."""
    c = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    c = F.replace(F.replace(c, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    c = F.regexp_replace(F.split_part(c, F.lit("/"), F.lit(1)), r"^www\.", "")
    return F.rtrim(c, F.lit("."))


def host(url: Column) -> Column:
    """The host of an absolute URL, lower case; empty for anything else."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def home_url(domain: Column) -> Column:
    """https and the domain; schemes written out and outer slashes go."""
    c = F.replace(F.replace(F.coalesce(domain, F.lit("")), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.concat(F.lit("https://"), F.regexp_replace(c, "^/+|/+$", ""))


def same_site(url: Column, base_host: Column) -> Column:
    """The URL's host is the base host, or under it; www. aside."""
    h, b = bare_host(url), F.regexp_replace(F.lower(F.coalesce(base_host, F.lit(""))), r"^www\.", "")
    return (h != "") & ((h == b) | F.endswith(h, F.concat(F.lit("."), b)))


def is_social(domain: Column) -> Column:
    return F.coalesce(domain.rlike(SOCIAL), F.lit(False))


def root_domain(domain: Column) -> Column:
    return F.substring_index(domain, ".", -2)


def tld(domain: Column) -> Column:
    return F.substring_index(domain, ".", -1)


def registrable_domain(domain: Column) -> Column:
    """Three labels if the second from the right is a public second level, else two."""
    labels = F.split(domain, r"\.")
    return F.when((F.size(labels) >= 3) & F.element_at(labels, -2).isin(PUBLIC_SECOND), F.substring_index(domain, ".", -3)).otherwise(F.substring_index(domain, ".", -2))


def domains_match(a: Column, b: Column) -> Column:
    """Equal, or one a subdomain of the other."""
    return F.coalesce((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)), F.lit(False))


def canonical_url(url: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")


def page_type(url: Column) -> Column:
    """impressum, contact, privacy or other, by the first word found."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.when(u.rlike("impressum|imprint"), "impressum").when(u.rlike("kontakt|contact"), "contact").when(u.rlike("datenschutz|privacy"), "privacy").otherwise("other")


def place_excluded(primary: Column, types: Column) -> Column:
    """A place whose primary or any other type is on the list."""
    return F.lower(F.trim(F.coalesce(primary, F.lit("")))).isin(EXCLUDED_PLACE_TYPES) | F.exists(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)).isin(EXCLUDED_PLACE_TYPES))


#: Place types that are no leads.
EXCLUDED_PLACE_TYPES = [
    "supermarket", "grocery_store", "convenience_store", "department_store", "shopping_mall", "electronics_store",
    "clothing_store", "home_goods_store", "car_repair", "car_dealer", "gas_station", "restaurant", "cafe", "bakery", "bar",
    "gym", "fitness_center", "health_club", "yoga_studio", "hospital", "clinic", "pharmacy", "doctor", "dentist",
    "real_estate_agency", "travel_agency", "bank", "atm", "lodging",
]
