"""Queries from captured pages to selected e-mails, companies and contacts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.functions import email as E
from leadmill.functions import extraction as X
from leadmill.functions import text as T
from leadmill.operators import evidence, records
from leadmill.plans.registry import Sample, micros, query, shared, table

# -- SQL of the twins ----------------------------------------------------------------------

_Q = lambda s: "'" + s.replace("'", "''") + "'"
ADDRESS_SQL = _Q(X.ADDRESS)
_EDGE = _Q(f"^{X.BOUNDARY}|{X.BOUNDARY}$")


def unescaped_sql(x: str) -> str:
    for entity, char in (("&#64;", "'@'"), ("&commat;", "'@'"), ("&#46;", "'.'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    return x


def undisguised_sql(x: str) -> str:
    x = rf"translate(regexp_replace(coalesce({x}, ''), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}\x{{00AD}}]', '', 'g'), chr(13) || chr(10), '  ')"
    for pattern, sign in X.DISGUISES:
        x = f"regexp_replace({x}, {_Q(pattern)}, '{sign}', 'gi')"
    return x


def cleaned_sql(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), {_EDGE}, '', 'g')"


def reason_sql(e: str) -> str:
    local, dom, at = f"split_part({e}, '@', 1)", f"split_part({e}, '@', 2)", f"(length({e}) - length(replace({e}, '@', '')))"
    return rf"""CASE WHEN {e} = '' THEN 'Email is empty or None' WHEN length({e}) < 6 THEN 'Email too short (minimum 6 characters)' WHEN length({e}) > 254 THEN 'Email too long (maximum 254 characters)'
WHEN {at} = 0 THEN 'Missing @ symbol' WHEN {at} > 1 THEN 'Invalid number of @ symbols (found ' || {at} || ')' WHEN {local} = '' THEN 'Local part (before @) is empty' WHEN {dom} = '' THEN 'Domain part (after @) is empty'
WHEN NOT contains({dom}, '.') THEN 'Domain must contain at least one dot' WHEN contains({dom}, '..') OR starts_with({dom}, '.') OR ends_with({dom}, '.') THEN 'Domain contains empty parts (consecutive dots)'
WHEN NOT regexp_matches({e}, '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}$') THEN 'Email does not match valid pattern' END"""


def quality_sql(e: str, reason: str = "reason") -> str:
    local, dom = f"split_part({e}, '@', 1)", f"split_part({e}, '@', 2)"
    return f"""CASE WHEN {reason} IS NULL THEN greatest(0, least(100, 100 - CASE WHEN length({local}) < 2 THEN 10 ELSE 0 END - CASE WHEN length({dom}) < 4 THEN 10 ELSE 0 END
+ CASE WHEN regexp_matches({local}, 'info|contact|hello|mail|office') THEN 10 ELSE 0 END - CASE WHEN {local} IN ('a','b','c','x','y','z') THEN 30 ELSE 0 END
+ CASE WHEN length({e}) BETWEEN 10 AND 50 THEN 5 ELSE 0 END - CASE WHEN length({e}) > 100 THEN 20 ELSE 0 END)) ELSE 0 END"""


_LIST = lambda items: "(" + ", ".join(_Q(i) for i in items) + ")"


def system_sql(e: str) -> str:
    return f"split_part({e}, '@', 1) IN {_LIST(E.SYSTEM_LOCALS)}"


def asset_sql(e: str) -> str:
    local, dom = f"split_part({e}, '@', 1)", f"split_part({e}, '@', 2)"
    return rf"(regexp_matches({local}, '[@\-_]?\d+x\b', 'i') OR regexp_matches({dom}, '[@\-_]?\d+x\b', 'i') OR string_split({dom}, '.')[-1] IN {_LIST(E.ASSET_TLDS)})"


def match_sql(a: str, b: str) -> str:
    return f"coalesce({a} = {b} OR ends_with({a}, '.' || {b}) OR ends_with({b}, '.' || {a}), false)"


def found_sql(source: str, ident: str, text: str) -> str:
    """Rows (ident, i, email) of the plausible addresses of ``text``, i in order of being found; an address perhaps more than once."""
    return f"""SELECT {ident}, i, email FROM (SELECT {ident}, i, j, email, {reason_sql('email')} AS reason FROM (SELECT {ident}, i, generate_subscripts(found, 1) AS j, unnest(found) AS email FROM (
SELECT {ident}, i, CASE WHEN contains(c, '%') THEN list_transform(regexp_extract_all(url_decode(c), {ADDRESS_SQL}), lambda d: {cleaned_sql('d')})
ELSE [CASE WHEN regexp_extract(c, {ADDRESS_SQL}) <> '' THEN lower(regexp_extract(c, {ADDRESS_SQL})) ELSE c END] END AS found FROM (SELECT {ident}, i, {cleaned_sql('c')} AS c FROM (
SELECT {ident}, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT {ident}, list_concat(list_transform(list_filter(list_transform(regexp_extract_all(n, {_Q(X.MAILTO)}, 1), lambda t: trim(url_decode(split_part(t, '?', 1)))), lambda t: t <> ''),
lambda t: CASE WHEN regexp_extract(t, {ADDRESS_SQL}) <> '' THEN regexp_extract(t, {ADDRESS_SQL}) ELSE t END), regexp_extract_all(n, {ADDRESS_SQL})) AS cs FROM (SELECT {ident}, {undisguised_sql(unescaped_sql(text))} AS n FROM {source}))))))) WHERE reason IS NULL"""


# -- planted rows ---------------------------------------------------------------------------

TEXTS = Sample(
    "doc_id long, text string",
    (
        (-1, "Write to info [at] firma [dot] de or sales(at)firma.de, please."),
        (-2, '<a href="mailto:Office@Firma.DE?subject=Hi">mail</a> and again office@firma.de'),
        (-3, "mailto:info%40encoded.de%3Fx and max&#64;muster.com or eva&commat;muster.com"),
        (-4, "hid​den@zero​.com\nnext punkt line, kontakt (at) firma punkt at"),
        (-5, "bad@@two.com @nobody.de a@b .. x@y.z1 logo@2x.png (team@firma.de), <boss@firma.de>;"),
        (-6, None), (-7, ""), (-8, "%41bc@firma.de then wrong%zz@firma.de"),
        (-9, "Support team: help@firma.de. " + "x " * 80 + "far@firma.de"),
    ),
)
ADDRESSES = Sample(
    "doc_id long, email string",
    tuple((-20 - i, e) for i, e in enumerate([
        "info@firma.de", "a@b.c", "", "noat.example.com", "a@b@c.de", "@firma.de", "someone@", "some@localhost", "some@a..de", "some@.de", "some@de.", "so me@firma.de", "x@firma.de", "ab@c.de",
        "max.muster@mail.firma.co.uk", "noreply@firma.de", "logo@2x.png", "pic-3x@cdn.de", "someone@gmail.com", "l" * 245 + "@firma.de", "m" * 100 + "@firma.de", "contact@office-firma.de", "name@file.pdf", " Info@Firma.DE ",
    ])),
)
CAPTURED = Sample(
    "page_id long, domain string, url string, final_url string, page_type string, cleaned_html string, markdown string, error string",
    (
        (-1, "firma.de", "https://firma.de/impressum", None, "Impressum", "Mail: info@firma.de, max@firma.de, it@agency.com", None, None), (-2, "firma.de", "https://firma.de/", "https://firma.de/home", "home", "info@firma.de or sales@firma.de", "x", None),
        (-3, "firma.de", "https://firma.de/logo.png", "", "other", "png@firma.de", None, None), (-4, "firma.de", "https://firma.de/c", " ", None, "", "only@markdown.de", None), (-5, "solo.de", "https://solo.de/", None, "contact", "noreply@solo.de hello@else.com", None, None),
        (-6, "solo.de", "https://solo.de/x", None, "privacy", None, None, "net::ERR_NAME_NOT_RESOLVED at x"), (-7, "blank.de", "https://blank.de/", None, "about", "  ", "", None), (-8, "old.de", "https://old.de/", None, " TEAM ", "a@old.de b@old.de c2@old.de d2@old.de e2@old.de f2@old.de g2@old.de", None, ""),
    ),
)


# -- extraction -----------------------------------------------------------------------------


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(TEXTS.df(spark))


_ALL_TEXTS = f"(SELECT doc_id::BIGINT AS doc_id, text FROM documents UNION ALL SELECT * FROM {TEXTS.sql})"


@query(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INTEGER - 1 AS pos, email FROM (SELECT * FROM ({found_sql(_ALL_TEXTS, 'doc_id', 'text')}) QUALIFY row_number() OVER (PARTITION BY doc_id, email ORDER BY i) = 1)")
def email_parse_chain(spark, sf_dir):
    """Entities, disguises, mailto links and percent signs undone, and what is a plausible address then, in order."""
    d = _texts(spark, sf_dir).where(X.may_hold_address(F.col("text"))).select("doc_id", X.unescaped(F.col("text")).alias("t")).select("doc_id", X.undisguised(F.col("t")).alias("n"))
    # An outer explode, as Spark would add a filter on the list to an inner one, and make the list twice.
    return d.select("doc_id", F.posexplode_outer(X.addresses(F.col("n"))).alias("pos", "email")).where("email is not null")


_OWN = f"(SELECT doc_id, email FROM {ADDRESSES.sql} UNION ALL SELECT DISTINCT doc_id::BIGINT, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,24}}'))) FROM documents)"


@query(f"""SELECT doc_id, email, reason, array_to_string(CASE WHEN reason IS NULL THEN list_filter([CASE WHEN length(split_part(e, '@', 1)) < 2 THEN 'Local part is very short' END, CASE WHEN length(split_part(e, '@', 2)) < 4 THEN 'Domain is very short' END], lambda w: w IS NOT NULL) ELSE [] END, '; ') AS warnings,
{quality_sql('e')} AS quality, reason IS NULL AS plausible, {system_sql('e')} AS system, {asset_sql('e')} AS asset, split_part(e, '@', 2) IN {_LIST(E.FREE_MAIL)} AS free,
CASE WHEN len(string_split(e, '@')) = 2 THEN split_part(e, '@', 1) ELSE '' END AS local, CASE WHEN len(string_split(e, '@')) = 2 THEN split_part(e, '@', 2) ELSE '' END AS domain FROM (SELECT *, {reason_sql('e')} AS reason FROM (SELECT *, lower(trim(email)) AS e FROM {_OWN}))""")
def email_checks(spark, sf_dir):
    """Every check of an address: reason, warnings, quality, plausibility, system, asset and free mail."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(E.extract(F.col("text"))).alias("email")).unionByName(ADDRESSES.df(spark))
    e = F.lower(F.trim("email"))
    return d.select(
        "doc_id", "email", E.reason(e).alias("reason"), F.array_join(E.warnings(e), "; ").alias("warnings"), E.quality(e).alias("quality"), X.plausible(e).alias("plausible"), E.is_system(e).alias("system"),
        E.is_asset(e).alias("asset"), E.is_free_mail(e).alias("free"), E.only_local(e).alias("local"), E.only_domain(e).alias("domain"),
    )


# -- pages to e-mails of a domain --------------------------------------------------------------

_HOST = r"regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\.)?', ''), '[/?#:].*$', '')"
_PAGES_SQL = f"(SELECT * FROM {CAPTURED.sql} UNION ALL SELECT page_id::BIGINT, {_HOST}, url, NULL, CASE WHEN page_id % 3 = 0 THEN 'contact' ELSE 'other' END, html, NULL, NULL FROM pages)"


def captured_pages(spark, sf_dir):
    """Planted captures, and all pages as captures."""
    own = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("page_id"), F.expr(_HOST.replace("\\", "\\\\")).alias("domain"), "url", F.lit(None).cast("string").alias("final_url"), F.when(F.col("page_id") % 3 == 0, "contact").otherwise("other").alias("page_type"),
        F.col("html").alias("cleaned_html"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("string").alias("error"),
    )
    return CAPTURED.df(spark).unionByName(own)


_TEXT_SQL = "CASE WHEN trim(coalesce(cleaned_html, '')) <> '' THEN trim(cleaned_html) ELSE trim(coalesce(markdown, '')) END"
_STAGE = f"(SELECT DISTINCT ON (page_id, email) page_id, i, email FROM ({found_sql(f'(SELECT page_id, {_TEXT_SQL} AS t FROM {_PAGES_SQL})', 'page_id', 't')}) ORDER BY page_id, email, i)"


@query(f"""SELECT p.page_id, coalesce(nullif(lower(trim(page_type)), ''), 'other') AS page_type, CASE WHEN coalesce(error, '') <> '' THEN 'failed' WHEN {_TEXT_SQL} <> '' THEN 'succeeded' ELSE 'failed' END AS status,
CASE WHEN coalesce(error, '') <> '' THEN error WHEN {_TEXT_SQL} = '' THEN 'empty_content' END AS error,
coalesce((SELECT '[' || string_agg('"' || email || '"', ',' ORDER BY i) || ']' FROM (SELECT *, {reason_sql('email')} AS reason FROM {_STAGE}) s WHERE s.page_id = p.page_id AND NOT ({system_sql('email')}) AND NOT {asset_sql('email')} AND {quality_sql('email')} >= 50), '[]') AS emails_json FROM {_PAGES_SQL} p""")
def stage_one_pages(spark, sf_dir):
    """What stage one stores of every page, with an empty list where it finds nothing, and the page's status."""
    blank = X.page_text(F.col("cleaned_html"), F.col("markdown")) == ""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    d = X.page_emails(captured_pages(spark, sf_dir))
    status = F.when(failed | blank, "failed").otherwise("succeeded")
    kind = F.coalesce(T.blank_to_null(F.lower("page_type")), F.lit("other"))
    return d.select("page_id", kind.alias("page_type"), status.alias("status"), F.when(failed, F.col("error")).when(blank, "empty_content").alias("error"), F.to_json("emails").alias("emails_json"))


_PRIO = "coalesce(map {'impressum': 100, 'imprint': 100, 'contact': 90, 'kontakt': 90, 'privacy': 60, 'datenschutz': 60, 'home': 40, 'about': 20, 'ueber-uns': 20, 'team': 20}[page_type], 10)"
_RANK = "coalesce(map {'info': 0, 'hallo': 1, 'kontakt': 2, 'contact': 2, 'hello': 3, 'mail': 4, 'office': 5, 'service': 6, 'support': 7, 'sales': 8, 'inquiry': 9, 'anfrage': 9}[split_part(email, '@', 1)], 99)"
_PLACED = f"(SELECT page_id, domain, coalesce(nullif(trim(final_url), ''), url, '') AS u, lower(trim(page_type)) AS page_type, trim(coalesce(cleaned_html, '')) AS t FROM {_PAGES_SQL})"
_SEEN = f"(SELECT domain, u, page_type, email, {reason_sql('email')} AS reason FROM ({found_sql(_PLACED, 'page_id', 't')}) JOIN {_PLACED} USING (page_id) WHERE NOT regexp_matches(lower(trim(u)), '\\.({'|'.join(E.ASSET_TLDS)})$'))"


@query(f"""WITH s AS (SELECT *, {_PRIO} AS p FROM {_SEEN} WHERE NOT ({system_sql('email')}) AND NOT {asset_sql('email')} AND {quality_sql('email')} >= 50),
b AS (SELECT DISTINCT ON (domain, email) *, {match_sql("split_part(email, '@', 2)", 'domain')} AS own FROM s ORDER BY domain, email, p DESC, u, page_type),
k AS (SELECT *, round(CASE WHEN own THEN 1000 ELSE 0 END + p * 0.4 + greatest(0, 100 - {_RANK} * 10) * 0.2 + {quality_sql('email')} * 0.1, 4)::DOUBLE AS score FROM b QUALIFY own OR NOT max(own) OVER (PARTITION BY domain))
SELECT domain, (row_number() OVER (PARTITION BY domain ORDER BY score DESC, email))::INTEGER AS rank, email, u AS source_url, score FROM k QUALIFY rank <= 5""")
def domain_emails(spark, sf_dir):
    """The five best addresses of each domain over all of its pages."""
    return X.emails_of_domains(captured_pages(spark, sf_dir))


# -- evidence, selection, aggregation -------------------------------------------------------------

KEYS = ["request_id", "domain"]
_FOUND = {
    "request_id": "concat('r', o_custkey % 5)", "domain": "concat('c', o_custkey, '.de')", "organization": "concat('Firm ', o_custkey % 50, ' GmbH')", "url": "concat('https://c', o_custkey, '.de/p', o_orderkey)",
    "page_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'impressum' WHEN '2-HIGH' THEN 'contact' WHEN '3-MEDIUM' THEN 'privacy' WHEN '5-LOW' THEN 'home' ELSE 'other' END", "seq": "CAST(o_orderkey AS BIGINT)",
    "company_json": """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('{"value": " Firm ', o_custkey % 50, ' GmbH", "evidence": {"quote": "q', o_orderkey, '"}}') WHEN 2 THEN concat('{"value": "firm ', o_custkey % 50, ' gmbh ", "evidence": {"quote": ""}}') ELSE concat('{"value": "Other ', o_orderkey % 3, '", "evidence": {"quote": "o"}}') END""",
    "description_json": """CASE o_orderkey % 3 WHEN 0 THEN '{"value": "We build.", "evidence": {"quote": "b"}}' WHEN 1 THEN '{"value": "We sell", "evidence": {"quote": "s"}}' ELSE '{"value": "", "evidence": {"quote": "n"}}' END""",
    "emails_json": """CASE o_orderkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN concat('[{"email": "Info@c', o_custkey, '.de ", "evidence": {"quote": "a"}}, {"email": "", "evidence": {"quote": "e"}}]') WHEN 2 THEN concat('[{"email": "max.muster@mail.c', o_custkey, '.de", "evidence": {"quote": "m"}}, {"email": "it@digital-agency.com", "evidence": {"quote": "v"}}]') ELSE '[{"email": "x@y.de"}]' END""",
    "contacts_json": """CASE o_orderkey % 3 WHEN 0 THEN '[{"name": " Ann Lee", "role": "CEO ", "evidence": {"quote": "x"}}, {"name": "Bo", "role": null, "evidence": {"quote": "y"}}]' WHEN 1 THEN '[{"name": "Ann Lee", "role": "ceo", "evidence": {"quote": "z"}}, {"name": "Ann Lee", "role": "CTO", "evidence": {"quote": "t"}}]' ELSE '[{"role": "none"}]' END""",
    "plain_json": """CASE o_orderkey % 3 WHEN 0 THEN concat('["Info@c', o_custkey, '.de", "info@c', o_custkey, '.de", "it@digital-agency.com"]') WHEN 1 THEN '[]' ELSE concat('["shop@c', o_custkey, '.de"]') END""",
}
_EXTRACTED = f"(SELECT {', '.join(shared(_FOUND))} FROM orders)"


def extracted_pages(spark, sf_dir):
    """Orders as extracted pages of their customers' domains."""
    return table(spark, sf_dir, "orders").selectExpr(*shared(_FOUND))


def _det(pages):
    return pages.select(*KEYS, *evidence.PAGE, F.col("plain_json").alias("emails_json"))


def _named(column: str) -> str:
    return f"(SELECT request_id, domain, lower(trim(v)) AS key, trim(v) AS value, url, page_type, seq, 0 AS pos, q AS quote FROM (SELECT *, json_extract_string({column}, '$.value') AS v, coalesce(json_extract_string({column}, '$.evidence.quote'), '') AS q FROM {_EXTRACTED} WHERE json_extract({column}, '$.evidence') IS NOT NULL) WHERE v <> '')"


_MAILS = f"""(SELECT request_id, domain, lower(trim(v.email)) AS key, lower(trim(v.email)) AS value, url, page_type, seq, i - 1 AS pos, CASE WHEN v.evidence IS NOT NULL THEN coalesce(v.evidence.quote, '') END AS quote FROM (
SELECT *, generate_subscripts(l, 1) AS i, unnest(l) AS v FROM (SELECT *, from_json(emails_json, '[{{"email":"VARCHAR","evidence":{{"quote":"VARCHAR"}}}}]') AS l FROM {_EXTRACTED})) WHERE v.email <> '')"""
_PEOPLE = f"""(SELECT request_id, domain, trim(v.name) || chr(10) || lower(trim(coalesce(v.role, ''))) AS key, trim(v.name) || CASE WHEN trim(coalesce(v.role, '')) <> '' THEN ' (' || trim(v.role) || ')' ELSE '' END AS value, url, page_type, seq, i - 1 AS pos, CASE WHEN v.evidence IS NOT NULL THEN coalesce(v.evidence.quote, '') END AS quote FROM (
SELECT *, generate_subscripts(l, 1) AS i, unnest(l) AS v FROM (SELECT *, from_json(contacts_json, '[{{"name":"VARCHAR","role":"VARCHAR","evidence":{{"quote":"VARCHAR"}}}}]') AS l FROM {_EXTRACTED})) WHERE v.name <> '')"""
_PLAIN = f"""(SELECT DISTINCT ON (request_id, domain, key, url, page_type) request_id, domain, lower(trim(v)) AS key, lower(trim(v)) AS value, url, page_type, seq, i - 1 AS pos, v AS quote FROM (
SELECT *, generate_subscripts(l, 1) AS i, unnest(l) AS v FROM (SELECT *, from_json(plain_json, '["VARCHAR"]') AS l FROM {_EXTRACTED})) WHERE v <> '' ORDER BY request_id, domain, key, url, page_type, seq, i)"""


def _grouped_sql(found: str, impressum_first: bool = True) -> str:
    imp = "max(page_type = 'impressum' AND quote IS NOT NULL) DESC, " if impressum_first else ""
    own = "page_type <> 'impressum', " if impressum_first else ""
    return f"""(SELECT g.request_id, g.domain, g.key, g.value, g.value_rank, e.evidence_rank, e.url, e.page_type, e.quote FROM
(SELECT request_id, domain, key, arg_min(value, (seq, pos)) AS value, (row_number() OVER (PARTITION BY request_id, domain ORDER BY {imp}min((seq, pos)), key))::INTEGER AS value_rank FROM {found} GROUP BY 1, 2, 3) g
LEFT JOIN (SELECT *, (row_number() OVER (PARTITION BY request_id, domain, key ORDER BY {own}seq, pos))::INTEGER AS evidence_rank FROM {found} WHERE quote IS NOT NULL) e USING (request_id, domain, key))"""


@query(f"SELECT * FROM {_grouped_sql(_named('company_json'))}")
def evidence_company(spark, sf_dir):
    return evidence.grouped(evidence.companies(extracted_pages(spark, sf_dir), KEYS), KEYS)


@query(f"SELECT * FROM {_grouped_sql(_named('description_json'), False)}")
def evidence_description(spark, sf_dir):
    return evidence.grouped(evidence.companies(extracted_pages(spark, sf_dir), KEYS, "description_json"), KEYS, impressum_first=False)


@query(f"SELECT * FROM {_grouped_sql(_MAILS)}")
def evidence_emails(spark, sf_dir):
    return evidence.grouped(evidence.emails(extracted_pages(spark, sf_dir), KEYS), KEYS)


@query(f"SELECT * FROM {_grouped_sql(_PEOPLE)}")
def evidence_contacts(spark, sf_dir):
    return evidence.grouped(evidence.contacts(extracted_pages(spark, sf_dir), KEYS), KEYS)


@query(f"SELECT * FROM {_grouped_sql(_PLAIN)}")
def evidence_plain_emails(spark, sf_dir):
    return evidence.grouped(evidence.plain_emails(_det(extracted_pages(spark, sf_dir)), KEYS), KEYS)


_REG = lambda d: f"CASE WHEN len(string_split({d}, '.')) >= 3 AND string_split({d}, '.')[-2] IN ('co','com','org','net','gov','edu') THEN array_to_string(string_split({d}, '.')[-3:], '.') ELSE array_to_string(string_split({d}, '.')[-2:], '.') END"
_L, _D = "split_part(email, '@', 1)", "split_part(email, '@', 2)"
_SELECTED = rf"""(SELECT *, row_number() OVER (PARTITION BY request_id, domain ORDER BY raw DESC, impressum DESC, support DESC, b DESC, email) AS rank, max(raw) OVER (PARTITION BY request_id, domain) AS top FROM (SELECT *,
CASE WHEN impressum THEN 100 ELSE 60 END + CASE WHEN support = 2 THEN 10 WHEN support >= 3 THEN 20 ELSE 0 END + CASE WHEN b THEN 15 ELSE 0 END + CASE WHEN ({_REG(_D)}) = ({_REG('domain')}) THEN 15 WHEN ends_with({_D}, '.' || ({_REG('domain')})) OR ends_with(domain, '.' || ({_REG(_D)})) THEN 10 ELSE 0 END
- CASE WHEN ({_REG(_D)}) <> ({_REG('domain')}) AND regexp_matches({_D}, 'valantic|agency|marketing|digital|web|hosting|media|consulting') THEN 10 ELSE 0 END
+ CASE WHEN {_L} IN ('info', 'kontakt', 'hello', 'office', 'support', 'mail', 'contact') THEN 5 WHEN regexp_matches({_L}, '^\pL{{2,20}}[._]\pL{{2,20}}$') THEN 3 ELSE 0 END AS raw FROM (
SELECT request_id, domain, email, count(DISTINCT (url, page_type)) FILTER (seen) AS support, coalesce(max(page_type = 'impressum') FILTER (seen), false) AS impressum, max(l) AND max(NOT l) AS b,
coalesce(arg_min(page_type, coalesce(map {{'impressum': 0, 'contact': 1, 'privacy': 2, 'home': 3, 'other': 4}}[page_type], 99)) FILTER (seen), 'other') AS page_type FROM (
SELECT request_id, domain, regexp_replace(lower(trim(key)), '^[<>.,;:]+|[<>.,;:]+$', '', 'g') AS email, url, page_type, quote IS NOT NULL AS seen, true AS l FROM {_MAILS}
UNION ALL SELECT request_id, domain, regexp_replace(lower(trim(key)), '^[<>.,;:]+|[<>.,;:]+$', '', 'g'), url, page_type, true, false FROM {_PLAIN}) GROUP BY 1, 2, 3)))"""


@query(f"""SELECT request_id, domain, rank::INTEGER AS rank, email, raw, support, page_type, round(greatest(0.0, least(1.0, raw / 155.0::DOUBLE)), 4) AS score,
rank = coalesce(min(rank) FILTER (impressum AND raw >= top - 15) OVER (PARTITION BY request_id, domain), 1) AS selected FROM {_SELECTED}""")
def email_selection(spark, sf_dir):
    """All addresses of a domain ranked by their evidence, and the one selected."""
    p = extracted_pages(spark, sf_dir)
    return evidence.select_emails(evidence.emails(p, KEYS), evidence.plain_emails(_det(p), KEYS), KEYS, "domain").withColumn("raw", F.col("raw").cast("int"))


_LEGAL = ", ".join(_Q(t) for t in T.LEGAL)
_NORM = lambda c: rf"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(trim(coalesce({c}, ''))), '&', ' and '), '[.,;:/()\[\]{{}}|\-\\_\"''`]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: t NOT IN ({_LEGAL})), ' ')"
_BRAND = lambda c: f"array_to_string(list_filter(string_split({_NORM(c)}, ' '), lambda x: x <> '' AND x NOT IN ({', '.join(_Q(t) for t in T.STOPWORDS)}))[1:2], ' ')"


@query(f"""WITH c AS (SELECT g.*, organization, {_NORM('value')} AS nv, {_NORM('organization')} AS no FROM {_grouped_sql(_named('company_json'))} g LEFT JOIN (SELECT DISTINCT request_id, domain, organization FROM {_EXTRACTED}) USING (request_id, domain) WHERE evidence_rank = 1),
s AS (SELECT *, CASE WHEN page_type = 'impressum' THEN 100 ELSE 60 END + CASE WHEN {' OR '.join(f'contains(lower(value), {_Q(t)})' for t in T.LEGAL)} THEN 25 ELSE 0 END
+ CASE WHEN nv = '' OR no = '' THEN 0 WHEN nv = no THEN 30 WHEN contains(nv, no) OR contains(no, nv) THEN 20 WHEN {_BRAND('organization')} <> '' AND {_BRAND('organization')} = {_BRAND('value')} THEN 10 ELSE 0 END AS raw FROM c),
t AS (SELECT *, page_type = 'impressum' AND raw >= max(raw) OVER (PARTITION BY request_id, domain) - 15 AS e FROM s)
SELECT request_id, domain, value AS company, raw, page_type, round(greatest(0.0, least(1.0, (raw - 60) / 95.0::DOUBLE)), 4) AS score FROM t
QUALIFY row_number() OVER (PARTITION BY request_id, domain ORDER BY e DESC, raw DESC, page_type = 'impressum' DESC, length(value) DESC, value_rank) = 1""")
def company_selection(spark, sf_dir):
    p = extracted_pages(spark, sf_dir)
    groups = evidence.grouped(evidence.companies(p, KEYS), KEYS)
    return evidence.select_company(groups, p.select(*KEYS, "organization").distinct(), KEYS).withColumn("raw", F.col("raw").cast("int"))


@query(f"""SELECT d.request_id, d.domain, v.value AS description, (SELECT string_agg(value, ', ' ORDER BY value_rank) FROM (SELECT DISTINCT request_id, domain, value, value_rank FROM {_grouped_sql(_PEOPLE)}) c WHERE c.request_id = d.request_id AND c.domain = d.domain) AS contacts,
CASE WHEN n > 0 THEN 'succeeded' ELSE 'failed' END AS status FROM (SELECT request_id, domain, count(company_json) AS n FROM {_EXTRACTED} GROUP BY 1, 2) d LEFT JOIN (SELECT DISTINCT request_id, domain, value FROM {_grouped_sql(_named('description_json'), False)} WHERE value_rank = 1) v USING (request_id, domain)""")
def domain_aggregate(spark, sf_dir):
    """One row per domain: the first description, all contacts, and whether there was anything to aggregate."""
    p = extracted_pages(spark, sf_dir)
    d = p.groupBy(*KEYS).agg(F.count("company_json").alias("n"))
    described = evidence.first_value(evidence.grouped(evidence.companies(p, KEYS, "description_json"), KEYS, impressum_first=False), KEYS).withColumnRenamed("value", "description")
    people = evidence.joined_values(evidence.grouped(evidence.contacts(p, KEYS), KEYS), KEYS).withColumnRenamed("text", "contacts")
    out = d.join(described, KEYS, "left").join(people, KEYS, "left")
    return out.select(*KEYS, "description", "contacts", F.when(F.col("n") > 0, "succeeded").otherwise("failed").alias("status"))


CRAWL_SQL = f"""SELECT domain, count(*) AS pages, CASE WHEN max(status = 'failed') THEN 'failed' ELSE 'succeeded' END AS status, sum(found)::BIGINT AS found FROM (SELECT p.domain, CASE WHEN coalesce(error, '') <> '' OR {_TEXT_SQL} = '' THEN 'failed' ELSE 'succeeded' END AS status,
(SELECT count(*) FROM (SELECT *, {reason_sql('email')} AS reason FROM {_STAGE}) s WHERE s.page_id = p.page_id AND NOT ({system_sql('email')}) AND NOT {asset_sql('email')} AND {quality_sql('email')} >= 50) AS found FROM {_PAGES_SQL} p) GROUP BY 1"""


# -- model records -----------------------------------------------------------------------------


@query("SELECT count(*) AS returned, count(*) FILTER (page_id % 3 = 0) AS kept, max(length(html)) AS longest FROM pages")
def source_counters(spark, sf_dir):
    """Counters of a source taken while its rows are written: no pass of their own."""
    from leadmill.operators.ranks import scratch

    p = table(spark, sf_dir, "pages").select("page_id", "html")
    watched, seen = records.observed(p, "pages", returned=F.count("*"), kept=F.count_if(F.col("page_id") % 3 == 0), longest=F.max(F.length("html")).cast("long"))
    watched.write.parquet(scratch(spark))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("returned", "kept", "longest"))], "returned long, kept long, longest long")


@query("SELECT event_id, event_type, epoch_us(ts) AS us FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, sf_dir):
    """The last hundred events: a report."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", micros(F.col("ts")).alias("us")).orderBy(F.desc("us"), F.desc("event_id")).limit(100)
