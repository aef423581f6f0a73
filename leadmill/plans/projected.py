"""Queries whose inputs (answers, plans, sections, logs, scripts, lists) are projections of the driver's tables, each with a SQL twin that computes.

A projection is a select list that reads the same in Spark and in DuckDB, as in ``leads``: a source row with key k becomes one answer, plan
or page, whose shape depends on k, so that every branch is met at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadmill import schemas
from leadmill.functions import domain as D
from leadmill.functions import email as E
from leadmill.functions import extraction as X
from leadmill.functions import text as T
from leadmill.operators import evidence, jobs, links, merge, places, ranks, records
from leadmill.operators.nearest import nearest_to_each
from leadmill.operators.select import cosine, top_n
from leadmill.plans.enrich import _ALL_TEXTS, _EXTRACTED, _LIST, ADDRESS_SQL, _texts, asset_sql, extracted_pages, match_sql, quality_sql, reason_sql, system_sql, undisguised_sql, unescaped_sql
from leadmill.plans.leads import lead_table, sql
from leadmill.plans.registry import micros, query, shared, table
from leadmill.sources import json_store


class Projection:
    """Columns of one of the driver's tables, for Spark and for the twins."""

    def __init__(self, source: str, **columns: str):
        self.source, self.columns = source, columns

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).selectExpr(*shared(self.columns))

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(shared(self.columns))} FROM {self.source})"


def split_words(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.split(n, " ") for n in names})


_K = "CAST(c_custkey AS BIGINT)"
_S = "CAST(s_suppkey AS BIGINT)"
_P = "CAST(page_id AS BIGINT)"

# -- addresses -------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, {undisguised_sql(unescaped_sql('text'))} AS n FROM {_ALL_TEXTS}), m AS (SELECT doc_id, n, regexp_extract_all(n, {ADDRESS_SQL}) AS ms, string_split_regex(n, {ADDRESS_SQL}) AS ps FROM t WHERE regexp_matches(n, {ADDRESS_SQL})),
o AS (SELECT doc_id, n, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i: 1 + coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0)))::BIGINT AS s FROM m),
f AS (SELECT doc_id, lower(m) AS email, trim(substr(n, greatest(1, s - 50), s + length(m) + 50 - greatest(1, s - 50))) AS context,
regexp_matches(lower(substr(n, greatest(1, s - 107), s - greatest(1, s - 107))), '(?s)(support|contact).{{0,100}}$') OR regexp_matches(lower(substr(n, s + length(m), 107)), '(?s)^.{{0,100}}(support|contact)') OR regexp_matches(lower(m), 'support|contact') AS near FROM o WHERE ({reason_sql('lower(m)')}) IS NULL)
SELECT DISTINCT doc_id, email, context, max(near) OVER (PARTITION BY doc_id, email) AS near FROM f""")
def email_context(spark, sf_dir):
    """Addresses of all documents with 50 characters around them, and whether support or contact is said within 100 of one of its places."""
    d = _texts(spark, sf_dir).select("doc_id", X.unescaped(F.col("text")).alias("t")).select("doc_id", X.undisguised(F.col("t")).alias("n")).where(F.col("n").contains("@"))
    d = d.select("doc_id", F.explode(X.in_context(F.col("n"))).alias("s"), X.near_words(F.col("n"), ["support", "contact"]).alias("near"))
    return d.select("doc_id", "s.email", "s.context", F.array_contains("near", F.col("s.email")).alias("near")).distinct()


LISTS = Projection(
    "customer", id=_K, company="CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('c', c_custkey, '.de') WHEN 2 THEN concat('shop.c', c_custkey, '.de') ELSE concat('www.c', c_custkey, '.de') END",
    emails="""CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('Info@c', c_custkey, '.de info@c', c_custkey, '.de noreply@c', c_custkey, '.de max@other.com logo@2x.png') WHEN 2 THEN concat('sales@c', c_custkey, '.de hello@shop.c', c_custkey, '.de partners@other.com')
WHEN 3 THEN concat('hello@gmail.com bd@c', c_custkey, '.de legal@c', c_custkey, '.de m.m@c', c_custkey, '.de') WHEN 4 THEN 'info@firma.de x@y.de max@gmail.com' WHEN 5 THEN concat('a@c', c_custkey, '.de contact@office-firma.de') ELSE 'nobody' END""",
)
_EACH = f"(SELECT id, company, generate_subscripts(string_split(emails, ' '), 1) AS i, unnest(string_split(emails, ' ')) AS e FROM {LISTS.sql})"
_FIRST = f"(SELECT * FROM {_EACH} QUALIFY row_number() OVER (PARTITION BY id, lower(trim(e)) ORDER BY i) = 1)"
_GOOD = f"(SELECT *, {match_sql('split_part(e, ' + chr(39) + '@' + chr(39) + ', 2)', 'company')} AS own FROM (SELECT *, {reason_sql('lower(trim(e))')} AS reason FROM {_FIRST} WHERE NOT ({system_sql('e')}) AND NOT {asset_sql('e')}) WHERE {quality_sql('e')} >= 50)"


@query(f"""WITH each AS {_EACH}, good AS (SELECT * FROM {_GOOD} QUALIFY own OR company IS NULL OR NOT max(own) OVER (PARTITION BY id)), l AS {LISTS.sql}
SELECT id, coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM good g WHERE g.id = l.id), '') AS kept, coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM each g WHERE g.id = l.id AND split_part(e, '@', 2) NOT IN ('other.com', 'gmail.com', '')), '') AS unblocked,
coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM each g WHERE g.id = l.id AND split_part(e, '@', 2) = 'firma.de'), '') AS allowed,
coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM each g WHERE g.id = l.id AND NOT ({system_sql('e')}) AND NOT {asset_sql('e')} AND split_part(e, '@', 2) NOT IN {_LIST(E.FREE_MAIL)}), '') AS business FROM l""")
def email_filter_chain(spark, sf_dir):
    """The standard chain over the customers' lists, and domain lists and the free-mail filter beside it."""
    d = split_words(LISTS.df(spark, sf_dir), "emails")
    e = F.coalesce("emails", F.array().cast("array<string>"))
    words = lambda *w: F.array(*map(F.lit, w))
    shown = lambda c: F.array_join(c, " ")
    best = F.when(F.col("company").isNull(), X.standard_filters(e)).otherwise(X.standard_filters(e, F.col("company")))
    return d.select("id", shown(best).alias("kept"), shown(X.in_domains(e, blocked=words("other.com", "gmail.com"))).alias("unblocked"), shown(X.in_domains(e, allowed=words("firma.de"))).alias("allowed"), shown(X.kept(e, generic=True)).alias("business"))


_PREFER = "regexp_replace(lower(trim(company)), '^www\\.', '')"
_DOM = "regexp_replace(e, '^[^@]*@', '')"
_OUTREACH = rf"""CASE WHEN coalesce({_PREFER}, '') = '' THEN 0 WHEN {_DOM} = {_PREFER} OR ends_with({_DOM}, '.' || {_PREFER}) THEN 80 ELSE -40 END
+ CASE WHEN split_part(e, '@', 1) IN ('partners', 'partnerships') THEN 25 WHEN split_part(e, '@', 1) IN ('sales', 'bizdev', 'business', 'bd') THEN 20 WHEN split_part(e, '@', 1) IN ('hello', 'hi') THEN 15 WHEN split_part(e, '@', 1) IN ('info', 'contact', 'support') THEN 10 ELSE 0 END
- CASE WHEN split_part(e, '@', 1) IN ('abuse', 'webmaster', 'postmaster', 'noreply', 'no-reply', 'donotreply', 'do-not-reply', 'privacy', 'legal', 'security') THEN 50 ELSE 0 END
- CASE WHEN {_DOM} IN ('gmail.com', 'yahoo.com', 'outlook.com', 'hotmail.com', 'icloud.com') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(split_part(e, '@', 1), '\d|\.') THEN 2 ELSE 0 END"""


@query(f"WITH s AS (SELECT id, i, company, lower(trim(e)) AS e FROM {_EACH} WHERE contains(e, '@')), b AS (SELECT id, e FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_OUTREACH} DESC, i) = 1) SELECT l.id, b.e AS best FROM {LISTS.sql} l LEFT JOIN b ON b.id = l.id")
def outreach_pick(spark, sf_dir):
    """Whom of a customer's list to write to."""
    return split_words(LISTS.df(spark, sf_dir), "emails").select("id", X.best_outreach(F.coalesce("emails", F.array().cast("array<string>")), F.col("company")).alias("best"))


OLD = Projection(
    "customer", id=_K, text="""CASE c_custkey % 6 WHEN 0 THEN concat('Mail max', c_custkey, '@firma.de or sales (at) shop', c_custkey, ' (dot) com') WHEN 1 THEN concat('<a href="mailto:Info%40firma', c_custkey, '.de?subject=x">') WHEN 2 THEN concat('max', c_custkey, ' @spamverhindern.de @ firma.de')
WHEN 3 THEN NULL WHEN 4 THEN concat('a&#64;b', c_custkey, '.de twice a@b', c_custkey, '.de and image_1@2x.6d763021.png') ELSE concat('office', c_custkey, ' at firma.de') END""",
)


@query("""SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 6 WHEN 0 THEN concat('max', c_custkey, '@firma.de sales@shop', c_custkey, '.com') WHEN 1 THEN concat('info@firma', c_custkey, '.de') WHEN 2 THEN concat('max', c_custkey, '@firma.de') WHEN 3 THEN '' WHEN 4 THEN concat('a@b', c_custkey, '.de') ELSE concat('office', c_custkey, '@firma.de') END AS emails FROM customer""")
def email_old_rules(spark, sf_dir):
    """The older extractor on a text per customer."""
    d = OLD.df(spark, sf_dir).select("id", X.unescaped(F.col("text")).alias("t"))
    return d.select("id", F.array_join(X.old_addresses(F.col("t")), " ").alias("emails"))


# -- what models answered ------------------------------------------------------------------------------

_VOTERS = {
    "a": """concat('[{"name": "Ann', c_custkey % 3, '", "role": "CEO"}, {"name": "Bo"}]')""", "b": """concat('[{"name": "ANN', c_custkey % 3, ' ", "role": "Chef"}, {"name": "Bob", "role": "x"}, {"name": "C"}]')""",
    "c": """CASE c_custkey % 4 WHEN 0 THEN concat('[{"name": "Anna", "role": "  chef"}, {"name": "bo", "role": "X"}]') WHEN 1 THEN '[]' WHEN 2 THEN concat('[{"name": "Weiß', c_custkey % 3, '"}]') ELSE NULL END""",
}
_VOTES = {m: Projection("customer", item=_K, model=f"'{m}'", people=p) for m, p in _VOTERS.items()}
_CANON = "replace(lower(trim(regexp_replace(coalesce(v, 'None'), '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query(f"""WITH v AS ({' UNION ALL '.join(f'SELECT * FROM {p.sql}' for p in _VOTES.values())}), o AS (SELECT item, model, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS o FROM (SELECT item, model, from_json(people, '["JSON"]') AS l FROM v)),
f AS (SELECT item, model, position, unnest(json_keys(o)) AS name, o FROM o), n AS (SELECT DISTINCT item, position, name FROM f JOIN (SELECT item, len(from_json(people, '["JSON"]')) AS size FROM v WHERE model = 'a') USING (item) WHERE position < size),
c AS (SELECT n.*, o.model, json_extract_string(o.o, '$.' || n.name) AS v FROM n JOIN o USING (item, position)), g AS (SELECT item, position, name, {_CANON} AS k, count(*) AS n, min(model) AS first, arg_min(coalesce(v, chr(0)), model) AS w FROM c GROUP BY ALL),
b AS (SELECT item, position, name, arg_min(w, first) AS w FROM g WHERE n >= 2 GROUP BY ALL)
SELECT n.item, n.position::INTEGER AS position, n.name, CASE WHEN b.w IS NULL OR b.w = chr(0) THEN (SELECT v FROM c WHERE c.item = n.item AND c.position = n.position AND c.name = n.name AND c.model = 'a') ELSE b.w END AS value FROM n LEFT JOIN b ON b.item = n.item AND b.position = n.position AND b.name = n.name""")
def vote_struct_lists(spark, sf_dir):
    """Lists of objects that three models answered for each customer, voted on field by field."""
    a, b, c = (p.df(spark, sf_dir) for p in _VOTES.values())
    v = a.unionByName(b).unionByName(c).withColumn("people", F.from_json("people", "array<map<string,string>>"))
    return evidence.vote_structs(v, ["item"], "model", "people", "a").select("item", "position", "name", "value")


SECTIONS = Projection(
    "customer", id=_K, section="""CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'oops' WHEN 2 THEN concat('{"source_url": "", "extracted": {"emails": [{"email": "z@c', c_custkey, '.de", "evidence": {"quote": "mail"}}]}}')
WHEN 3 THEN concat('{"source_url": "https://c', c_custkey, '.de", "extracted": {"contacts": [{"name": "', repeat('n', 158 + c_custkey % 5), '", "role": null, "evidence": {"quote": "long name"}}]}}')
ELSE concat('{"source_url": "https://c', c_custkey, '.de", "extracted": {"emails": [{"email": " x', c_custkey, '@a.de ", "evidence": {"quote": "mail x"}}, {"email": "bad", "evidence": {"quote": "q"}}, {"email": "y@a.de"}], "contacts": [{"name": " Ann ', c_custkey, ' ", "role": "CEO", "evidence": {"quote": "', repeat('q', 297 + c_custkey % 9), '"}}, {"name": "", "evidence": {"quote": "n"}}, {"name": "Bo", "evidence": {"quote": "bo"}}]}}') END""",
)
_LONG = lambda c, low, high: f"CASE WHEN {c} IS NULL THEN '{c} missing' WHEN length({c}) < {low} THEN '{c} short' WHEN length({c}) > {high} THEN '{c} long' END"
_SECTION = f"(SELECT id, json_extract_string(section, '$.source_url') AS url, section FROM {SECTIONS.sql} WHERE json_valid(section) AND json_extract_string(section, '$.source_url') <> '')"
_QUOTE = "substr(trim(json_extract_string(x, '$.evidence.quote')), 1, 300)"


@query(f"""WITH m AS (SELECT id, url, trim(json_extract_string(x, '$.email')) AS value, {_QUOTE} AS quote FROM (SELECT id, url, unnest(from_json(json_extract(section, '$.extracted.emails'), '["JSON"]')) AS x FROM {_SECTION}) WHERE json_extract(x, '$.evidence') IS NOT NULL),
c AS (SELECT id, url, trim(json_extract_string(x, '$.name')) AS name, json_extract_string(x, '$.role') AS role, {_QUOTE} AS quote FROM (SELECT id, url, unnest(from_json(json_extract(section, '$.extracted.contacts'), '["JSON"]')) AS x FROM {_SECTION}) WHERE json_extract(x, '$.evidence') IS NOT NULL)
SELECT id, 'email' AS kind, value, NULL::VARCHAR AS role, url, length(quote)::INTEGER AS quote_length, coalesce({_LONG('quote', 5, 300)}, '') AS problems FROM m WHERE regexp_matches(value, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
UNION ALL SELECT id, 'contact', name, role, url, length(quote)::INTEGER, array_to_string(list_filter([{_LONG('name', 1, 160)}, {_LONG('quote', 5, 300)}], lambda p: p IS NOT NULL), '; ') FROM c WHERE name <> ''""")
def model_records(spark, sf_dir):
    """Sections of a model's answers, one per customer, flattened, quotes cut, lengths checked."""
    s = SECTIONS.df(spark, sf_dir)
    quote = records.short_quote(F.col("quote"))
    mails = records.section_emails(s, ["id"]).withColumn("quote", quote)
    people = records.section_contacts(s, ["id"]).withColumn("quote", quote)
    mails = records.checked(mails, {"quote": "quote"}).select("id", F.lit("email").alias("kind"), F.col("email").alias("value"), F.lit(None).cast("string").alias("role"), "url", "quote", "problems")
    people = records.checked(people, {"name": "name", "role": "role", "quote": "quote"}, optional=["role"]).select("id", F.lit("contact").alias("kind"), F.col("name").alias("value"), "role", "url", "quote", "problems")
    return mails.unionByName(people).select("id", "kind", "value", "role", "url", F.length("quote").alias("quote_length"), F.array_join("problems", "; ").alias("problems"))


# -- texts and URLs -----------------------------------------------------------------------------------------

CUSTOMER_TEXTS = Projection(
    "customer", id=f"-{_K}", text="""CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('Home', chr(10), '## Impressum', chr(10), c_name, chr(10), 'Tel 1') WHEN 2 THEN concat('net::ERR_CONNECTION_TIMED_OUT at ', c_name) WHEN 3 THEN concat('Error: x', chr(10), 'Call log:', chr(10), '  - a', chr(10), c_name, ' broke ', repeat('y', 90))
WHEN 4 THEN concat('HTTP ', 400 + c_custkey % 110) WHEN 5 THEN concat('<p>Vis', chr(173), 'ible <b>', c_name, '</b></p>', chr(10), '<i>(x)</i>(', c_custkey, ')') WHEN 6 THEN 'Empty content' ELSE concat('imprint', chr(10), repeat('t', 60 + c_custkey % 70)) END""",
)
_TOOL_TEXTS = f"(SELECT CAST(doc_id AS BIGINT) AS id, text FROM documents UNION ALL SELECT * FROM {CUSTOMER_TEXTS.sql})"
_CUT = lambda c: f"CASE WHEN length({c}) > 80 THEN substr({c}, 1, 80) || '...' ELSE {c} END"
_LINES = r"list_filter(list_transform(string_split(t, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '' AND NOT regexp_matches(l, '^(Error:|Call log:|Code context:|-|→)'))"
_ERRORS = " ".join(f"WHEN regexp_matches(t, '{part}') THEN '{name}'" for part, name in T.CRAWL_ERRORS)
_SQUEEZED = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query(rf"""SELECT id, replace(lower({_SQUEEZED('t')}), 'ß', 'ss') AS canonical, regexp_replace(regexp_extract(t, '(?ims)(^\s*(#{{1,6}}\s*)?(impressum|imprint)[ \t]*$.*)', 1), '^\s+|\s+$', '', 'g') AS tail,
CASE WHEN t = '' THEN '' {_ERRORS} WHEN contains(t, 'Empty content') THEN t WHEN len({_LINES}) > 0 THEN {_CUT(_LINES + '[1]')} ELSE {_CUT('t')} END AS error,
{_SQUEEZED("replace(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '[' || chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || ']', '', 'g'), chr(160), ' ')")} AS visible,
CASE WHEN length(text) > 90 THEN rtrim(substr(text, 1, 90)) || '…' ELSE text END AS title, array_to_string(regexp_extract_all(t, '(?s)\((.*?)\)', 1), '|') AS inside FROM (SELECT *, coalesce(text, '') AS t FROM {_TOOL_TEXTS})""")
def text_tools(spark, sf_dir):
    """Text functions on every document, and on a notice, error or page per customer."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text").unionByName(CUSTOMER_TEXTS.df(spark, sf_dir))
    t = F.col("text")
    return d.select("id", T.canonical(t).alias("canonical"), T.impressum_tail(t).alias("tail"), T.crawl_error(t).alias("error"), T.visible_text(t).alias("visible"), T.truncated(t, 90).alias("title"), F.array_join(X.between(t, "(", ")"), "|").alias("inside"))


MARKED = Projection("customer", id=_K, text="CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat(' **', c_name, '** and __', c_mktsegment, '__ and *soft', c_custkey, '* and _thin_ snake_case_x  two', chr(10), chr(10), chr(10), chr(10), 'lines', chr(10)) END")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat(c_name, ' and ', c_mktsegment, ' and soft', c_custkey, ' and thin snake_case_x two', chr(10), chr(10), 'lines') END AS plain FROM customer")
def emphasis_removed(spark, sf_dir):
    """Model output without its marks, one text per customer."""
    return MARKED.df(spark, sf_dir).select("id", T.without_emphasis(F.col("text")).alias("plain"))


URLS = Projection("pages", id=_P, url="CASE page_id % 6 WHEN 1 THEN replace(url, 'http', 'HTTP') WHEN 2 THEN split_part(url, '/', 3) WHEN 3 THEN concat('https://www.', split_part(url, '/', 3), ':8080/a/') WHEN 4 THEN NULL WHEN 5 THEN concat('https://example.com/', page_id) ELSE url END")
_URL_HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_BARE = f"regexp_replace({_URL_HOST}, '^www\\.', '')"


@query(rf"""SELECT id, {_URL_HOST} AS host, {_BARE} AS api_domain, nullif(regexp_replace(regexp_replace(lower(url), '^([a-z]+://)?(www\.)?', ''), '[/?#:].*$', ''), '') AS domain,
'https://' || regexp_replace(replace(replace(coalesce(url, ''), 'https://', ''), 'http://', ''), '^/+|/+$', '', 'g') AS home, {_BARE} <> '' AND ({_BARE} = 'example.com' OR ends_with({_BARE}, '.example.com')) AS same FROM {URLS.sql}""")
def url_parts(spark, sf_dir):
    """Hosts, home pages and same-site checks of all pages' URLs, in several spellings."""
    u = F.col("url")
    return URLS.df(spark, sf_dir).select("id", D.host(u).alias("host"), D.bare_host(u).alias("api_domain"), D.normalize_domain(u).alias("domain"), D.home_url(u).alias("home"), D.same_site(u, F.lit("www.example.com")).alias("same"))


# -- pages of sites -----------------------------------------------------------------------------------------

_ADDED = """CASE page_id % 8 WHEN 0 THEN '<a href="/impressum">Impressum</a><a href="/about-us">About us</a>' WHEN 1 THEN concat('<button onclick="location.href=', chr(39), '/i.php', chr(39), '">Impressum</button>')
WHEN 2 THEN concat('<script>function openImpressum() { window.open(', chr(39), '/legal/impressum.html', chr(39), '); }</script><a href="#" onclick="openImpressum()">Impressum</a>') WHEN 3 THEN '<a href="/contact">Kontakt</a>' WHEN 4 THEN '<a href="/imprint">x</a><a href="/ueber-uns">Wer</a>' WHEN 5 THEN '<a href="/datenschutz">y</a>' ELSE '' END"""
SITES = Projection("pages", page_id=_P, url="url", html=f"concat('<html><body>', {_ADDED}, '<p>', split_part(html, '</p>', 2), '</p></body></html>')", links_json="""CASE WHEN page_id % 8 = 7 THEN '{"internal": [{"href": "/notice", "text": "Imprint"}], "external": []}' END""")
_ROOT = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')"
_PATH = "CASE page_id % 8 WHEN 0 THEN '/impressum' WHEN 1 THEN '/i.php' WHEN 2 THEN '/legal/impressum.html' WHEN 4 THEN '/imprint' WHEN 7 THEN '/notice' END"


@query(f"""SELECT CAST(page_id AS BIGINT) AS page_id, CASE page_id % 8 WHEN 0 THEN CASE WHEN {_ROOT} IN (SELECT {_ROOT} FROM pages WHERE page_id % 16 = 0) THEN '1' ELSE '2' END WHEN 1 THEN '2' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '5.2' WHEN 5 THEN '5.3' WHEN 6 THEN '4' ELSE '2' END AS contact_case,
{_ROOT} || {_PATH} AS imprint_url, {_ROOT} || CASE page_id % 8 WHEN 0 THEN '/about-us' WHEN 4 THEN '/ueber-uns' END AS about_url, CASE page_id % 8 WHEN 0 THEN 'about_anchor' WHEN 4 THEN 'about_link' WHEN 6 THEN NULL ELSE 'about_not_found' END AS about_case FROM pages""")
def contact_cases(spark, sf_dir):
    """How each page's site names itself, its notice and its about page: by link texts, buttons, scripts, named links or URLs alone.

    A notice belongs to its URL, so pages of one host share it.
    """
    sites = SITES.df(spark, sf_dir)
    notices = sites.where("page_id % 16 = 0").select(F.concat(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*", 0), F.lit("/impressum")).alias("url"), F.lit("# Impressum\nTea").alias("markdown"))
    return links.site_links(sites, notices.select("url", T.impressum_tail(F.col("markdown")).alias("tail")).distinct())


@query(f"""SELECT CAST(page_id AS BIGINT) AS page_id, kind, tier, {_ROOT} || path AS url FROM pages JOIN (VALUES (0, 'impressum', 2, '/impressum'), (0, 'about', 2, '/about-us'), (1, 'impressum', 3, '/i.php'), (2, 'impressum', 4, '/legal/impressum.html'), (3, 'contact', 2, '/contact'), (7, 'impressum', 1, '/notice')) v(m, kind, tier, path) ON page_id % 8 = m""")
def tier_sites(spark, sf_dir):
    """Links of every page's site from named links, anchors, buttons or called functions, whichever comes first."""
    return links.discovered(SITES.df(spark, sf_dir)).select("page_id", "kind", "tier", "url")


RAW = Projection("pages", id=_P, raw="""CASE page_id % 5 WHEN 0 THEN concat('["', url, '", " http://b.de ", "c", ""]') WHEN 1 THEN concat('{"internal": [{"href": "', url, '"}, {"url": "https://b.de"}, {"link": "HTTP://c.de"}, {"x": 1}], "external": ["https://d', page_id, '.de"], "n": []}') WHEN 2 THEN NULL WHEN 3 THEN 'oops' ELSE '{}' END""")


@query("SELECT CAST(page_id AS BIGINT) AS id, CASE page_id % 5 WHEN 0 THEN url || ' http://b.de' WHEN 1 THEN concat(url, ' https://b.de HTTP://c.de https://d', page_id, '.de') ELSE '' END AS urls FROM pages")
def flat_links(spark, sf_dir):
    """Polymorphic link lists of all pages made flat."""
    return RAW.df(spark, sf_dir).select("id", F.array_join(F.coalesce(links.flat_links(F.col("raw")), F.array().cast("array<string>")), " ").alias("urls"))


# -- discovery ------------------------------------------------------------------------------------------------

_SITE3 = "CASE s_suppkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '\"https://facebook.com/x\"' WHEN 2 THEN '\"  \"' ELSE concat('\"localhost', s_suppkey % 3, '\"') END"
ANSWERS = Projection(
    "supplier", call=_S, text_query="concat('q', s_nationkey % 5)", location="CASE WHEN s_suppkey % 2 = 0 THEN 'DE/Berlin' ELSE 'AT' END",
    places=f"""CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 17 = 0 THEN '[]' ELSE concat('[{{"websiteUri": "https://www.S', s_suppkey % 40, '.de/x", "displayName": {{"text": " S', s_suppkey % 4, ' "}}, "primaryType": "store", "types": []}}, {{"websiteUri": "https://bar', s_suppkey, '.de", "displayName": {{"text": "Bar"}}, "primaryType": "', CASE WHEN s_suppkey % 3 = 0 THEN 'Bar ' ELSE 'shop' END, '", "types": [', CASE WHEN s_suppkey % 5 = 0 THEN '"shop", " ATM"' ELSE '' END, ']}}, {{"websiteUri": ', {_SITE3}, ', "primaryType": null}}]') END""",
)
_PLACES = """(SELECT call, pos, query, location, organization, domain, excluded, NOT excluded AND coalesce(domain = 'facebook.com', false) AS social FROM (
SELECT CAST(s_suppkey AS BIGINT) AS call, pos, concat('q', s_nationkey % 5) AS query, CASE WHEN s_suppkey % 2 = 0 THEN 'DE/Berlin' ELSE 'AT' END AS location, CASE pos WHEN 0 THEN concat('S', s_suppkey % 4) WHEN 1 THEN 'Bar' ELSE 'Unknown' END AS organization,
CASE pos WHEN 0 THEN concat('s', s_suppkey % 40, '.de') WHEN 1 THEN concat('bar', s_suppkey, '.de') ELSE CASE s_suppkey % 4 WHEN 1 THEN 'facebook.com' WHEN 3 THEN concat('localhost', s_suppkey % 3) END END AS domain, pos = 1 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0) AS excluded
FROM supplier, (VALUES (0), (1), (2)) p(pos) WHERE s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0) WHERE excluded OR domain IS NOT NULL)"""


@query(f"SELECT domain, query, location, organization FROM {_PLACES} WHERE NOT excluded AND NOT social QUALIFY row_number() OVER (PARTITION BY domain ORDER BY call DESC, pos DESC) = 1")
def places_leads(spark, sf_dir):
    """Leads of captured place answers, one answer per supplier, the last of each domain."""
    return places.run_places(places.leads_of(ANSWERS.df(spark, sf_dir)))[0]


@query(f"""SELECT query, count(*) FILTER (good AND b IS NULL) AS added, count(*) FILTER (good AND b <> l) AS updated, count(*) FILTER (good AND b = l) AS ignored, count(*) FILTER (excluded) AS excluded, count(*) FILTER (social) AS social, count(*) AS returned, round(count(*) FILTER (good AND b IS NULL) / count(*)::DOUBLE, 4) AS kept_rate
FROM (SELECT *, query || '|' || location || '|' || organization AS l, lag(query || '|' || location || '|' || organization) OVER (PARTITION BY domain, good ORDER BY call, pos) AS b FROM (SELECT *, NOT excluded AND NOT social AS good FROM {_PLACES})) GROUP BY 1""")
def places_counters(spark, sf_dir):
    """What became of the places of each query."""
    return places.run_places(places.leads_of(ANSWERS.df(spark, sf_dir)))[1]


_GEO_PART = lambda kind, long, short: f"""concat('{{"long_name": "', {long}, '", "short_name": "', {short}, '", "types": ["{kind}"]}}')"""
_COUNTRY = _GEO_PART("country", "concat('Land ', s_suppkey % 50)", "concat('L', s_suppkey % 50)")
_SHAPE = """concat('{"location": {"lat": ', s_suppkey % 90, '.5, "lng": ', s_suppkey % 180, '.25}, "viewport": {"northeast": {"lat": ', s_suppkey % 90 + 1, ', "lng": ', s_suppkey % 180 + 1, '}, "southwest": {"lat": ', s_suppkey % 90, ', "lng": ', s_suppkey % 180, '}}}')"""
_RESULT = lambda types, parts, shape=_SHAPE: f"""concat('{{"status": "OK", "results": [{{"types": {types}, "address_components": [', {parts}, '], "geometry": ', {shape}, '}}]}}')"""
_CITY, _STATE = _GEO_PART("locality", "s_name", "s_name"), _GEO_PART("administrative_area_level_1", "concat('State ', s_suppkey % 7)", "'ST'")
GEO = Projection(
    "supplier", token="s_name", response=f"""CASE s_suppkey % 9 WHEN 0 THEN {_RESULT('["country"]', f"concat({_STATE}, ', ', {_COUNTRY})")} WHEN 1 THEN {_RESULT('["locality", "political"]', f"concat({_CITY}, ', ', {_STATE}, ', ', {_COUNTRY})")} WHEN 2 THEN {_RESULT('["administrative_area_level_1"]', f"concat({_CITY}, ', ', {_STATE}, ', ', {_COUNTRY})")}
WHEN 3 THEN '{{"status": "ZERO_RESULTS", "results": []}}' WHEN 4 THEN '{{' WHEN 5 THEN NULL WHEN 6 THEN {_RESULT('["continent"]', _COUNTRY)} WHEN 7 THEN {_RESULT('["locality"]', _CITY)} ELSE {_RESULT('["country"]', _COUNTRY, "'{}'")} END""",
)
_NAMED = lambda t, f: f"json_extract_string(list_filter(parts, lambda p: list_contains(from_json(json_extract(p, '$.types'), '[\"VARCHAR\"]'), '{t}'))[-1], '$.{f}')"
_NUM = lambda p: f"CAST(json_extract_string(r, '$.geometry.{p}') AS DOUBLE)"
_GEO_SQL = f"""(WITH g AS (SELECT token, json_extract(response, '$.results[0]') AS r FROM {GEO.sql} WHERE json_valid(response) AND json_extract_string(response, '$.status') = 'OK'),
p AS (SELECT token, r, from_json(json_extract(r, '$.types'), '["VARCHAR"]') AS types, from_json(json_extract(r, '$.address_components'), '["JSON"]') AS parts FROM g WHERE json_extract(r, '$.geometry.location') IS NOT NULL AND json_extract(r, '$.geometry.viewport') IS NOT NULL),
k AS (SELECT *, CASE WHEN list_has_any(types, ['locality', 'sublocality']) THEN 'city' WHEN list_contains(types, 'administrative_area_level_1') THEN 'state' WHEN list_contains(types, 'country') THEN 'country' END AS kind, {_NAMED('country', 'short_name')} AS country FROM p),
f AS (SELECT token, kind, CASE WHEN kind = 'city' THEN {_NAMED('locality', 'long_name')} END AS city, CASE WHEN kind <> 'country' THEN {_NAMED('administrative_area_level_1', 'long_name')} END AS state, country, {_NAMED('country', 'long_name')} AS country_name, {_NUM('location.lat')} AS lat, {_NUM('location.lng')} AS lng,
{_NUM('viewport.southwest.lat')} AS low_lat, {_NUM('viewport.southwest.lng')} AS low_lng, {_NUM('viewport.northeast.lat')} AS high_lat, {_NUM('viewport.northeast.lng')} AS high_lng FROM k WHERE kind IS NOT NULL AND country IS NOT NULL)
SELECT * FROM f WHERE kind <> 'country' OR country NOT IN (SELECT country FROM f WHERE kind <> 'country'))"""


@query(f"SELECT * FROM {_GEO_SQL}")
def geo_resolve(spark, sf_dir):
    """Geocoder answers, one per supplier, to locations; a country goes beside a city or state of it."""
    return places.resolved(GEO.df(spark, sf_dir))


_DEFAULTS = ", ".join(f"('{c}', {lat}::DOUBLE)" for c, _, lat, _ in places.DEFAULTS)


@query(f"SELECT 'given' AS case, country, lat FROM {_GEO_SQL} UNION ALL SELECT 'none', * FROM (VALUES {_DEFAULTS}) v(country, lat) WHERE NOT EXISTS (SELECT 1 FROM {_GEO_SQL} WHERE lat > 1000)")
def geo_default(spark, sf_dir):
    """The suppliers' locations where there are any, else the default countries."""
    some = places.resolved(GEO.df(spark, sf_dir))
    given = places.or_default(some).select(F.lit("given").alias("case"), "country", "lat")
    return given.unionByName(places.or_default(some.where("lat > 1000")).select(F.lit("none").alias("case"), "country", "lat"))


PLANS = Projection(
    "customer", plan="""CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '{broken' WHEN 2 THEN concat('{"prompt_target": "no request ', c_custkey, '"}') WHEN 3 THEN concat('{"request_id": "r', c_custkey, '", "prompt_keywords": ["services", "Company"]}')
WHEN 4 THEN concat('{"request_id": "r', c_custkey, '", "prompt_keywords": ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k"], "global_search": true, "prompt_location": ["x"]}')
ELSE concat('{"request_id": " r', c_custkey, ' ", "prompt_target": " ", "prompt_target_en": "', c_name, '", "prompt_keywords": ["', c_mktsegment, '!", "', lower(c_mktsegment), '", "Company", "", "Mate ', c_custkey, '"], "places_text_queries": ["Tea", " tea ", "', c_name, '", "Cha", "Chai"], "prompt_location": ["Berlin", "', c_name, '"], "sheet_id": "", "google_sheet_id": "s', c_custkey % 9, '", "resolved_locations": [{"country": "DE", "city": " B', c_custkey % 4, '"}, {"country": "DE", "city": "B', c_custkey % 3, '"}, {"country": "AT", "state": "Wien"}, {"continent": "Europe"}, {"business_region": "EMEA"}, {"city": "lost"}]}') END""",
)
_TEXTS = lambda p: f"coalesce(from_json(json_extract(plan, '$.{p}'), '[\"VARCHAR\"]'), [])"
_ONCE = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_BANNED = ", ".join(f"'{w}'" for w in places.BANNED)
_WORDS = f"list_filter(list_transform({_TEXTS('prompt_keywords')}, lambda w: regexp_replace(lower(trim(w)), '[^a-z]', '', 'g')), lambda w: w <> '' AND w NOT IN ({_BANNED}))"
_ASKED = f"list_filter(list_transform({_TEXTS('places_text_queries')}, lambda q: trim(q)), lambda q: q <> '')"
_PLACE = lambda f: f"nullif(trim(json_extract_string(x, '$.{f}')), '')"
_AT = f"coalesce('country=' || {_PLACE('country')} || ';city=' || {_PLACE('city')}, 'country=' || {_PLACE('country')}, 'continent=' || {_PLACE('continent')}, 'business_region=' || coalesce({_PLACE('region')}, {_PLACE('business_region')}))"


@query(f"""WITH j AS (SELECT CASE WHEN json_valid(plan) THEN plan END AS plan FROM {PLANS.sql}),
p AS (SELECT nullif(trim(json_extract_string(plan, '$.request_id')), '') AS request_id, coalesce(nullif(trim(json_extract_string(plan, '$.prompt_target')), ''), nullif(trim(json_extract_string(plan, '$.prompt_target_en')), '')) AS target, coalesce(nullif(trim(json_extract_string(plan, '$.sheet_id')), ''), nullif(trim(json_extract_string(plan, '$.google_sheet_id')), '')) AS sheet_id,
{_WORDS} AS w, {_ASKED} AS q, CASE WHEN coalesce(json_extract_string(plan, '$.global_search'), '') <> 'true' AND json_extract(plan, '$.prompt_location') IS NOT NULL THEN array_to_string({_TEXTS('prompt_location')}, '|') END AS prompt_location,
list_filter(list_transform(coalesce(from_json(json_extract(plan, '$.resolved_locations'), '["JSON"]'), []), lambda x: {_AT}), lambda x: x IS NOT NULL) AS l FROM j WHERE plan IS NOT NULL),
g AS (SELECT * FROM p WHERE request_id IS NOT NULL AND (target IS NOT NULL OR len(w) > 0))
SELECT request_id, target, sheet_id, array_to_string(({_ONCE('w')})[1:10], ' ') AS keywords, array_to_string((list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(y)), lower(x)) = i))[1:3], '|') AS queries, prompt_location, array_to_string({_ONCE('l')}, '|') AS locations, (SELECT count(*) FROM j) - (SELECT count(*) FROM g) AS rejected FROM g""")
def search_plan_parse(spark, sf_dir):
    """Plans, one per customer, to typed requests, and how many are none."""
    d, bad = places.parse_plans(PLANS.df(spark, sf_dir))
    joined = lambda c, s: F.array_join(c, s).alias(c)
    return d.select("request_id", "target", "sheet_id", joined("keywords", " "), joined("queries", "|"), joined("prompt_location", "|"), joined("locations", "|")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("rejected"))))


RECTANGLES = Projection(
    "customer", id=_K, country="CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('C', c_nationkey) END", state="CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Wien' END", city="CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END",
    low_lat="CASE c_custkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE concat(c_custkey % 90, '.5') END", low_lng="CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '-1' END", high_lat="'1e2'", high_lng="concat(' ', c_custkey % 180, ' ')",
)
_CORNERS = ("low_lat", "low_lng", "high_lat", "high_lng")


@query(f"""SELECT id, {' AND '.join(f'try_cast({c} AS DOUBLE) IS NOT NULL' for c in _CORNERS)} AS valid, array_to_string(list_filter([nullif(trim(country), ''), nullif(trim(state), ''), nullif(trim(city), '')], lambda x: x IS NOT NULL), '/') AS path,
coalesce(nullif(array_to_string(list_filter(['COUNTRY:' || nullif(trim(country), ''), 'STATE:' || nullif(trim(state), ''), 'CITY:' || nullif(trim(city), '')], lambda x: x IS NOT NULL), ','), ''), 'NONE') AS shown FROM {RECTANGLES.sql}""")
def rectangles(spark, sf_dir):
    """Rectangles and places of all customers: which are valid, and how a place is written."""
    corner = lambda a: F.struct(F.col(f"{a}_lat").alias("latitude"), F.col(f"{a}_lng").alias("longitude")).alias(a)
    place = [F.col(c) for c in ("country", "state", "city")]
    return RECTANGLES.df(spark, sf_dir).select("id", places.valid_rectangle(F.struct(corner("low"), corner("high"))).alias("valid"), places.location_path(*place).alias("path"), places.location_shown(*place).alias("shown"))


DISCOVERED = Projection(
    "supplier", call=_S, headcount="CASE s_suppkey % 3 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' ELSE '51-200' END", keyword="concat('k', s_nationkey % 4)",
    response="""CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'oops' WHEN s_suppkey % 7 = 0 THEN '{"meta": {}, "data": []}' ELSE concat('{"meta": {"results": ', s_suppkey % 5, '}, "data": [{"domain": "S', s_suppkey % 60, '.de", "organization": "Org ', s_suppkey, '"}, {"domain": "facebook.com", "organization": "FB"}, {"domain": "", "organization": "x"}, {"domain": "www.t', s_suppkey % 7, '.de", "organization": null}]}') END""",
)


@query(f"""WITH d AS (SELECT * FROM {DISCOVERED.sql}), c AS (SELECT call, headcount, keyword AS query, generate_subscripts(l, 1) AS pos, unnest(l) AS x FROM (SELECT *, from_json(json_extract(response, '$.data'), '["JSON"]') AS l FROM d WHERE json_valid(response))),
r AS (SELECT call, pos, regexp_replace(lower(json_extract_string(x, '$.domain')), '^www\\.', '') AS domain, json_extract_string(x, '$.organization') AS organization, headcount, query FROM c)
SELECT domain, organization, headcount, query, (SELECT count(*) FROM d) AS calls, (SELECT sum(coalesce(CAST(json_extract_string(response, '$.meta.results') AS BIGINT), 0))::BIGINT FROM d WHERE json_valid(response)) AS total FROM r WHERE domain NOT IN ('', 'facebook.com') QUALIFY row_number() OVER (PARTITION BY domain ORDER BY call DESC, pos DESC) = 1""")
def discovery_run(spark, sf_dir):
    """Answers of a company search, one per supplier: flattened, social sites out, the last of each domain kept."""
    d = DISCOVERED.df(spark, sf_dir).withColumn("r", F.from_json("response", "meta struct<results:bigint>, data array<struct<domain:string,organization:string>>"))
    totals = d.agg(F.count("*").alias("calls"), F.sum(F.coalesce("r.meta.results", F.lit(0))).alias("total"))
    rows = d.select("call", "headcount", F.col("keyword").alias("query"), F.posexplode("r.data").alias("pos", "c"))
    rows = rows.select("call", "pos", D.normalize_domain(F.col("c.domain")).alias("domain"), F.col("c.organization").alias("organization"), "headcount", "query").where("domain is not null").where(~D.is_social(F.col("domain")))
    out = merge.upsert(rows.limit(0), rows, ["domain"], [F.desc("call"), F.desc("pos")])
    return out.select("domain", "organization", "headcount", "query").crossJoin(F.broadcast(totals))


# -- indexes and stores in JSON files ------------------------------------------------------------------------------

_INDEXED = {"name": "CASE vec_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat('v', vec_id) END", "bad": "vec_id % 7 = 2"}
_SCORED = "SELECT 'v' || vec_id AS name, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(len(embedding)), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS score FROM embeddings WHERE vec_id % 9 > 1 AND vec_id % 7 <> 2"


def _index(spark, sf_dir) -> DataFrame:
    """The vectors as an index: some without a name, some cut short or with a hole."""
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding", *shared(_INDEXED))
    holed = F.transform("embedding", lambda x, i: F.when(i != 3, x))
    return v.select("vec_id", "name", F.when(~F.col("bad"), F.col("embedding")).when(F.col("vec_id") % 2 == 0, holed).otherwise(F.slice("embedding", 1, 5)).alias("embedding"))


def _scored(rows: DataFrame) -> DataFrame:
    wave = F.transform("embedding", lambda x, i: (i % 2 == 0).cast("double"))
    return rows.select("name", F.round(cosine(F.col("embedding"), wave), 6).alias("score"))


@query(_SCORED)
def index_match(spark, sf_dir):
    """Rows of an index that are valid, scored against one vector."""
    return _scored(places.valid_index(_index(spark, sf_dir), 64))


@query(_SCORED)
def index_file_match(spark, sf_dir):
    """The same from index files, a JSON list of a hundred vectors each."""
    path = ranks.scratch(spark)
    item = F.to_json(F.struct(F.col("name").alias("industry"), "embedding"), {"ignoreNullFields": "false"})
    files = _index(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 100).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ", "), F.lit("]")).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    return _scored(places.valid_index(json_store.index_rows(spark, path), 64))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10""")
def cosine_many(spark, sf_dir):
    """The ten rows closest to every twentieth vector."""
    v = table(spark, sf_dir, "embeddings")
    return nearest_to_each(v, v.where("vec_id % 20 = 0"), 10)


_STATE_OF = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' END"


def _log(spark, sf_dir) -> DataFrame:
    """Events as lines of a job log, a job per user; some lines are none."""
    e = table(spark, sf_dir, "events").withColumns({"us": micros(F.col("ts")), "state": F.expr(_STATE_OF)})
    # Some names of an entry are left out where they are null.
    line = F.to_json(F.struct(
        F.concat(F.lit(" j"), "user_id", F.lit(" ")).alias("job_id"), F.when(F.col("user_id") % 4 == 0, " ").when(F.col("user_id") % 4 == 1, "Hunter IO").otherwise("hunter-io").alias("tool"), F.concat(F.lit("r"), F.col("user_id") % 5).alias("request_id"), "state", F.col("us").alias("at_us"),
        F.when(F.col("event_type") == "click", F.col("event_type")).alias("phase"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("current"), F.when(F.col("event_type") == "error", F.concat(F.lit("boom "), "event_id")).alias("error"), F.create_map(F.concat(F.lit("m"), F.col("event_id") % 3), F.col("event_id").cast("string")).alias("metrics"),
    ))
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 31 == 0, "not json").when(F.col("event_id") % 37 == 1, F.replace(line, F.lit('"request_id":"r'), F.lit('"request_id":" "," ":"r'))).otherwise(line).alias("value"))


_LOGGED = f"(SELECT *, 'j' || user_id AS job_id, epoch_us(ts) AS us, {_STATE_OF} AS state, CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE 'hunter_io' END AS tool, 'r' || user_id % 5 AS request_id FROM events WHERE event_id % 31 <> 0 AND event_id % 37 <> 1)"
_JOBS = f"""(SELECT job_id, any_value(tool) AS tool, any_value(request_id) AS request_id, arg_max(state, us) AS state, min(us) FILTER (state = 'RUNNING') AS started_us, max(us) FILTER (state IN ('SUCCEEDED', 'FAILED')) AS finished_us, max(us) AS updated_us, arg_max('click', us) FILTER (event_type = 'click') AS phase, arg_max(event_id, us) FILTER (event_type = 'click') AS current,
arg_max(event_id, us) FILTER (event_id % 3 = 0) AS m0, arg_max(event_id, us) FILTER (event_id % 3 = 1) AS m1, arg_max(event_id, us) FILTER (event_id % 3 = 2) AS m2, arg_max('boom ' || event_id, us) FILTER (event_type = 'error') AS last_error FROM {_LOGGED} GROUP BY job_id)"""


@query(f"""WITH j AS {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id, tool ORDER BY updated_us DESC, job_id DESC) AS a, row_number() OVER (PARTITION BY tool ORDER BY updated_us DESC, job_id DESC) AS b, row_number() OVER (ORDER BY updated_us DESC, job_id DESC) AS c FROM j)
SELECT job_id, tool, request_id, state, started_us, finished_us, updated_us, phase, current, array_to_string(list_filter(['m0=' || m0, 'm1=' || m1, 'm2=' || m2], lambda x: x IS NOT NULL), ',') AS metrics, CASE WHEN state = 'FAILED' THEN last_error END AS error,
array_to_string(list_filter([CASE WHEN a = 1 THEN 'request+tool' END, CASE WHEN b = 1 THEN 'tool' END, CASE WHEN c = 1 THEN 'all' END], lambda x: x IS NOT NULL), ',') AS latest_of, (SELECT count(*) FROM events WHERE event_id % 31 = 0 OR event_id % 37 = 1) AS rejected FROM r""")
def job_log(spark, sf_dir):
    """All events as a log of job entries, folded to a job per user, and which is the last of its request and tool, of its tool, of all."""
    log, bad = jobs.read_log(_log(spark, sf_dir))
    # Jobs are far fewer than entries: they are kept, so that the log is folded once and not for each of the three as well.
    path = ranks.scratch(spark)
    jobs.fold(log).write.parquet(path)
    j = out = spark.read.parquet(path)
    for keys, name in ((["request_id", "tool"], "request+tool"), (["tool"], "tool"), ([], "all")):
        out = out.join(jobs.latest(j, keys).select("job_id", F.lit(name).alias(f"_{name[0]}")), "job_id", "left")
    rejected = bad.agg(F.count("*").alias("rejected"))
    shown = F.array_join(F.transform(F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    out = out.crossJoin(F.broadcast(rejected)).withColumns({"metrics": shown, "latest_of": F.concat_ws(",", "_r", "_t", "_a")})
    return out.select("job_id", "tool", "request_id", "state", "started_us", "finished_us", "updated_us", "phase", "current", "metrics", "error", "latest_of", "rejected")


@query(f"SELECT row_number() OVER (ORDER BY updated_us DESC, job_id) AS rank, job_id, tool, state, updated_us FROM (SELECT job_id, any_value(tool) AS tool, arg_max(state, us) FILTER (event_type <> 'click') AS state, max(us) FILTER (event_type <> 'click') AS updated_us FROM {_LOGGED} GROUP BY 1) WHERE updated_us IS NOT NULL")
def job_store_scan(spark, sf_dir):
    """Store files, a JSON object of ten users' jobs each, every job in its last state: the valid entries, newest first."""
    path = ranks.scratch(spark)
    log, _ = jobs.read_log(_log(spark, sf_dir))
    last = log.where("state is not null").groupBy("job_id").agg(F.max_by(F.struct("job_id", "tool", "request_id", "state", "at_us"), "at_us").alias("e"))
    entry = F.concat(F.lit('"'), F.col("job_id"), F.lit('": '), F.to_json("e"))
    file = (F.substring("job_id", 2, 20).cast("long") / 10).cast("long")
    stores = last.groupBy(file.alias("file")).agg(F.concat(F.lit('{"bad": {"tool": "x"}, "worse": 7, '), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    stores.repartition("file").write.partitionBy("file").text(path)
    found, _ = jobs.read_log(json_store.entries(spark, path))
    return ranks.numbered(jobs.fold(found), [F.desc("updated_us"), F.asc("job_id")], "rank").select("rank", "job_id", "tool", "state", "updated_us")


OLDER = Projection("orders", request_id="concat('r', o_orderkey)", domain="CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('c', o_custkey, '.de') END", organisation="o_orderpriority", updated_at="CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('2024-05-', 10 + o_orderkey % 20, ' 10:00:00') END", gone="o_orderstatus")


@query(f"SELECT request_id, NULL::VARCHAR AS job_id, domain, organisation, NULL::VARCHAR AS company, NULL::VARCHAR AS send_status, epoch_us(updated_at::TIMESTAMP) AS updated_us FROM {OLDER.sql}")
def schema_conform(spark, sf_dir):
    """Orders as rows of an older table, in today's columns: missing ones null, others gone, types cast."""
    d = schemas.conform(OLDER.df(spark, sf_dir), schemas.TABLES["mail_content"])
    return d.select("request_id", "job_id", "domain", "organisation", "company", "send_status", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


# -- smaller steps of the loops ----------------------------------------------------------------------------------------


@query(f"SELECT domain, url, m.request_id FROM (SELECT domain, url, seq FROM {_EXTRACTED}) p JOIN (SELECT domain, request_id FROM {sql('master')} WHERE crawl_status = 'succeeded') m USING (domain) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq DESC, m.request_id DESC) = 1")
def previous_success_page(spark, sf_dir):
    """Of each domain that a request crawled with success before, the page captured last and that request."""
    good = lead_table(spark, sf_dir, "master").where("crawl_status = 'succeeded'").select("domain", "request_id")
    pages = extracted_pages(spark, sf_dir).select("domain", "url", "seq").join(good, "domain")
    return merge.last_per_key(pages, ["domain"], [F.desc("seq"), F.desc("request_id")]).select("domain", "url", "request_id")


@query(f"WITH e AS (SELECT DISTINCT lower(trim(e)) AS email, min(id) OVER (PARTITION BY lower(trim(e))) AS first_id FROM {_EACH} WHERE contains(e, '@')) SELECT split_part(email, '@', 2) AS domain, (row_number() OVER (PARTITION BY split_part(email, '@', 2) ORDER BY first_id, email))::INTEGER AS position, email FROM e")
def emails_by_domain(spark, sf_dir):
    """The addresses of all lists under their domains, in the order first seen; a row each, so that a domain of many is no list in one row."""
    each = split_words(LISTS.df(spark, sf_dir), "emails").select("id", F.explode("emails").alias("e")).where("e like '%@%'")
    seen = each.groupBy(F.lower(F.trim("e")).alias("email")).agg(F.min("id").alias("first_id"))
    w = Window.partitionBy("domain").orderBy("first_id", "email")
    return seen.withColumn("domain", E.domain_part(F.col("email"))).select("domain", F.row_number().over(w).alias("position"), "email")


@query(f"SELECT request_id, CAST(count(*) FILTER (crawl_status = 'succeeded') AS BIGINT) AS finished, (SELECT count(*) FROM {sql('master')} WHERE crawl_status = 'succeeded') AS updated FROM {sql('master')} GROUP BY 1")
def bulk_finalize(spark, sf_dir):
    """Crawled rows get their job in one update, which says how many it changed."""
    after, counted = merge.finalize(lead_table(spark, sf_dir, "master"), F.col("crawl_status") == "succeeded", job_id="finished")
    return after.groupBy("request_id").agg(F.count_if(F.col("job_id") == "finished").alias("finished")).crossJoin(F.broadcast(counted))


@query(f"SELECT row_number() OVER (ORDER BY seq DESC, url) AS rank, domain, url FROM {_EXTRACTED} WHERE page_type <> 'other'")
def stage_one_newest(spark, sf_dir):
    """What stage one stored, newest first, of pages of a known type."""
    return ranks.numbered(extracted_pages(spark, sf_dir).where("page_type <> 'other'").select("domain", "url", "seq"), [F.desc("seq"), F.asc("url")], "rank").select("rank", "domain", "url")


@query(f"""WITH k AS (SELECT DISTINCT email FROM {sql('mail_tracker')}), m AS (SELECT id, i, e, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM {_EACH} WHERE lower(e) IN (SELECT email FROM k))
SELECT id, n::INTEGER AS n, e AS email FROM m WHERE n <= 2""")
def known_addresses(spark, sf_dir):
    """Of each list the first two addresses that the tracker knows, in the list's order."""
    each = split_words(LISTS.df(spark, sf_dir), "emails").select("id", F.posexplode("emails").alias("i", "email"))
    known = lead_table(spark, sf_dir, "mail_tracker").select(F.col("email").alias("_k")).distinct()
    return top_n(each.join(known, F.lower("email") == F.col("_k"), "left_semi"), ["id"], [F.asc("i")], 2, "n").select("id", "n", "email")
