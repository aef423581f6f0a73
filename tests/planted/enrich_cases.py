"""Planted rows for operators of ``plans.enrich``, with the rows they must give."""

from __future__ import annotations
from pyspark.sql import functions as F
from leadmill.functions import domain as D
from leadmill.functions import email as E
from leadmill.functions import extraction as X
from leadmill.functions import text as T
from leadmill.operators import evidence, records
from leadmill.plans.registry import Sample

from planted import case
from leadmill.plans.enrich import ADDRESS_SQL, TEXTS, _LIST, asset_sql, match_sql, quality_sql, reason_sql, system_sql, undisguised_sql, unescaped_sql

LISTS = Sample(
    "id long, company string, emails array<string>",
    (
        (1, "firma.de", ["Info@firma.de", "info@firma.de", "noreply@firma.de", "max@other.com", "logo@2x.png"]), (2, "nobody.de", ["info@firma.de", "max@gmail.com", "x@y.de"]), (3, None, ["info@firma.de", "a@b.de"]),
        (4, "firma.de", []), (5, "shop.firma.de", ["sales@firma.de", "hello@shop.firma.de", "partners@other.com"]), (6, "www.firma.de", ["hello@gmail.com", "bd@firma.de", "legal@firma.de", "m.m@firma.de"]), (7, "firma.de", None),
    ),
)
_SPOT = "instr(n, m)"


@case(f"""SELECT doc_id, lower(m) AS email, trim(substr(n, greatest(1, {_SPOT} - 50), {_SPOT} + length(m) + 50 - greatest(1, {_SPOT} - 50))) AS context,
regexp_matches(lower(substr(n, greatest(1, {_SPOT} - 107), {_SPOT} - greatest(1, {_SPOT} - 107))), '(?s)(support|contact).{{0,100}}$') OR regexp_matches(lower(substr(n, {_SPOT} + length(m), 107)), '(?s)^.{{0,100}}(support|contact)') OR regexp_matches(lower(m), 'support|contact') AS near
FROM (SELECT doc_id, n, unnest(list_distinct(regexp_extract_all(n, {ADDRESS_SQL}))) AS m FROM (SELECT doc_id, {undisguised_sql(unescaped_sql('text'))} AS n FROM {TEXTS.sql})) WHERE ({reason_sql('lower(m)')}) IS NULL""")
def email_context(spark, sf_dir):
    """Addresses with 50 characters around them, and whether support or contact is said within 100."""
    d = TEXTS.df(spark).select("doc_id", X.unescaped(F.col("text")).alias("t")).select("doc_id", X.undisguised(F.col("t")).alias("n"))
    d = d.select("doc_id", F.explode(X.in_context(F.col("n"))).alias("s"), X.near_words(F.col("n"), ["support", "contact"]).alias("near"))
    return d.select("doc_id", "s.email", "s.context", F.array_contains("near", F.col("s.email")).alias("near")).distinct()

_EACH = f"(SELECT id, company, generate_subscripts(emails, 1) AS i, unnest(emails) AS e FROM {LISTS.sql})"
_FIRST = f"(SELECT * FROM {_EACH} QUALIFY row_number() OVER (PARTITION BY id, lower(trim(e)) ORDER BY i) = 1)"
_GOOD = f"(SELECT *, {match_sql('split_part(e, ' + chr(39) + '@' + chr(39) + ', 2)', 'company')} AS own FROM (SELECT *, {reason_sql('lower(trim(e))')} AS reason FROM {_FIRST} WHERE NOT ({system_sql('e')}) AND NOT {asset_sql('e')}) WHERE {quality_sql('e')} >= 50)"


@case(f"""SELECT id, coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM {_GOOD} g WHERE g.id = l.id AND (own OR company IS NULL OR NOT (SELECT max(own) FROM {_GOOD} h WHERE h.id = l.id))), '') AS kept,
coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM {_EACH} g WHERE g.id = l.id AND split_part(e, '@', 2) NOT IN ('other.com', 'gmail.com')), '') AS unblocked, coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM {_EACH} g WHERE g.id = l.id AND split_part(e, '@', 2) = 'firma.de'), '') AS allowed,
coalesce((SELECT string_agg(e, ' ' ORDER BY i) FROM {_EACH} g WHERE g.id = l.id AND NOT ({system_sql('e')}) AND NOT {asset_sql('e')} AND split_part(e, '@', 2) NOT IN {_LIST(E.FREE_MAIL)}), '') AS business FROM {LISTS.sql} l""")
def email_filter_chain(spark, sf_dir):
    """The standard chain over lists, and domain lists and the free-mail filter beside it."""
    e = F.coalesce("emails", F.array().cast("array<string>"))
    words = lambda *w: F.array(*map(F.lit, w))
    shown = lambda c: F.array_join(c, " ")
    best = F.when(F.col("company").isNull(), X.standard_filters(e)).otherwise(X.standard_filters(e, F.col("company")))
    return LISTS.df(spark).select("id", shown(best).alias("kept"), shown(X.in_domains(e, blocked=words("other.com", "gmail.com"))).alias("unblocked"), shown(X.in_domains(e, allowed=words("firma.de"))).alias("allowed"), shown(X.kept(e, generic=True)).alias("business"))

_PREFER = "regexp_replace(lower(trim(company)), '^www\\.', '')"
_DOM = "regexp_replace(e, '^[^@]*@', '')"
_OUTREACH = rf"""CASE WHEN coalesce({_PREFER}, '') = '' THEN 0 WHEN {_DOM} = {_PREFER} OR ends_with({_DOM}, '.' || {_PREFER}) THEN 80 ELSE -40 END
+ CASE WHEN split_part(e, '@', 1) IN ('partners', 'partnerships') THEN 25 WHEN split_part(e, '@', 1) IN ('sales', 'bizdev', 'business', 'bd') THEN 20 WHEN split_part(e, '@', 1) IN ('hello', 'hi') THEN 15 WHEN split_part(e, '@', 1) IN ('info', 'contact', 'support') THEN 10 ELSE 0 END
- CASE WHEN split_part(e, '@', 1) IN ('abuse', 'webmaster', 'postmaster', 'noreply', 'no-reply', 'donotreply', 'do-not-reply', 'privacy', 'legal', 'security') THEN 50 ELSE 0 END
- CASE WHEN {_DOM} IN ('gmail.com', 'yahoo.com', 'outlook.com', 'hotmail.com', 'icloud.com') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(split_part(e, '@', 1), '\d|\.') THEN 2 ELSE 0 END"""


@case(f"SELECT id, (SELECT e FROM (SELECT id, i, company, lower(trim(e)) AS e FROM {_EACH}) g WHERE g.id = l.id AND contains(e, '@') ORDER BY {_OUTREACH} DESC, i LIMIT 1) AS best FROM {LISTS.sql} l")
def outreach_pick(spark, sf_dir):
    return LISTS.df(spark).select("id", X.best_outreach(F.coalesce("emails", F.array().cast("array<string>")), F.col("company")).alias("best"))

OLD = Sample(
    "id long, text string, want string",
    (
        (1, "Mail max@firma.de or sales (at) firma (dot) com", "max@firma.de sales@firma.com"), (2, '<a href="mailto:Info%40firma.de?subject=x">', "info@firma.de"), (3, "max @spamverhindern.de @ firma.de", "max@firma.de"),
        (4, "vasb@svezn.pbz and image_1@2x.6d763021.png", "info@firma.com"), (5, "office at firma.de", "office@firma.de"), (6, None, ""), (7, "a&#64;b.de twice a@b.de", "a@b.de"), (8, "x@y@z.de", ""),
    ),
)


@case(f"SELECT id, want AS emails FROM {OLD.sql}")
def email_old_rules(spark, sf_dir):
    """The older extractor; what it must find is stated beside each text."""
    d = OLD.df(spark).select("id", X.unescaped(F.col("text")).alias("t"))
    return d.select("id", F.array_join(X.old_addresses(F.col("t")), " ").alias("emails"))

VOTES = Sample(
    "item long, model string, people string",
    (
        (1, "a", '[{"name": "Ann", "role": "CEO"}, {"name": "Bo"}]'), (1, "b", '[{"name": "ann ", "role": "Chef"}, {"name": "Bob", "role": "x"}, {"name": "C"}]'), (1, "c", '[{"name": "Anna", "role": "chef"}]'),
        (2, "b", '[{"name": "A"}]'), (2, "c", '[{"name": "a"}]'), (3, "a", "[]"), (3, "b", '[{"name": "Z"}]'), (4, "a", '[{"name": "Weiß"}]'), (4, "b", '[{"name": "WEISS"}]'),
    ),
)
VOTED = Sample("item long, position int, name string, value string", ((1, 0, "name", "Ann"), (1, 0, "role", "Chef"), (1, 1, "name", "Bo"), (1, 1, "role", None), (4, 0, "name", "Weiß")))


@case(f"SELECT * FROM {VOTED.sql}")
def vote_struct_lists(spark, sf_dir):
    """Lists of objects that models answered, voted on field by field; the winners are stated beside."""
    v = VOTES.df(spark).withColumn("people", F.from_json("people", "array<map<string,string>>"))
    return evidence.vote_structs(v, ["item"], "model", "people", "a").select("item", "position", "name", "value")

PIECES = Sample(
    "id long, text string",
    (
        (1, "  Weiß &  Co  "), (2, None), (3, "**bold** and __strong__ and *soft* and _thin_ snake_case_x  two\n\n\n\nlines"), (4, "Home\n## Impressum\nFirma GmbH\nTel 1"), (5, "no Impressum heading here"),
        (6, "net::ERR_CONNECTION_TIMED_OUT at https://x"), (7, "Error: x\nCall log:\n  - a\nSomething broke " + "y" * 90), (8, "HTTP 404"), (9, "<p>Vis­ible <b>text</b></p>\n<i>x</i>"), (10, "t" * 95), (11, "(a)(b) (c"), (12, "Empty content"), (13, "imprint"),
    ),
)
PIECES_READ = Sample(
    "id long, canonical string, plain string, tail string, error string, visible string, title string, inside string",
    (
        (1, "weiss & co", "Weiß & Co", "", "Weiß &  Co", "Weiß & Co", "  Weiß &  Co  ", ""), (2, "", "", "", "", "", None, ""),
        (3, "**bold** and __strong__ and *soft* and _thin_ snake_case_x two lines", "bold and strong and soft and thin snake_case_x two\n\nlines", "", "**bold** and __strong__ and *soft* and _thin_ snake_case_x  two", "**bold** and __strong__ and *soft* and _thin_ snake_case_x two lines", "**bold** and __strong__ and *soft* and _thin_ snake_case_x  two\n\n\n\nlines", ""),
        (4, "home ## impressum firma gmbh tel 1", "Home\n## Impressum\nFirma GmbH\nTel 1", "## Impressum\nFirma GmbH\nTel 1", "Home", "Home ## Impressum Firma GmbH Tel 1", "Home\n## Impressum\nFirma GmbH\nTel 1", ""),
        (5, "no impressum heading here", "no Impressum heading here", "", "no Impressum heading here", "no Impressum heading here", "no Impressum heading here", ""),
        (6, "net::err_connection_timed_out at https://x", "net::ERR_CONNECTION_TIMED_OUT at https://x", "", "Connection timeout", "net::ERR_CONNECTION_TIMED_OUT at https://x", "net::ERR_CONNECTION_TIMED_OUT at https://x", ""),
        (7, "error: x call log: - a something broke " + "y" * 90, "Error: x\nCall log:\n - a\nSomething broke " + "y" * 90, "", "Something broke " + "y" * 64 + "...", "Error: x Call log: - a Something broke " + "y" * 90, ("Error: x\nCall log:\n  - a\nSomething broke " + "y" * 90)[:90] + "…", ""),
        (8, "http 404", "HTTP 404", "", "Page not found (404)", "HTTP 404", "HTTP 404", ""), (9, "<p>vis­ible <b>text</b></p> <i>x</i>", "<p>Vis­ible <b>text</b></p>\n<i>x</i>", "", "<p>Vis­ible <b>text</b></p>", "Visible text x", "<p>Vis­ible <b>text</b></p>\n<i>x</i>", ""),
        (10, "t" * 95, "t" * 95, "", "t" * 80 + "...", "t" * 95, "t" * 90 + "…", ""), (11, "(a)(b) (c", "(a)(b) (c", "", "(a)(b) (c", "(a)(b) (c", "(a)(b) (c", "a|b"), (12, "empty content", "Empty content", "", "Empty content", "Empty content", "Empty content", ""), (13, "imprint", "imprint", "imprint", "imprint", "imprint", "imprint", ""),
    ),
)


@case(f"SELECT * FROM {PIECES_READ.sql}")
def text_tools(spark, sf_dir):
    """Text functions on one row per case; what they must give is stated beside."""
    t = F.col("text")
    return PIECES.df(spark).select("id", T.canonical(t).alias("canonical"), T.without_emphasis(t).alias("plain"), T.impressum_tail(t).alias("tail"), T.crawl_error(t).alias("error"), T.visible_text(t).alias("visible"), T.truncated(t, 90).alias("title"), F.array_join(X.between(t, "(", ")"), "|").alias("inside"))

URLS = Sample("id long, url string", ((1, "https://www.Firma.de:8080/a/b?x=1#y"), (2, "http://shop.firma.co.uk/"), (3, "firma.de"), (4, "HTTPS://x.y/"), (5, None), (6, "https://bücher.de/x"), (7, "ftp://a.b/c/")))
URLS_READ = Sample(
    "id long, host string, api_domain string, domain string, home string, same boolean",
    (
        (1, "www.firma.de", "firma.de", "firma.de", "https://www.Firma.de:8080/a/b?x=1#y", True), (2, "shop.firma.co.uk", "shop.firma.co.uk", "shop.firma.co.uk", "https://shop.firma.co.uk", False), (3, "", "", "firma.de", "https://firma.de", False),
        (4, "x.y", "x.y", "x.y", "https://HTTPS://x.y", False), (5, "", "", None, "https://", False), (6, "bücher.de", "bücher.de", None, "https://bücher.de/x", False), (7, "a.b", "a.b", "a.b", "https://ftp://a.b/c", False),
    ),
)


@case(f"SELECT * FROM {URLS_READ.sql}")
def url_parts(spark, sf_dir):
    """Hosts, home pages and same-site checks on one row per case."""
    u = F.col("url")
    return URLS.df(spark).select("id", D.host(u).alias("host"), D.bare_host(u).alias("api_domain"), D.normalize_domain(u).alias("domain"), D.home_url(u).alias("home"), D.same_site(u, F.lit("www.firma.de")).alias("same"))

SECTIONS = Sample(
    "id long, section string",
    (
        (1, '{"source_url": "https://a.de", "extracted": {"emails": [{"email": " x@a.de ", "evidence": {"quote": "mail x"}}, {"email": "bad", "evidence": {"quote": "q"}}, {"email": "y@a.de"}], "contacts": [{"name": " Ann ", "role": "CEO", "evidence": {"quote": "' + "q" * 320 + '"}}, {"name": "", "evidence": {"quote": "n"}}, {"name": "Bo", "evidence": {"quote": "bo"}}]}}'),
        (2, '{"source_url": "", "extracted": {"emails": [{"email": "z@a.de", "evidence": {"quote": "mail"}}]}}'), (3, "oops"), (4, None), (5, '{"source_url": "https://b.de", "extracted": {"contacts": [{"name": "' + "n" * 161 + '", "role": null, "evidence": {"quote": "long name"}}]}}'),
    ),
)
SECTIONS_READ = Sample(
    "id long, kind string, value string, role string, url string, quote_length int, problems string",
    ((1, "email", "x@a.de", None, "https://a.de", 6, ""), (1, "contact", "Ann", "CEO", "https://a.de", 300, ""), (1, "contact", "Bo", None, "https://a.de", 2, "quote short"), (5, "contact", "n" * 161, None, "https://b.de", 9, "name long")),
)


@case(f"SELECT * FROM {SECTIONS_READ.sql}")
def model_records(spark, sf_dir):
    """Sections of a model's answer flattened, quotes cut, lengths checked; stated beside."""
    s = SECTIONS.df(spark)
    quote = records.short_quote(F.col("quote"))
    mails = records.section_emails(s, ["id"]).withColumn("quote", quote)
    people = records.section_contacts(s, ["id"]).withColumn("quote", quote)
    mails = records.checked(mails, {"quote": "quote"}).select("id", F.lit("email").alias("kind"), F.col("email").alias("value"), F.lit(None).cast("string").alias("role"), "url", "quote", "problems")
    people = records.checked(people, {"name": "name", "role": "role", "quote": "quote"}, optional=["role"]).select("id", F.lit("contact").alias("kind"), F.col("name").alias("value"), "role", "url", "quote", "problems")
    return mails.unionByName(people).select("id", "kind", "value", "role", "url", F.length("quote").alias("quote_length"), F.array_join("problems", "; ").alias("problems"))
