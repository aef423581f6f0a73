"""Pages and JSON of any shape taken apart, each query with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.functions import markup
from leadmill.operators import links, variants
from leadmill.plans.projected import RAW, SITES, Projection
from leadmill.plans.registry import ORACLES, query, table

# Entities as they stand on the pages; the semicolon may be missing where a page is cut off.
_ENTITIES = (("&copy;?", "©"), ("&middot;?", "·"), ("&#64;", "@"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&amp;?", "&"))


def _plain_sql(x: str) -> str:
    for entity, char in _ENTITIES:
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_GIVEN = "(SELECT page_id::BIGINT AS page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?(-->|$)', ' ', 'g'), '<[a-zA-Z/][^>]*$', '') AS h FROM pages)"
_ANCHORS = r"""'(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)(?:</a>|$)'"""
_VISIBLE = _plain_sql(r"regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?(</script>|$)|<style\b.*?(</style>|$)', ' ', 'g'), '(?s)<![^>]*>', ' ', 'g'), '(?s)</?[a-zA-Z][^>]*>', ' ', 'g')")


@query(rf"""SELECT page_id, 'anchor' AS kind, (generate_subscripts(f, 1) - 1)::INTEGER AS pos, unnest(f) AS href, {_plain_sql("regexp_replace(unnest(g), '<[^>]*>', '', 'g')")} AS body FROM (SELECT page_id, regexp_extract_all(h, {_ANCHORS}, 1) AS f, regexp_extract_all(h, {_ANCHORS}, 2) AS g FROM {_GIVEN})
UNION ALL SELECT page_id, 'script', (generate_subscripts(f, 1) - 1)::INTEGER, NULL, unnest(f) FROM (SELECT page_id, regexp_extract_all(h, '(?is)<script\b[^>]*>(.*?)(?:</script>|$)', 1) AS f FROM {_GIVEN})
UNION ALL SELECT page_id, 'text', 0, NULL, {_VISIBLE} FROM {_GIVEN}""")
def html_parts(spark, sf_dir):
    """Anchors, scripts and visible text of all pages, by one pass over each."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html")
    return markup.page_parts(p).select("page_id", "kind", "pos", "href", "body")


@query("""SELECT CAST(page_id AS BIGINT) AS page_id, kind, pos, href, onclick, body FROM pages JOIN (VALUES (0, 'anchor', 0, '/impressum', NULL, 'Impressum'), (0, 'anchor', 1, '/about-us', NULL, 'About us'), (1, 'button', 0, NULL, 'location.href=''/i.php''', 'Impressum'), (2, 'anchor', 0, '#', 'openImpressum()', 'Impressum'),
(2, 'script', 0, NULL, NULL, 'function openImpressum() { window.open(''/legal/impressum.html''); }'), (3, 'anchor', 0, '/contact', NULL, 'Kontakt'), (4, 'anchor', 0, '/imprint', NULL, 'x'), (4, 'anchor', 1, '/ueber-uns', NULL, 'Wer'), (5, 'anchor', 0, '/datenschutz', NULL, 'y')) v(m, kind, pos, href, onclick, body) ON page_id % 8 = m""")
def site_parts(spark, sf_dir):
    """Anchors, buttons and scripts of every page's site, with what a click does."""
    s = SITES.df(spark, sf_dir).select("page_id", F.split_part("html", F.lit("<p>"), F.lit(1)).alias("html"))
    return markup.page_parts(s).where("kind <> 'text'").select("page_id", "kind", "pos", "href", "onclick", "body")


@query(ORACLES["tier_sites"])
def tier_sites_at_once(spark, sf_dir):
    """The links of ``tier_sites`` from one pass over each page."""
    return links.discovered_at_once(SITES.df(spark, sf_dir)).select("page_id", "kind", "tier", "url")


PROPS = Projection(
    "events", event_id="CAST(event_id AS BIGINT)",
    props="""CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('{"tags": ["a", ', event_id, ', null, true, []], "o": {"x": 1.5, "e": {}}}') WHEN 2 THEN 'oops' WHEN 3 THEN NULL WHEN 4 THEN concat('[{"id": ', event_id, ', "name": "n', event_id % 3, '"}, "', event_type, '"]') ELSE concat('"', event_type, '"') END""",
)


@query(f"""WITH p AS (SELECT event_id, props AS j FROM {PROPS.sql} WHERE json_valid(props)),
t AS (SELECT event_id, t.fullkey AS path, t.type AS type, t.atom AS atom FROM p, json_tree(p.j) t)
SELECT event_id, regexp_replace(path, '"', '', 'g') AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, CASE WHEN type <> 'NULL' THEN atom->>'$' END AS text FROM t WHERE type NOT IN ('OBJECT', 'ARRAY')""")
def event_props(spark, sf_dir):
    """Every value in the events' properties, whatever their shape, with its path and type."""
    return variants.leaves(PROPS.df(spark, sf_dir), "props")


@query("""SELECT CAST(page_id AS BIGINT) AS id, list, pos, CASE url WHEN 'U' THEN pages.url WHEN 'D' THEN concat('https://d', page_id, '.de') ELSE v.url END AS url FROM pages
JOIN (VALUES (0, '', 0, 'U'), (0, '', 1, 'http://b.de'), (1, 'internal', 0, 'U'), (1, 'internal', 1, 'https://b.de'), (1, 'internal', 2, 'HTTP://c.de'), (1, 'external', 0, 'D')) v(m, list, pos, url) ON page_id % 5 = m""".replace("CASE url WHEN", "CASE v.url WHEN"))
def variant_links(spark, sf_dir):
    """The polymorphic link lists of all pages as rows, in their lists' order."""
    return variants.links(RAW.df(spark, sf_dir), "raw").select("id", "place.list", "place.pos", "url")
