"""Queries over captured pages and their links, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.functions.domain import host
from leadmill.functions.extraction import unescaped
from leadmill.operators import links
from leadmill.plans.registry import Sample, query, table

PAGES = Sample(
    "page_id long, url string, html string, links_json string",
    (
        (-1, "https://www.tea.de/", '<a href="/impressum">Impressum</a> <a href="http://other.de/kontakt">Kontakt</a> <a href="kontakt.html#x">Kontakt</a> <a href="/about-us">About us</a> <a href="/logo.png">Impressum</a>', None),
        (-2, "https://cup.de", """<button onclick="location.href='/i.php'">Impressum</button><button class='b' onclick='window.location="/k"'>Contact us</button><a href="#x">Kontakt</a>""", '{"internal": [{"href": "/notice", "text": "Legal notice"}, {"href": "", "text": "Imprint"}], "external": [{"href": "https://x.de/privacy", "text": "Privacy policy"}]}'),
        (-3, "https://js.de/a/", """<script>function openImpressum() { window.open('/legal/impressum.html'); } var go = function(x) { show("img.png"); load("/seite/datenschutz"); }; const far = (a) => { fetch("https://js.de/kontakt") }</script><a href="#" onclick="openImpressum()">Impressum</a><a onclick="go(1)" href="#">Datenschutz</a><a onclick='far()'>Kontakt</a>""", None),
        (-4, "https://guess.de", '<a onclick="showImpressum()">Impressum</a><a onclick="openPrivacy()">Privacy</a><a onclick="nothing()">Contact</a>', "{}"), (-5, "https://urls.de", '<a href="/ueber-uns/team">Wir</a><a href="/ueber-uns">Wer</a><a href="/imprint">x</a><a href="/datenschutz">y</a><a href="mailto:a@b.de">Kontakt</a>', "oops"),
        (-6, "https://bare.de", "<p>nothing</p>", None), (-7, "https://null.de", None, None), (-8, "https://only.de/", '<a href="/contact">Kontakt &amp; mehr</a>', None), (-9, "https://five.de", '<a href="https://five.de/contact/form">f</a>', None),
    ),
)
FOUND = Sample(
    "page_id long, kind string, tier int, url string",
    (
        (-1, "impressum", 2, "https://www.tea.de/impressum"), (-1, "impressum", 2, "https://www.tea.de/logo.png"), (-1, "contact", 2, "http://other.de/kontakt"), (-1, "contact", 2, "https://www.tea.de/kontakt.html#x"), (-1, "about", 2, "https://www.tea.de/about-us"),
        (-2, "privacy", 1, "https://cup.de/notice"), (-2, "privacy", 1, "https://x.de/privacy"), (-2, "impressum", 3, "https://cup.de/i.php"), (-2, "contact", 3, "https://cup.de/k"),
        (-3, "impressum", 4, "https://js.de/legal/impressum.html"), (-3, "privacy", 4, "https://js.de/seite/datenschutz"), (-3, "contact", 4, "https://js.de/kontakt"),
        (-4, "impressum", 4, "https://guess.de/impressum"), (-4, "impressum", 4, "https://guess.de/impressum.php"), (-4, "privacy", 4, "https://guess.de/datenschutz"), (-4, "privacy", 4, "https://guess.de/datenschutz.php"), (-4, "privacy", 4, "https://guess.de/privacy"), (-4, "privacy", 4, "https://guess.de/privacy-policy"),
        (-8, "contact", 2, "https://only.de/contact"),
    ),
)
_HREF, _TEXT = links.ANCHOR.replace("'", "''"), "trim(regexp_replace(regexp_replace({}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
_OWN = f"(SELECT page_id::BIGINT AS page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href, unnest(regexp_extract_all(html, '{_HREF}', 2)) AS text, generate_subscripts(regexp_extract_all(html, '{_HREF}', 1), 1)::INTEGER - 1 AS pos FROM pages)"
_ABS = "CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || href END"
_SITE = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')"


def _pages(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.lit(None).cast("string").alias("links_json"))
    return PAGES.df(spark).unionByName(own)


@query(f"""SELECT * FROM {FOUND.sql} UNION ALL SELECT DISTINCT page_id, kind, 2 AS tier, {_ABS} AS url FROM {_OWN}, (VALUES ('impressum', '\\b(impressum|imprint)\\b'), ('contact', '\\b(kontakt|contact(\\s*us)?|contact-us)\\b'),
('privacy', '\\b(legal(\\s*notice)?|datenschutz|datenschutzerkl[aä]rung|privacy(\\s*policy)?)\\b'), ('about', '\\b(ueber\\s*uns|über\\s*uns|ueber|about(\\s*us)?)\\b')) k(kind, words) WHERE regexp_matches(lower({_TEXT.format('text')}), words)""")
def tier_cascade(spark, sf_dir):
    """Links of every page by their texts, from the first tier that has a kind; what planted pages must give is stated beside."""
    return links.discovered(_pages(spark, sf_dir)).select("page_id", "kind", "tier", "url")


URLS = Sample(
    "page_id long, base string, pos int, url string",
    (
        (-1, "tea.de", 0, "https://tea.de/a/b/contact"), (-1, "tea.de", 1, "https://tea.de/impressum"), (-1, "tea.de", 2, "https://tea.de/impressum"), (-1, "tea.de", 3, "https://shop.tea.de/datenschutz/x/y"), (-1, "tea.de", 4, "https://else.de/impressum"), (-1, "tea.de", 5, "https://tea.de/impressum.pdf"),
        (-1, "tea.de", 6, "https://tea.de/kontakt?x=1"), (-1, "tea.de", 7, "https://tea.de/xcontactx"), (-1, "tea.de", 8, "https://www.tea.de/privacy-policy"), (-1, "tea.de", 9, "https://tea.de/contact-us"), (-1, "tea.de", 10, "https://tea.de/c/contact"), (-1, "tea.de", 11, "https://tea.de/contact"),
    ),
)
_POINTS = " + ".join(f"CASE WHEN contains(lower(url), '{w}') THEN {v} ELSE 0 END" for w, v in links.WORDS.items())
_PATH = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_STRONG = " OR ".join(f"contains(lower(url), '{w}')" for w, v in links.WORDS.items() if v >= 80)
_LINKS = f"(SELECT * FROM {URLS.sql} UNION ALL SELECT page_id, {_SITE} AS base, pos, {_ABS} AS url FROM {_OWN})"
_HOSTED = f"({_SITE} = base OR ends_with({_SITE}, '.' || base))"
_ALTS = "|".join(links.WORDS)


@query(f"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos, url))::INTEGER AS rank, url, CASE WHEN regexp_matches(lower(url), 'impressum|imprint') THEN 'impressum' WHEN regexp_matches(lower(url), 'kontakt|contact') THEN 'contact' WHEN regexp_matches(lower(url), 'datenschutz|privacy') THEN 'privacy' ELSE 'other' END AS page_type, score
FROM (SELECT page_id, url, pos, ({_POINTS} + greatest(0, 20 - length({_PATH})) - CASE WHEN {_STRONG} THEN 0 ELSE 5 * (length({_PATH}) - length(replace({_PATH}, '/', ''))) END)::INTEGER AS score FROM (SELECT page_id, url, min(pos) AS pos FROM {_LINKS}
WHERE NOT regexp_matches(lower(url), '\\.({'|'.join(e[1:] for e in links.DENIED)})$') AND {_HOSTED} AND regexp_matches(lower(url), '[/_.\\-]({_ALTS})|({_ALTS})[/_.\\-]') GROUP BY 1, 2)) QUALIFY rank <= 6""")
def link_topk(spark, sf_dir):
    """Six best links of a site by their URLs."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    own = links.tagged_links(p).where(links.fetchable(F.col("href"))).join(p.select("page_id", "url"), "page_id")
    own = own.select("page_id", host(F.col("url")).alias("base"), "pos", links.joined(F.col("url"), F.col("href")).alias("url"))
    return links.top_links(URLS.df(spark).unionByName(own), F.col("base")).withColumn("score", F.col("score").cast("int"))


_PREFERRED = f"CASE WHEN {_HOSTED} THEN 100 ELSE 0 END - CASE WHEN regexp_matches(url, '#.') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*(/[^?#]|[^?#]*\\?[^#])') THEN 10 ELSE 0 END + CASE WHEN lower(url) LIKE 'https://%' THEN 1 ELSE 0 END"


@query(f"""SELECT page_id, url FROM {_LINKS} WHERE regexp_matches(lower(url), '^https?://') AND NOT regexp_matches(lower(url), '\\.({'|'.join(e[1:] for e in links.DENIED)})$') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {_HOSTED} DESC, {_PREFERRED} DESC, pos, url) = 1""")
def best_url(spark, sf_dir):
    """The preferred link of every page, of its own site where there is one."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    own = links.tagged_links(p).join(p.select("page_id", "url"), "page_id").select("page_id", host(F.col("url")).alias("base"), "pos", links.joined(F.col("url"), F.col("href")).alias("url"))
    return links.best_urls(URLS.df(spark).unionByName(own), ["page_id"], F.col("base")).select("page_id", "url")


ENTITIES = Sample("page_id long, html string", ((-1, "<p>Fish &amp; chips &lt;3 &quot;x&quot;</p>"), (-2, "<script>a&amp;b</script>plain"), (-3, None), (-4, "&copy; 2020 &middot; x&#64;y")))
_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_PLAIN = _STRIPPED
# The semicolon may be missing, as where a page is cut off.
for _e, _c in (("&copy;?", "©"), ("&middot;?", "·"), ("&#64;", "@"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&amp;?", "&")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_e}', '{_c}', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS text FROM (SELECT * FROM {ENTITIES.sql} UNION ALL SELECT page_id::BIGINT, html FROM pages)")
def html_unescape_text(spark, sf_dir):
    """Plain texts of all pages, entities undone."""
    p = ENTITIES.df(spark).unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html"))
    d = p.select("page_id", T.strip_html(F.coalesce("html", F.lit(""))).alias("t"))
    return d.select("page_id", T.squeeze(unescaped(F.col("t"))).alias("text"))
