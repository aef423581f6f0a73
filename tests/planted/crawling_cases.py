"""Planted rows for operators of ``plans.crawling``, with the rows they must give."""

from __future__ import annotations
from pyspark.sql import functions as F
from leadmill.functions import text as T
from leadmill.operators import links
from leadmill.plans.registry import Sample

from planted import case
from leadmill.plans.crawling import PAGES

CASES = Sample(
    "page_id long, contact_case string, imprint_url string, about_url string, about_case string",
    (
        (-1, "1", "https://www.tea.de/impressum", "https://www.tea.de/about-us", "about_anchor"), (-2, "2", "https://cup.de/i.php", None, "about_not_found"), (-3, "2", "https://js.de/legal/impressum.html", None, "about_not_found"), (-4, "2", "https://guess.de/impressum", None, "about_not_found"),
        (-5, "5.1", "https://urls.de/imprint", "https://urls.de/ueber-uns", "about_link"), (-6, "4", None, None, None), (-7, "4", None, None, None), (-8, "3", None, None, "about_not_found"), (-9, "5.3", None, None, "about_not_found"),
    ),
)
NOTICES = Sample("url string, markdown string", (("https://www.tea.de/impressum", "# Impressum\nTea"), ("https://urls.de/imprint", "x\nImprint\ny"), ("https://cup.de/i.php", "no heading: Impressum")))


@case(f"SELECT * FROM {CASES.sql}")
def contact_cases(spark, sf_dir):
    """How planted sites name themselves, their notice and their about page; stated beside."""
    tails = NOTICES.df(spark).select("url", T.impressum_tail(F.col("markdown")).alias("tail"))
    return links.site_links(PAGES.df(spark), tails)

RAW = Sample("id long, raw string", ((1, '["https://a.de", " http://b.de ", "c", ""]'), (2, '{"internal": [{"href": "https://a.de"}, {"url": "https://b.de"}, {"link": "HTTP://c.de"}, {"x": 1}], "external": ["https://d.de"], "n": []}'), (3, None), (4, "oops"), (5, "{}")))


@case("SELECT * FROM (VALUES (1::BIGINT, 'https://a.de http://b.de'), (2, 'https://a.de https://b.de HTTP://c.de https://d.de'), (3, ''), (4, ''), (5, '')) t(id, urls)")
def flat_links(spark, sf_dir):
    """Polymorphic link lists made flat; stated beside."""
    return RAW.df(spark).select("id", F.array_join(F.coalesce(links.flat_links(F.col("raw")), F.array().cast("array<string>")), " ").alias("urls"))
