"""Functions and link operators on literal rows that the tables do not have."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leadmill.functions import domain as D
from leadmill.functions import extraction as X
from leadmill.functions import text as T
from leadmill.operators import links, merge


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www.Example.com:8080/a?b#c", "example.com"), ("//host.de/x", "host.de"), ("localhost", None), ("exa mple.com", None), (None, None), ("http://a.b./", "a.b"), ("-a.de", None)],
)
def test_normalize_domain(spark, url, want):
    assert one(spark, url, D.normalize_domain) == want


def test_domain_outside_ascii(spark):
    df = spark.createDataFrame([("http://www.bücher.de/x",), (None,), ("b.de",)], "url string")
    assert [r.domain for r in D.with_ascii_domain(df, "url").collect()] == ["xn--bcher-kva.de", None, "b.de"]


@pytest.mark.parametrize(("domain", "want"), [("a.b.co.uk", "b.co.uk"), ("x.y.de", "y.de"), ("y.de", "y.de")])
def test_registrable(spark, domain, want):
    assert one(spark, domain, D.registrable_domain) == want


def test_anchors_win_over_buttons_per_kind(spark):
    html = """<a href="/impressum">Impressum</a><button onclick="location.href='/kontakt'">Kontakt</button><button onclick="location='/i2'">Impressum</button>"""
    pages = spark.createDataFrame([(1, "https://a.de", html, None), (2, "https://b.de", None, None)], "page_id long, url string, html string, links_json string")
    got = sorted((r.kind, r.tier, r.url) for r in links.discovered(pages).collect())
    assert got == [("contact", 3, "https://a.de/kontakt"), ("impressum", 2, "https://a.de/impressum")]


def test_merge_keeps_the_first_source(spark):
    schema = "request_id string, domain string, organization string, source string, job_id string"
    old = spark.createDataFrame([("r", "a", "Old", "hunter", "1"), ("r", "b", None, "google_maps", "1"), ("r", "z", "Z", "hunter", "1")], schema)
    new = spark.createDataFrame([("r", "a", "New", "2"), ("r", "b", "New", "2"), ("r", "c", "New", "2")], "request_id string, domain string, organization string, job_id string")
    got = {r.domain: (r.organization, r.source, r.job_id) for r in merge.merge_candidates(old, new, "google_maps").collect()}
    assert got == {"a": ("Old", "hunter, google_maps", "1"), "b": ("New", "google_maps", "2"), "c": ("New", "google_maps", "2"), "z": ("Z", "hunter", "1")}


def test_error_parts_are_looked_up_without_patterns(spark):
    """Each part is found beside the others in its order, and a text is not read by a pattern for each part."""
    assert all(any(sign in p for sign in T._SIGNS) for part, _ in T.CRAWL_ERRORS for p in part.split("|"))
    texts = [(f"x {p} {later}",) for i, (part, _) in enumerate(T.CRAWL_ERRORS) for p in part.split("|") for later in ("", T.CRAWL_ERRORS[-1][0], *(q.split("|")[0] for q, _ in T.CRAWL_ERRORS[i:]))]
    df = spark.createDataFrame(texts, "x string").select("x", T.crawl_error(F.col("x")).alias("e"))
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString().upper()
    assert [r.e for r in df.collect()] == [next(name for part, name in T.CRAWL_ERRORS if re.search(part, x)) for x, in texts]


def test_text_functions_against_plain_ones(spark):
    """Texts put together at random from what the functions look for."""
    r, space = random.Random(4), " \t\n\x0b\f"
    pieces = ["\n", "\n", " ", "\t", "\x0b", "Error:", "-", "→", "Call log:", "imprint", "Impressum", "#", "##", "<", ">", "(", ")", "\u00ad", "\u200d", "\u00a0", "a", "bc", "404", "ERR_", "ERR_SSL", "Empty content", "😀", "ü", "y" * 45, "$1", "\\"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(20_000)]

    def tail(t):
        m = re.search(rf"(?ims)^[{space}]*(#{{1,6}}[{space}]*)?(impressum|imprint)[ \t]*$.*", t, re.ASCII)
        return m[0].strip(space) if m else ""

    def error(t):
        short = lambda x: x[:80] + "..." if len(x) > 80 else x
        lines = [x for x in (y.strip(space) for y in t.split("\n")) if x and not re.match("Error:|Call log:|Code context:|-|→", x)]
        return next((name for part, name in T.CRAWL_ERRORS if re.search(part, t)), t if "Empty content" in t else short(lines[0] if lines else t))

    def visible(t):
        return re.sub(rf"[{space}]+", " ", re.sub("[\u00ad\u200b-\u200d\u2060]", "", re.sub("<[^>]+>", "", t)).replace("\u00a0", " ")).strip(" ")

    x = F.col("x")
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.impressum_tail(x).alias("a"), T.crawl_error(x).alias("b"), T.visible_text(x).alias("c"), X.between(x, "(", ")").alias("d")).collect()
    for g in got:
        assert (g.a, g.b, g.c, g.d) == (tail(g.x), error(g.x), visible(g.x), re.findall(r"(?s)\((.*?)\)", g.x)), g.x


@pytest.mark.parametrize("text", ["(" * 300_000, "<" * 300_000, "\n" * 300_000, "- a\n" * 100_000, "imprint\n" + " " * 300_000 + "x"], ids=["open", "tag", "blank", "untelling", "spaces"])
def test_long_texts_of_one_sign_are_read_once(spark, text):
    """What begins and does not end is not looked for from each beginning."""
    x = F.col("x")
    df = spark.createDataFrame([(text,)], "x string").select(T.impressum_tail(x), T.crawl_error(x), T.visible_text(x), F.size(X.between(x, "(", ")")))
    start = time.time()
    tail, error, visible, inside = df.first()
    assert time.time() - start < 15
    assert (tail, inside) == (text if text.startswith("imprint") else "", 0)
    assert error == ("imprint" if text.startswith("imprint") else text[:80] + "...")
    assert visible == re.sub("[ \n]+", " ", text).strip(" ")
