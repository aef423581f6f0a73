"""The page tokenizer against the standard library's parser and on cases stated here; JSON of any shape."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest

from leadmill.functions import markup
from leadmill.operators import links, variants
from leadmill.plans import crawling


class Plain(HTMLParser):
    """Anchors, buttons, scripts and text as the standard library's events have them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.seen, self.open, self.count, self.raw, self.script = [], [], {}, {"a": 0, "button": 0, "script": 0}, None, []

    def end(self, tag):
        if tag in self.open:
            pos, attrs, pieces = self.open.pop(tag)
            self.out.append(({"a": "anchor", "button": "button"}[tag], pos, attrs.get("href"), attrs.get("onclick"), markup.squeezed(pieces)))

    def handle_starttag(self, tag, attrs):
        self.seen.append(" ")
        if tag in markup.RAW:
            self.raw, self.script = tag, []
        elif tag in ("a", "button"):
            self.end(tag)
            first = {}
            for k, v in attrs:
                first.setdefault(k, v or "")
            self.open[tag] = (self.count[tag], first, [])
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.seen.append(" ")
        if tag == self.raw:
            if tag == "script" and self.script:
                self.out.append(("script", self.count["script"], None, None, "".join(self.script)))
                self.count["script"] += 1
            self.raw = None
        else:
            self.end(tag)

    def handle_data(self, data):
        if self.raw:
            self.script.append(data)
        else:
            self.seen.append(data)
            for _, _, pieces in self.open.values():
                pieces.append(data)

    def parts(self, page):
        self.feed(page)
        self.close()
        for tag in list(self.open):
            self.end(tag)
        return sorted([*self.out, ("text", 0, None, None, markup.squeezed(self.seen))], key=lambda r: (r[0], r[1]))


AWKWARD = [
    "", "plain", "a < b and c > d", "<p>one<p>two", '<a href="/x">one<b>two</b></a>', "<A HREF='/y' onclick=\"go('>')\">t</A>", "<a title='>' href=/bare>t</a>", '<a href="a"><a href="b">inner</a></a>', '<a href="/open">to the end',
    "<button disabled onclick='x()'>B</button>", "<!-- <a href='/no'>no</a> -->yes", "<script>var a = '<a href=\"/no\">';</script><a href='/yes'>y</a>", "<style>p > a { }</style>z", "x &amp; y &lt;b&gt; &copy; &#64;", '<a href="?a=1&amp;b=2">q</a>',
    "<a\nhref = '/nl'\n>n</a>", "<a href=''>e</a><a>none</a>", "<!DOCTYPE html><html><body>t</body></html>", "<a href='1' href='2'>twice</a>", "<div><a href='/d'><span>s</span> <i>i</i></a></div>", "<br/><a href='/s'/>x", "</a></p>stray", "<SCRIPT>if (a < b) {}</SCRIPT>after",
]


@pytest.mark.parametrize("page", AWKWARD)
def test_awkward_markup(page):
    assert [r[:5] for r in markup.parts_of(page)] == Plain().parts(page)


def test_all_pages(spark, smoke_dir):
    for r in spark.read.parquet(f"{smoke_dir}/pages.parquet").collect():
        whole = r.html[: r.html.rfind(">") + 1]  # a page that ends within a tag has no standard reading
        assert [x[:5] for x in markup.parts_of(whole)] == Plain().parts(whole)


def test_what_is_open_at_the_end():
    assert markup.parts_of("a<!-- open") == [("text", 0, None, None, "a", None, None)]
    assert markup.parts_of("a<b title='x") == [("text", 0, None, None, "a", None, None)]
    assert [r[:5] for r in markup.parts_of("a<script>x = '</p>'")] == [("script", 0, None, None, "x = '</p>'"), ("text", 0, None, None, "a")]
    assert markup.parts_of(None) == [("text", 0, None, None, "", None, None)]


def test_what_a_click_calls():
    page = """<script>function go(a) { open("/a"); }</script><script>var run = (x) => { fetch('/b') }</script><a onclick="go(1)">g</a><a onclick=" run ()">r</a><a onclick="none()">n</a><a onclick="location='/x'">l</a>"""
    assert [(r[4], r[5], r[6]) for r in markup.parts_of(page) if r[0] == "anchor"] == [("g", "go", ' open("/a"); '), ("r", "run", " fetch('/b') "), ("n", "none", ""), ("l", None, None)]


def test_one_pass_finds_the_links_of_four(spark, smoke_dir):
    pages = crawling._pages(spark, smoke_dir)
    rows = lambda d: sorted(tuple(r) for r in d.select("page_id", "kind", "tier", "url").collect())
    assert rows(links.discovered_at_once(pages)) == rows(links.discovered(pages))


def test_json_of_any_shape(spark):
    rows = [(1, '{"a": {"b": [1, "x", {"c": [true]}]}, "e": {}, "n": null}'), (2, "no"), (3, None), (4, '"s"'), (5, "[]"), (6, "-1.50")]
    out = variants.leaves(spark.createDataFrame(rows, "id long, j string"), "j")
    assert sorted((r.id, r.path, r.kind, r.text) for r in out.collect()) == [
        (1, "$.a.b[0]", "number", "1"), (1, "$.a.b[1]", "string", "x"), (1, "$.a.b[2]", "object", '{"c":[true]}'), (1, "$.n", "null", None), (4, "$", "string", "s"), (6, "$", "number", "-1.5"),
    ]
    raw = [(1, '["https://a.de", " http://b.de ", 7, null, {"url": "https://u.de"}]'), (2, '{"x": [{"href": "", "link": "https://l.de"}], "y": "https://no.de", "z": [["https://deep.de"]]}'), (3, "{}"), (4, None), (5, "[")]
    got = variants.links(spark.createDataFrame(raw, "id long, j string"), "j")
    assert sorted((r.id, r.place.list, r.place.pos, r.url) for r in got.collect()) == [(1, "", 0, "https://a.de"), (1, "", 1, "http://b.de"), (1, "", 4, "https://u.de"), (2, "x", 0, "https://l.de")]
