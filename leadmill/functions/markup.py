"""HTML in one pass, as a table function: anchors, buttons, scripts and the visible text of a page.

A tokenizer reads a page once from left to right: text, comments, declarations, end tags and start tags with their attributes in any order and
quoting, and the bodies of scripts and styles as they stand.  What is between an anchor's or a button's tags is its text; an anchor
that another one begins in is closed by it, and what is open at the end is closed there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "kind string, pos int, href string, onclick string, body string, calls string, called string"
RAW = ("script", "style")
_TAG = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_BLANKS = re.compile(r"\s+")
_CALL = re.compile(r"\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\(")


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(what, text or tag, attributes): "text", "raw", "open" and "close", in order; comments and declarations are left out.

    A tag or comment without an end reaches to the end of the page and is none.
    """
    at, size = 0, len(page)
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield "text", page[at:end], {}
            at = end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
        elif (name := _TAG.match(page, at + 2)) and page.startswith("</", at):
            end = page.find(">", name.end())
            yield "close", name[0].lower(), {}
            at = size if end < 0 else end + 1
        elif name := _TAG.match(page, at + 1):
            tag, attributes, at = name[0].lower(), {}, name.end()
            while at < size and page[at] != ">":
                found = _ATTRIBUTE.match(page, at)
                if not found:  # blanks and slashes before the end
                    at += 1
                    continue
                value = next((v for v in found.groups()[1:] if v is not None), "")
                attributes.setdefault(found[1].lower(), html.unescape(value))
                at = found.end()
            if at >= size:
                return
            at += 1
            yield "open", tag, attributes
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = size if end is None else end.start()
                yield "raw", page[at:stop], {}
                at = stop
        else:
            yield "text", "<", {}
            at += 1


def squeezed(pieces: list[str]) -> str:
    return _BLANKS.sub(" ", "".join(pieces)).strip(" ")


def function_body(scripts: str, name: str) -> str:
    """What stands in the braces of a function of that name, up to the first that closes; empty without one."""
    n = re.escape(name)
    found = re.search(rf"(?:function\s+{n}\s*\([^)]*\)|{n}\s*=\s*(?:function\s*\([^)]*\)|\([^)]*\)\s*=>))\s*\{{(.*?)\}}", scripts, re.I | re.S)
    return found[1] if found else ""


def parts_of(page: str | None) -> list[tuple]:
    """(kind, pos, href, onclick, body, calls, called): "anchor" and "button" with their texts, "script" with its body, and one "text", all that is visible.

    A tag stands for a blank in the visible text, and for nothing in a link's.  Entities are undone but in scripts.  ``calls`` is the function
    that a click calls, ``called`` its body in the page's scripts.
    """
    out: list[tuple] = []
    seen: list[str] = []
    open_links: dict[str, tuple] = {}
    count = {"a": 0, "button": 0, "script": 0}
    kinds = {"a": "anchor", "button": "button"}

    def close(tag: str) -> None:
        if tag in open_links:
            pos, attributes, pieces = open_links.pop(tag)
            out.append((kinds[tag], pos, attributes.get("href"), attributes.get("onclick"), squeezed(pieces)))

    raw = ""
    for what, text, attributes in tokens(page or ""):
        if what == "text":
            text = html.unescape(text)
            seen.append(text)
            for _, _, pieces in open_links.values():
                pieces.append(text)
        elif what == "raw":
            if raw == "script":
                out.append(("script", count["script"], None, None, text))
                count["script"] += 1
        else:
            seen.append(" ")
            raw = text
            if text in kinds:
                close(text)
                if what == "open":
                    open_links[text] = (count[text], attributes, [])
                    count[text] += 1
    for tag in list(open_links):
        close(tag)
    scripts = "\n".join(r[4] for r in out if r[0] == "script")
    calls = [_CALL.match(r[3] or "") for r in out]
    named = [(*r, c and c[1], c and function_body(scripts, c[1])) for r, c in zip(out, calls, strict=True)]
    return sorted([*named, ("text", 0, None, None, squeezed(seen), None, None)], key=lambda r: (r[0], r[1]))


@F.udtf(returnType=PARTS, useArrow=True)
class PageParts:
    """The table function of ``parts_of``."""

    def eval(self, page: str):
        yield from parts_of(page)


def page_parts(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column``, a row per part; a NULL or empty page has an empty text alone."""
    return pages.lateralJoin(PageParts(F.col(column).outer())).drop(column)
