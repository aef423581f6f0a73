"""Plain versions of the operators, a document or a pair at a time."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int = 5) -> set[tuple]:
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(n: int, links: list[tuple[int, int]]) -> list[int]:
    top = list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_duplicates(rows: list[tuple[int | None, str | None]], num: int = 75, den: int = 100) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    top = groups(len(rows), links)
    low: dict[int, int | None] = {}
    for (doc, _), g in zip(rows, top, strict=True):
        low[g] = min((x for x in (low.get(g), doc) if x is not None), default=None)
    return [(doc, len(s), low[g]) for (doc, _), s, g in zip(rows, sets, top, strict=True)]


def repeats_removed(rows: list[tuple[int | None, str | None]], k: int = 20) -> list[tuple]:
    """Rows of one doc_id must have equal texts."""
    first: dict[tuple, tuple] = {}
    words = [WORD.findall(t or "") for _, t in rows]
    name = [(-1 if d is None else d) for d, _ in rows]
    for d, w in zip(name, words, strict=True):
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for (doc, _), d, w in zip(rows, name, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (d, i):
                gone |= set(range(i, i + k))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out
