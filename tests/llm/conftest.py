from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, copies, near copies, shared passages."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "Straße", "naïve", "日本語", "a b", "x y"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(60)
    long = prose(30_000)
    base = prose(300).split(" ")
    near = [list(base) for _ in range(4)]
    for i, w in enumerate(near):
        for j in range(i * 3):
            w[30 * j + i] = f"new{i}{j}"
    texts = [
        None, "", "   \t\n ", "one", "one two three", "one two three", "ONE two THREE", prose(5), prose(19), prose(20),
        long, long, long + " tail", passage + " " + prose(30), prose(40) + "\n" + passage, passage, passage + " " + passage,
        " ".join(["same"] * 500), " ".join(["same"] * 90), *(" ".join(w) for w in near), prose(200), prose(200).upper(), "<|endoftext|> a|b #@! " * 9,
    ]
    rows = [(i * 7 % 101, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, passage + " of nobody", "de", "s1", 3))
    rows.append(rows[14])
    rows.append((rows[7][0], prose(50), None, None, None))
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    """``awkward_documents`` with columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    clash = ["score", "mark", "h1", "keys", "component_id", "held_out", "sequence_id", "tokens", "topic", "label", "at"]
    return spark.createDataFrame(awkward_documents(), DOCS).withColumns({c: F.lit("x") for c in clash}).repartition(3)
