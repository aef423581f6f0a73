"""Held-out accuracy of the two learned operators, and mixing against its targets."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from leadmill.llm import langid, mixing, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    rows = queries.op1_quality_classifier(spark, SF).collect()
    assert len(rows) == queries.table(spark, SF, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9, auc


def test_quality_awkward(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.classify(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert all(abs(r.score - 0.5) < 0.1 for r in quality.classify(documents, none).collect())
    assert quality.classify(documents.where("false"), labels).count() == 0


def test_margin_is_the_pairwise_sum():
    """The sum-of-squares identity against the sum over all pairs."""
    import numpy as np

    r = np.random.default_rng(1)
    m = quality.Machine(0.3, r.normal(size=quality.DIMENSION), r.normal(size=(quality.DIMENSION, quality.FACTORS)))
    ids, x = np.array([3, 900, 17, 33000]), np.array([0.5, 0.25, 1.0, 0.5])
    pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.margin(np.zeros(4, int), ids, x, 1)[0], 0.3 + m.w[ids] @ x + pairs)


def plain_features(text, n_chars):
    """{feature: value} of one text, word by word and character by character."""
    import re

    import numpy as np
    import xxhash

    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    bucket = [xxhash.xxh3_64_intdigest(w, 0) % quality.WORD_BUCKETS for w in words]
    kinds = {b: bucket.count(b) for b in set(bucket)}
    n, size, lines = max(len(words), 1), max(len(raw), 1), (text or "").split("\n")
    of = lambda c: sum(quality._CLASS[b] == c for b in raw) / size
    stats = [
        *(of(c) for c in range(6)), of(6) * 4, len(kinds) / n, max(kinds.values(), default=0) / n,
        sum(quality._CLASS[w[-1]] in (4, 6) or w[-2:] == b"!!" for w in words) / n, 1 - len(set(lines)) / len(lines), sum(a == b for a, b in zip(words, words[1:])) / n,
        len(words), len(lines), sum(map(len, words)) / n, n / len(lines), -1 if n_chars is None else n_chars,
    ]
    out = {b: 1 / np.sqrt(len(kinds)) for b in kinds}
    for i, ((_, edges), x) in enumerate(zip(quality.STRUCTURE, stats, strict=True)):
        out[quality.WORD_BUCKETS + i * quality._WIDTH + int(np.searchsorted(edges, x, "right"))] = 0.5
    return out


def test_quality_plain_version(spark, documents):
    """Scores of awkward rows and of a table against features and pairs computed one by one."""
    import numpy as np

    r = np.random.default_rng(2)
    m = quality.Machine(0.1, r.normal(scale=0.3, size=quality.DIMENSION), r.normal(scale=0.1, size=(quality.DIMENSION, 3)), 1.3, -0.2)
    for docs in (documents, queries.table(spark, "/root/testdata/sf0.001", "documents")):
        for row in quality.score(docs.select("doc_id", "text", "n_chars"), m).collect():
            f = plain_features(row.text, row.n_chars)
            ids = sorted(f)
            x = np.array([f[i] for i in ids])
            g = (m.v[ids] @ m.v[ids].T) * np.outer(x, x)
            margin = m.w0 + m.w[ids] @ x + (g.sum() - np.trace(g)) / 2
            assert abs(row.score - 1 / (1 + np.exp(-(1.3 * margin - 0.2)))) < 1e-4


def test_calibration_gives_shares_back():
    import numpy as np

    r = np.random.default_rng(3)
    margin = r.normal(size=20_000) * 2
    y = (r.random(20_000) < 1 / (1 + np.exp(-(0.5 * margin - 1)))).astype(float)
    slope, shift = quality.calibrate(margin, y)
    assert abs(slope - 0.5) < 0.05 and abs(shift + 1) < 0.1


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op9_language_id(spark, SF).collect()
    assert len(rows) == queries.table(spark, SF, "documents").count()
    held = [r for r in rows if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.9


def test_language_awkward(documents):
    rows = langid.identify(documents).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.doc_id for r in documents.collect() if not any(c.isalpha() for c in r.text or "")}
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in blank and r.doc_id not in (None,))
    assert langid.identify(documents.where("false")).count() == 0


def test_more_languages_than_a_mask_word_has_bits(spark):
    import random

    r = random.Random(6)
    rows = []
    for l in range(70):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(100 * l + i, " ".join(r.choice(words) for _ in range(40)), f"l{l:02}") for i in range(9 - l // 20)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out} == set(want.values())
    assert sum(r.lang_pred == want[r.doc_id] for r in out) / len(out) > 0.98


def test_mixing_meets_its_targets(spark):
    docs = queries.table(spark, SF, "documents")
    cells = mixing.materialize(mixing.token_cells(mixing.describe(docs)))
    targets = mixing.default_targets(cells)
    raked = mixing.rake(cells, targets)
    marginals = mixing.reached(raked, targets).collect()
    assert len({r.dimension for r in marginals}) == 3
    for d in mixing.DIMENSIONS:
        assert abs(sum(r.target for r in marginals if r.dimension == d) - 1) < 1e-9
    assert max(abs(r.target - r.share) for r in marginals) < 0.003
    have, want = cells.agg({"tokens": "sum"}).first()[0], raked.agg({"weight": "sum"}).first()[0]
    assert abs(want / have - mixing.KEEP) < 0.003
    out = mixing.mix(docs)
    kept = {r[0]: r[1] for r in out.where("_mix_kept").groupBy("_mix_source").sum("_mix_tokens").collect()}
    total = sum(kept.values())
    for r in marginals:
        if r.dimension == "source":
            assert abs(kept.get(r.value, 0) / total - r.target) < 0.03


def test_mixing_to_given_targets(spark):
    """Targets of the caller over cells that can meet them, and a topic column of the caller's."""
    rows = [(i, "w " * 10, f"s{i % 2}", f"l{i % 3}", "odd" if i % 5 == 0 else "even") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    share = lambda **x: spark.createDataFrame(list(x.items()), "value string, target double")
    targets = {"source": share(s0=0.7, s1=0.3), "lang": share(l0=0.5, l1=0.25, l2=0.25), "topic": share(odd=0.3, even=0.7)}
    cells = mixing.materialize(mixing.token_cells(mixing.describe(docs, F.col("kind"))))
    got = mixing.reached(mixing.rake(cells, targets, keep=0.3), targets).collect()
    assert max(abs(r.target - r.share) for r in got) < 1e-6
    out = mixing.mix(docs, targets, keep=0.3, topic=F.col("kind")).where("_mix_kept")
    assert abs(out.count() / 3000 - 0.3) < 0.05 and abs(out.where("source = 's0'").count() / out.count() - 0.7) < 0.05
    lost = mixing.mix(docs, {**targets, "lang": share(l0=1.0)}, keep=0.1, topic=F.col("kind"))
    assert lost.where("_mix_kept and lang <> 'l0'").count() == 0


def test_mixing_awkward(documents):
    out = mixing.mix(documents, rounds=1)
    assert out.count() == documents.count() and set(documents.columns) < set(out.columns)
    assert all(r._mix_kept for r in out.where("_mix_tokens = 0").collect())
    assert mixing.mix(documents.where("false"), rounds=1).count() == 0


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op3_source_mixing", "op6_chat_prefix_tree", "op8_embedding_near_dedup"])
def test_sql_twin(spark, smoke_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{smoke_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, smoke_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_language_plain_version(spark):
    """Predictions against n-gram sets without a filter: counts per language are exact there."""
    import re
    import zlib
    from collections import Counter

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = docs.select("doc_id", "text", "lang").collect()
    split = lambda t: [w for w in re.split(r"(?:[^\w]|[\d_])+", (t or "").lower()) if any(c.isalpha() for c in w)]
    counts = {}
    for r in rows:
        if r.lang and r.text is not None and not held(r.doc_id):
            c = counts.setdefault(r.lang, Counter())
            for w, n in Counter(split(r.text)).items():
                for g in langid.grams_of(w):
                    c[g] += n
    sets = {lang: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.SAMPLE_GRAMS]} for lang, c in counts.items()}
    got = {r.doc_id: r for r in queries.op9_language_id(spark, "/root/testdata/sf0.001").collect()}
    alike = total = 0
    for r in rows:
        grams = [g for w in split(r.text) for g in langid.grams_of(w)]
        if grams:
            share = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sets.items()}
            best = max(share.values())
            total += 1
            alike += share[got[r.doc_id].lang_pred] == best and abs(got[r.doc_id].score - best) < 0.05
        else:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
    assert alike >= 0.98 * total


def test_marks_alone_are_no_language(spark):
    rows = [(i, f"das ist ein text {i}", "de") for i in range(30)] + [(40, "\u0301\u0308 \u0331", "de"), (41, "123 !?", "de"), (42, None, "de"), (43, "", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == ("und", 0.0) for i in (40, 41, 42, 43)) and got[3][0] == "de"


def test_more_languages_than_a_mask_word_has_bits(spark):
    rows = [(i, f"wort{chr(97 + l % 26)}{chr(97 + l // 26)} xx{chr(97 + l // 26)}{chr(97 + l % 26)}yy " * 3, f"l{l:02d}") for l in range(70) for i in range(l * 10, l * 10 + 10)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert len({r.lang_pred for r in got}) == 70 and sum(r.lang_pred == want[r.doc_id] for r in got) > 0.9 * len(got)
