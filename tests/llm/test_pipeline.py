"""The pipeline's stages, one after the other, each against a plain version of what it must do to its own input."""

from __future__ import annotations

import corpus_pipeline
from brute import near_duplicates, repeats_removed
from test_documents import check_packing

from leadmill.llm import quality
from leadmill.llm.common import crc_held_out, materialize

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: df.select("doc_id", "text").collect()

    kept = materialize(stages["quality"](spark, docs, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~crc_held_out("doc_id", 5, 0))
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where("score >= 0.3").collect()}
    assert sorted(r.doc_id for r in rows(kept)) == sorted(r.doc_id for r in rows(docs) if r.doc_id in good)

    one = materialize(stages["near_copies"](spark, kept, SF))
    first = {d for d, _, c in near_duplicates([(r.doc_id, r.text) for r in rows(kept)]) if d == c}
    assert sorted(r.doc_id for r in rows(one)) == sorted(first)

    cut = materialize(stages["repeated_passages"](spark, one, SF))
    want = {d: (n, k) for d, n, k, _ in repeats_removed([(r.doc_id, r.text) for r in rows(one)])}
    before = {r.doc_id: r.text for r in rows(one)}
    for r in cut.collect():
        n, removed = want[r.doc_id]
        assert len((r.text or "").encode().split()) == n - removed
        assert r.text == before[r.doc_id] if not removed else r.n_chars == len(r.text)

    mixed = materialize(stages["mixing"](spark, cut, SF))
    ids = {r.doc_id for r in rows(mixed)}
    assert ids < {r.doc_id for r in rows(cut)} and sorted(map(tuple, rows(mixed)), key=str) == sorted((tuple(r) for r in rows(cut) if r.doc_id in ids), key=str)

    check_packing([(r.doc_id, r.text) for r in rows(mixed)], stages["packing"](spark, mixed, SF).collect(), least=0.9)


def test_stages_on_awkward_rows(spark, documents):
    """Nulls, ties, repeated rows and clashing columns go through all stages, and so does an empty table."""
    for docs in (documents, documents.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF))
            assert docs.columns == corpus_pipeline.COLUMNS, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert (pieces.count() > 0) == (docs.count() > 0)


def test_near_copies_judges_texts_not_ids(spark):
    """Under one doc_id a copy of an earlier document goes and another text stays."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base + " tail"), (5, " ".join(f"x{i}" for i in range(60))), (6, None), (6, ""), (1, base)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, (r.text or "")[:2]) for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect())
    assert got == [(1, "w0"), (5, "x0"), (6, "")]
