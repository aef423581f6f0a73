"""Near copies, repeated passages and packing against plain versions, on awkward rows and on the small tables."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import near_duplicates as plain_near
from brute import repeats_removed as plain_repeats

from leadmill.llm import ngram_join, packing, queries, substring


def key(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=key)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_near_copies_awkward(documents):
    got = rows_of(ngram_join.near_duplicates(documents), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near(texts_of(documents)), key=key)


def test_near_copies_table(spark, smoke_dir):
    docs = queries.table(spark, smoke_dir, "documents")
    got = rows_of(queries.op7_ngram_jaccard_join(spark, smoke_dir), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near(texts_of(docs)), key=key)


@pytest.mark.parametrize("size", [3, 7, 12, 40, 90, 260, 900, 4000])
def test_pairs_at_the_threshold_are_found(spark, size):
    """Pairs whose similarity is just at 75 of 100 or just under it, at several set sizes."""
    rows, n = [], 0
    for trial in range(12):
        shared = 3 * size // 4 + (trial % 3 - 1)
        stem = [f"t{size}x{trial}w{i}" for i in range(shared + 4)]
        own = [f"t{size}x{trial}o{i}" for i in range(size - shared)]
        rows += [(n, " ".join(stem)), (n + 1, " ".join(stem + own))]
        n += 2
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near(rows))


def test_copies_do_not_enter_cells(spark, monkeypatch):
    """With a membership table that names all rows, a cell still has one set per class."""
    r = np.random.default_rng(7)
    base = [f"w{i}" for i in r.integers(0, 500, 80)]
    rows = [(n, " ".join(base)) for n in range(30)] + [(3, " ".join(base)), (None, " ".join(base)), (40, " ".join([*base, "tail"])), (None, " ".join([*base, "other", "end"]))]
    compare = ngram_join.compare_cell

    def strict(num, den):
        run = compare(num, den)

        def checked(table):
            assert len(set(table.column("h1").to_pylist())) == table.num_rows
            return run(table)

        return checked

    monkeypatch.setattr(ngram_join, "compare_cell", strict)
    monkeypatch.setattr(ngram_join, "membership", lambda keys, *columns: keys.sparkSession.sparkContext.broadcast(np.full(1 << 23, 255, np.uint8)))
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near(rows), key=key)


def test_texts_with_common_lines_in_common_do_not_meet(spark, monkeypatch):
    """Only near copies come to be compared by their sets, however many texts share lines or single rare passages."""
    r = np.random.default_rng(11)
    lines = [" ".join(f"line{k}w{i}" for i in range(12)) for k in range(5)]
    passages = [" ".join(f"rare{k}w{i}" for i in range(6)) for k in range(150)]
    rows = []
    for n in range(600):
        own = " ".join(f"o{n}w{i}" for i in range(int(r.integers(18, 40))))
        rows.append((n, "\n".join([lines[n % 5], passages[n % 150], own, passages[int(r.integers(150))], lines[int(r.integers(5))]])))
    rows.append((1000, rows[17][1] + " tail"))
    compare = ngram_join.compare_cell

    def strict(num, den):
        run = compare(num, den)

        def checked(table):
            assert table.num_rows == 2
            return run(table)

        return checked

    monkeypatch.setattr(ngram_join, "compare_cell", strict)
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near(rows))


def test_common_keys_in_slices_lose_no_link(spark, documents, monkeypatch):
    """Every key's rows go to cells, and a cell has rows of two small slices."""
    monkeypatch.setattr(ngram_join, "FEW", 1)
    monkeypatch.setattr(ngram_join, "CELL_MEMBERS", 2)
    words = [f"c{i}" for i in range(60)]
    chain = [(1000 + k, " ".join([*words[3 * k :], *(f"x{k}y{i}" for i in range(3 * k))])) for k in range(9)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    got = rows_of(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near(texts_of(docs)), key=key)


def test_every_band_is_exact_or_has_all_its_loose_blocks():
    for _, limit in ngram_join.bands(75, 100):
        assert limit < ngram_join.EXACT or int(limit / ngram_join.SPARE) + 1 >= ngram_join.BLOCKS, limit


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert ngram_join.near_duplicates(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


def distinct_ids(rows):
    """Rows of one id keep only equal texts, as order between the others is by hash."""
    seen = {}
    return [r for r in rows if seen.setdefault(r[0], r[1]) == r[1]]


def test_repeats_awkward(spark, documents):
    rows = distinct_ids(texts_of(documents))
    got = rows_of(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(plain_repeats(rows), key=key)


def test_repeats_table(spark, smoke_dir):
    docs = queries.table(spark, smoke_dir, "documents")
    got = rows_of(queries.op5_substring_dedup(spark, smoke_dir), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(plain_repeats(texts_of(docs)), key=key)


@pytest.mark.parametrize("times", [1, 40])
def test_repeated_rows_count_once_before_they_are_compacted(spark, monkeypatch, times):
    """However often a row repeats, its repeated passages are as many spans, and each row loses the same words."""
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in r.integers(0, 900, 400)]
    base, mixed = " ".join(words), " ".join([*words[:150], "new", *words[100:260], *words[40:90]])
    rows = [(5, base)] * times + [(7, mixed)] * times + [(1, " ".join(words[60:90])), (9, base)]
    seen = []
    compact = substring.compact
    monkeypatch.setattr(substring, "compact", lambda records: (lambda pairs: (seen.append(sum(len(x.at) for x in pairs.collect())), pairs)[1])(compact(records)))
    got = rows_of(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(plain_repeats(rows), key=key)
    assert 0 < seen[0] < 30


def test_words_that_repeat_in_a_cycle_are_one_record_per_source(spark):
    """A text of two alternating words starts all its windows at two places; the spans with one source row are verified together."""
    cycle = " ".join(["a", "b"] * 400)
    rows = [(1, "x y " + cycle), (2, cycle + " z"), (3, " ".join(["a", "b", "c"] * 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(substring.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(plain_repeats(rows), key=key)


def test_paths_of_one_content_are_one_record_of_a_text():
    """A cycle of words in a text makes a few records to join, however long it is, and no position is lost."""
    import pyarrow as pa

    for n in (400, 4000):
        texts = [" ".join(["a", "b"] * n), None, " ".join(["x", "y", "z", *(["a", "b"] * n)])]
        batch = pa.RecordBatch.from_arrays([pa.array([3, 4, 5]), pa.array([30, 40, 50]), pa.array(texts)], ["doc", "mark", "text"])
        (out,) = substring.emit_paths(20, substring.SEED_WORDS)(iter([batch]))
        got = [(r["doc"], r["seed"], r["content"], p) for r in out.to_pylist() for p in [r["pos"], *(r["more"] or [])]]
        doc, start, length, seed, content = substring.paths_of(*substring._words(batch), 20, substring.SEED_WORDS)
        want = zip((3 + doc).tolist(), seed.view(np.int64).tolist(), content.view(np.int64).tolist(), ((start << 6) | length).tolist(), strict=True)
        assert sorted(got) == sorted(want) and len(got) > n and out.num_rows < 20
        assert all(r["more"] is None or [r["pos"], *r["more"]] == sorted({r["pos"], *r["more"]}) for r in out.to_pylist())


def test_kept_text_is_the_digest(documents):
    import hashlib

    out = substring.remove_repeats(documents, carry=["lang"]).collect()
    for r in out:
        words = (r.kept_text or "").encode().split()
        assert hashlib.sha256(b" ".join(words)).hexdigest() == r.kept_sha256 and len(words) == r.n_words - r.n_removed
    same = substring.with_repeats_removed(documents)
    assert same.columns == documents.columns and same.count() == documents.count()


def check_packing(rows, pieces, capacity=2048, least=0.99):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = defaultdict(list)
    for doc, text in rows:
        want[doc].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], np.uint32))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, texts in want.items():
        mine = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[doc])
        assert sum(p[1] for p in mine) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length, crc, total in mine:
                assert start == at and total == len(texts[0]) and zlib.crc32(texts[0][start : start + length].tobytes()) == crc
                at += length
    padded = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padded += at if at & (at - 1) == 0 else capacity
    total = sum(p.length for p in pieces)
    assert total >= least * padded


def test_packing_awkward(documents):
    check_packing(texts_of(documents), packing.pack_documents(documents, queries.tokenizer_path()).collect())


def test_packing_table(spark, smoke_dir):
    check_packing(texts_of(queries.table(spark, smoke_dir, "documents")), queries.op4_harmonic_packing(spark, smoke_dir).collect())


def test_packing_folds_no_control_token_and_no_composed_letter(spark):
    texts = ["<|ENDOFTEXT|>", "a<|EndOfText|>B", "<|endoftext|>", "<|StartOfText|> X", "H\u0331", "T\u0308", "xT\u0308y, H\u0331.", "É ÀB, ABC! <|", "E\u0301A"]
    rows = list(enumerate(texts))
    check_packing(rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()).collect(), least=0)


def test_the_encoder_is_the_tokenizer():
    """Random texts of letters, marks, digits, signs and control strings, with a cache so small that it is cleared."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, encode, r = Tokenizer.from_file(path), packing.WordEncoder(path, cache_words=300), random.Random(1)
    letters = [*"abcXYZ äöüßÉİıǅ'’s.,!-<|>0123456789\n\t日本🙂ΣςŉĲ", "\u0331", "\u0308", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", " the", "  "]
    for _ in range(40):
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(80)] + [None, ""]
        ids, bounds = encode(pa.array(texts, pa.string()))
        for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_rows_of_one_id_and_of_none_keep_a_passage_once(spark):
    """Different texts under one doc_id, and under none, are rows of their own: of a passage they share one copy stays."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(7, passage + " a"), (7, "b " + passage), (None, passage + " c"), (None, "d " + passage), (None, "e " + passage + " f")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r.n_words - r.n_removed for r in got) == 40 + 6
    assert sorted(r.n_removed for r in got) == [0, 40, 40, 40, 40]
    assert [r.doc_id for r in got if not r.n_removed] == [None]
