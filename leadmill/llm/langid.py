"""Language identification by n-gram filters that answer with a language bitmask.

The filter is a table of bitmasks, as many words of 64 bits wide as the languages need: bit l of the slots an
n-gram hashes to is set if language l has the n-gram.  That is a bit-sliced Bloom filter, one slice per language,
and the AND of an n-gram's slots gives all languages at once.  A text's n-grams are
counted per language; a language with a fill of f lets a foreign n-gram through with
probability f**HASHES, so the count is corrected to (hits - n*p) / (1 - p).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import bound_batches, crc_held_out, mix, pair_hash, slices, tidy

SIZES = (1, 2, 3, 4)
HASHES = 3
SLOT_BITS = 18
WORD = 64
#: Most documents learned from per language, and most n-grams kept of each.
SAMPLE_DOCS = 1500
SAMPLE_GRAMS = 20_000


def grams_of(word: str) -> list[str]:
    """Character n-grams of one folded word, its ends marked by blanks."""
    w = f" {word} "
    return [w[i : i + n] for n in SIZES for i in range(len(w) - n + 1)]


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text index, word code, count) of the folded letter runs of each text, and the distinct words."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "").take(pa.array(range(len(texts)), pa.int64())))
    lists = pc.split_pattern_regex(texts, r"[^\pL\pM]+")
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
    coded = flat.dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    words = coded.dictionary.to_pylist()
    key, count = np.unique(doc * max(1, len(words)) + np.asarray(coded.indices, np.int64), return_counts=True)
    doc, code = key // max(1, len(words)), key % max(1, len(words))
    # Marks alone are no word: a text without a letter has none.
    full = np.asarray(pc.match_substring_regex(coded.dictionary, r"\pL"))[code] if words else np.zeros(0, bool)
    return doc[full], code[full], count[full], words


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count) of the labelled texts, summed per batch."""
    for whole in batches:
        for batch in slices(whole, "text"):
            doc, code, count, words = word_counts(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            total: dict[tuple[str, str], int] = {}
            for d, c, n in zip(doc.tolist(), code.tolist(), count.tolist(), strict=True):
                key = (langs[d], words[c])
                total[key] = total.get(key, 0) + n
            grams: dict[tuple[str, str], int] = {}
            for (lang, word), n in total.items():
                for g in grams_of(word):
                    grams[lang, g] = grams.get((lang, g), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.string()), pa.array([k[1] for k in grams], pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


def letters(text: str) -> np.ndarray:
    """A hash per code point."""
    return mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))


def gram_hashes(grams: list[str]) -> np.ndarray:
    """Hashes of n-grams, each folded from its code points' from the left."""
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    h, first = letters("".join(grams)), np.cumsum(size) - size
    out = h[first]
    for n in range(1, int(size.max(initial=0))):
        longer = size > n
        out[longer] = pair_hash(out[longer], h[first[longer] + n])
    return out


class BitmaskFilter:
    def __init__(self, langs: list[str], rows: list[tuple[str, str]]):
        self.langs = langs
        self.table = np.zeros((max(1, -(-len(langs) // WORD)), 1 << SLOT_BITS), np.uint64)
        at = {lang: l for l, lang in enumerate(langs)}
        l = np.array([at[lang] for lang, _ in rows], np.int64)
        bit = np.uint64(1) << (l % WORD).astype(np.uint64)
        for slots in self.slots(gram_hashes([gram for _, gram in rows])):
            np.bitwise_or.at(self.table, (l // WORD, slots), bit)
        fill = [((self.table[l // WORD] >> np.uint64(l % WORD)) & np.uint64(1)).mean() for l in range(len(langs))]
        self.false_rate = np.array(fill) ** HASHES

    @staticmethod
    def slots(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(HASHES)]

    def hits(self, words: list[str], at: int = 0) -> np.ndarray:
        """n-grams of each word and, per language of mask word ``at``, those its slice of the filter holds; all words at once."""
        table, langs = self.table[at], self.langs[at * WORD : (at + 1) * WORD]
        out = np.zeros((len(words), len(langs) + 1), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        end = np.cumsum(size)
        rest = np.repeat(end, size) - np.arange(int(end[-1]) if len(end) else 0)
        one = letters("".join(f" {w} " for w in words))
        h = one
        per_word = lambda x: np.diff(np.cumsum(x)[end - 1], prepend=0)
        for n in range(1, max(SIZES) + 1):
            if n > 1:
                h = pair_hash(h[:-1], one[n - 1 :])
            if n in SIZES and len(h):
                inside = np.zeros(len(one), bool)
                inside[: len(h)] = rest[: len(h)] >= n
                mask = np.zeros(len(one), np.uint64)
                mask[: len(h)] = ~np.uint64(0)
                for slots in self.slots(h):
                    mask[: len(h)] &= table[slots]
                mask[~inside] = 0
                out[:, 0] += per_word(inside)
                for l in range(len(langs)):
                    out[:, l + 1] += per_word((mask >> np.uint64(l)) & np.uint64(1)).astype(np.int64)
        return out


def predict(filter_of):
    """Predictions with the broadcast filter; each distinct word of a few texts is looked up once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: BitmaskFilter = filter_of.value
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, code, count, words = word_counts(batch.column("text"))
                total = np.zeros((batch.num_rows, len(f.langs) + 1))
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, int)
                for at in range(len(f.table) if len(doc) else 0):
                    sums = np.add.reduceat(f.hits(words, at)[code] * count[:, None], first, axis=0)
                    total[doc[first], 0] = sums[:, 0]
                    total[doc[first], 1 + at * WORD : at * WORD + sums.shape[1]] = sums[:, 1:]
                n = total[:, 0]
                if f.langs:
                    true = np.maximum((total[:, 1:] - n[:, None] * f.false_rate) / np.maximum(1 - f.false_rate, 1e-9), 0)
                    best = true.argmax(axis=1)
                    share = true[np.arange(len(n)), best] / np.maximum(n, 1)
                    langs = [f.langs[b] if m else "und" for b, m in zip(best.tolist(), n.tolist(), strict=True)]
                    score = np.where(n > 0, np.clip(share, 0, 1), 0.0)
                else:
                    langs, score = ["und"] * len(n), np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_grams: int = SAMPLE_GRAMS) -> BitmaskFilter:
    """Learn a filter from (doc_id, text, lang): about ``sample_docs`` whole texts per language, picked by a hash of
    the id, and of their n-grams the ``sample_grams`` commonest per language.  Every language is learned; only that comes to the driver."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    per_lang = known.groupBy("lang").agg(F.count("*").alias("c"))
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(sample_docs) / F.col("c")
    picked = known.join(F.broadcast(per_lang), "lang").where(share)
    counted = picked.select("text", "lang").mapInArrow(tidy(count_grams), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= sample_grams)
    rows = [(r.lang, r.gram) for r in best.select("lang", "gram").collect()]
    return BitmaskFilter(sorted({lang for lang, _ in rows}), rows)


def identify(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from rows that are not held out.

    Uses doc_id, text and lang; other columns are ignored.  A row is held out if crc32 of its doc_id as text
    leaves ``remainder`` (a null id counts as 0).  A null text or one without a letter is ``und`` with score 0,
    as is all where nothing can be learned; ties go to the language that sorts first; the score is the
    share of the text's n-grams that the language explains.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", crc_held_out("doc_id", modulus, remainder).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where("not held_out")))
    return docs.select("doc_id", "held_out", "text").mapInArrow(tidy(predict(model)), "doc_id long, held_out boolean, lang_pred string, score double")
