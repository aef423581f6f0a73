"""Harmonic packing of tokenized documents into training sequences.

A document's ids are cut into pieces whose lengths are reciprocals of the capacity:
capacity // j for some j.  All pieces of one length form a class, and each bin of the
class takes exactly j of them, so a bin is full by counting alone.  Only classes
that leave at most two places of a bin unused are taken.  Every task fills bins of
its own from the rows it reads: nothing is shuffled, and a task holds less than one bin
per class.  What is left in a task's unfilled classes at its end is laid end to end
into further sequences, the last of them cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import bound_batches, slices, split_words, tidy

#: Most words whose ids a worker keeps, about 50 MB.
CACHE_WORDS = 250_000
END_ID = 1
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which starts contractions


def _parts(words: pa.Array) -> tuple[list[str], list[str]]:
    """(what is encoded, punctuation behind it) of each word: ASCII words without ``<|`` in lower case, letters apart from a tail.

    A capital I with a dot becomes a letter and a mark, which joins a tail, so words with it are not split.
    """
    plain = pc.and_(pc.equal(pc.binary_length(words), pc.cast(pc.utf8_length(words), pa.int32())), pc.invert(pc.match_substring(words, "<|")))
    low = pc.if_else(plain, pc.ascii_lower(words), words)
    base = pc.utf8_rtrim(low, _TAIL)
    split = pc.and_(pc.and_(pc.not_equal(pc.binary_length(base), pc.binary_length(low)), pc.utf8_is_alpha(base)), pc.match_substring_regex(base, r"^[\x{0}-\x{12F}\x{131}-\x{24F}]+$"))
    listed = lambda x: x.to_numpy(zero_copy_only=False).tolist()
    bases, tails = listed(pc.if_else(split, base, low)), [""] * len(words)
    at = np.flatnonzero(np.asarray(split))
    for i, w in zip(at.tolist(), listed(low.take(pa.array(at))), strict=True):
        tails[i] = w[len(bases[i]) :]
    return bases, tails


class WordEncoder:
    """Ids of whole texts, word by word, with a bounded cache.

    The tokenizer drops white space and no token spans it, so a text's ids are its
    words' ids in a row.  It lower-cases, so words of ASCII alone are folded first; not those
    that may hold a special token, which it finds before, nor others, as letters and marks are composed before too.  Letters followed by
    ASCII punctuation are two pre-tokens and are cached apart.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), cache_words, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> None:
        """Add the ids of ``words`` to the cache: letters 128 at a time in one line, others 64 at a time, each alone that may hold a special token."""
        lines, rest = [], []
        simple = [w for w in words if w.isalpha() and max(w) < "ɐ"]
        for at in range(0, len(simple), 128):
            lines.append(simple[at : at + 128])
        for group, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(g) for g in lines], add_special_tokens=False), strict=True):
            # A run of letters is one pre-token, and its last id says so; where a letter changes on the way, the words go the longer way.
            ids = np.array(e.ids, np.uint32)
            cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(cuts) == len(group):
                raw, a = ids.tobytes(), 0
                for w, b in zip(group, cuts, strict=True):
                    self.known[w] = raw[a:b]
                    a = b
            else:
                rest += group
        for w in words:
            if "<|" in w:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
        taken = set(simple)
        rest += [w for w in words if "<|" not in w and w not in taken]
        groups = [rest[i : i + 64] for i in range(0, len(rest), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids, at = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            cuts = np.searchsorted(at, np.arange(len(group) + 1))
            raw = ids.tobytes()
            for w, a, b in zip(group, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.known[w] = raw[4 * a : 4 * b]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, bounds per text)."""
        codes, bounds, words = split_words(texts, arrow=True)
        bases, tails = _parts(words)
        if len(self.known) > self.limit:
            self.known = {"": b""}
        known = self.known
        new = {p for p in (*bases, *set(tails)) if p not in known}
        if new:
            self._encode(list(new))
        raw = [known[a] + known[b] for a, b in zip(bases, tails, strict=True)]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        flat = np.frombuffer(b"".join(raw), np.uint32)
        begin = np.cumsum(size) - size
        n = size[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)]
        return ids, np.concatenate(([0], ends))[bounds]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def classes(capacity: int, waste: int = 2) -> list[int]:
    """Piece lengths capacity // j, falling, whose full bin of j pieces leaves at most ``waste`` places."""
    return sorted({capacity // j for j in range(1, capacity + 1) if capacity % j <= waste}, reverse=True)


def cut_lengths(n: int, lengths: list[int]) -> list[int]:
    """``n`` as a sum of class lengths, largest first."""
    out = []
    for length in lengths:
        k, n = divmod(n, length)
        out += [length] * k
        if not n:
            break
    return out


def pack(tokenizer_path: str, capacity: int, with_ids: bool):
    lengths = classes(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 36
        waiting: dict[int, list] = {length: [] for length in lengths}
        rows: list[tuple] = []
        ids_out: list[np.ndarray] = []

        def put(piece, offset):
            doc, start, ids, total = piece
            rows.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset))
            if with_ids:
                ids_out.append(ids.copy())

        def flush():
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols, names = [*cols, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            rows.clear()
            ids_out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for whole in batches:
            for batch in slices(whole, "text"):
                flat, bounds = encode(batch.column("text"))
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.append(flat[a:b], np.uint32(END_ID))
                    start = 0
                    for length in cut_lengths(len(ids), lengths):
                        piece = (doc, start, ids[start : start + length], len(ids))
                        start += length
                        bin_ = waiting[length]
                        if len(bin_) + 1 == capacity // length:
                            for i, p in enumerate([*bin_, piece]):
                                put(p, i * length)
                            bin_.clear()
                            sequence += 1
                        else:  # a copy, as a view would keep the whole document
                            bin_.append((*piece[:2], piece[2].copy(), piece[3]))
                if len(rows) > 20_000:
                    yield flush()

        # What no class could fill: end to end, cut where a sequence ends.
        left = [p for length in lengths for p in waiting[length]]
        room, rest = 0, sum(len(p[2]) for p in left)
        offset = 0
        for doc, start, ids, total in left:
            while len(ids):
                if not room:
                    room = capacity if rest >= capacity else 1 << (rest.bit_length() - 1)
                    rest -= room
                    offset = 0
                take = min(room, len(ids))
                put((doc, start, ids[:take], total), offset)
                offset, room, start, ids = offset + take, room - take, start + take, ids[take:]
                if not room:
                    sequence += 1
        if rows:
            yield flush()

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most ``capacity`` ids.

    Uses doc_id and text; other columns are ignored.  A document is its ids and then id 1; a
    null, empty or blank text is id 1 alone.  Every id is in exactly one piece;
    repeated rows are packed each; a null doc_id stays null.  ``with_ids`` adds the piece's ids, from
    which a sequence is read by sorting its pieces by offset.  An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(tidy(pack(tokenizer_path, capacity, with_ids)), PIECES + (", ids array<int>" if with_ids else ""))
