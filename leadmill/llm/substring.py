"""Exact substring deduplication by compaction of a token de Bruijn graph.

Every window of k words is an edge of the graph.  Edges are partitioned by their
minimizer (the leftmost smallest hash among the s-grams inside the window), and
consecutive edges of a document with one minimizer are compacted at once into a
path.  Equal windows have equal minimizers at equal offsets, so:

1. a minimizer that occurs once has no repeated edge, and its path leaves;
2. paths of one minimizer with equal content are a nonbranching path that repeats:
   all but the first by source coordinates go as a whole;
3. only where one minimizer has several contents (the path branches there), the first
   path of each content is expanded into edges again, which are compared one by one
   by a 128-bit hash and their coordinates;
   A text's paths with one content are one record with their positions, so that a text in which
   a few words alternate has a few records and not one every other word;
4. paths and edges that follow each other both in their document and in the source are
   compacted into spans: a span ends where the walk branches, that is where the next edge has
   another source or none;
5. a document's spans with one source row are one record; they are verified at their coordinates: the words in
   the document are compared with the words at the source by a digest of both, and stay where these differ.

Texts move compressed, keyed by document, and only those of documents with windows to compare
or to take out; all else that moves is a few longs per path.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from leadmill.llm.common import CHUNK_BYTES, hash_words, materialize, members, membership, pair_hash, slices, slot, split_words, tidy, window_hash

SEED_WORDS = 6
# A position in a document: the start and, in the last 6 bits, the path's length.  A row is its doc_id and a hash of its text.
_LEN_BITS = 6
ROW = ["doc", "mark"]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _zip(texts: pa.Array) -> pa.Array:
    return pa.array([None if not t.is_valid else pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in texts], pa.binary())


def _unzip(blob: bytes | None, size: int) -> bytes:
    return b"" if blob is None or not size else pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)


def minimizers(seeds: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest seed in each window of ``width``, by doubling."""
    at, low, done = np.arange(len(seeds), dtype=np.int32), seeds, 1
    while done < width:
        step = min(done, width - done)
        right = low[step:] < low[:-step]
        at, low = np.where(right, at[step:], at[:-step]), np.where(right, low[step:], low[:-step])
        done += step
    return at


def paths_of(h: np.ndarray, bounds: np.ndarray, k: int, s: int):
    """Paths of a chunk: (document index, first window's start in it, windows, minimizer hash, content hash)."""
    if len(h) < k:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    seeds = window_hash(h, s)
    width = k - s + 1
    at = np.arange(len(h) - k + 1)
    where = minimizers(seeds, width)[: len(at)]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    inside = at + k <= bounds[doc + 1]
    head = inside.copy()
    head[1:] &= ~(inside[:-1] & (where[1:] == where[:-1]) & (doc[1:] == doc[:-1]))
    first = np.flatnonzero(head)
    tail = inside.copy()
    tail[:-1] &= head[1:] | ~inside[1:]
    last = np.flatnonzero(tail)
    w = window_hash(h, k)
    n = last - first + 1
    content = pair_hash(pair_hash(w[first], w[last]), n.astype(np.uint64))
    return doc[first], first - bounds[doc[first]], n, seeds[where[first]], content


def _words(batch: pa.RecordBatch):
    codes, bounds, words = split_words(batch.column("text"), raw=True)
    return (hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)), bounds


def emit_paths(k: int, s: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, bounds = _words(batch)
                doc, start, n, seed, content = paths_of(h, bounds, k, s)
                doc, seed, content, pos, more = by_content(doc, seed, content, (start << _LEN_BITS) | n)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(seed)), batch.column("doc").take(at), batch.column("mark").take(at), pa.array(pos), pa.array(_signed(content)), more], ["seed", "doc", "mark", "pos", "content", "more"])

    return run


def by_content(doc: np.ndarray, seed: np.ndarray, content: np.ndarray, pos: np.ndarray):
    """Paths in order of position, those of one document, seed and content as one: (document, seed, content, first position, list of the others or null)."""
    order = np.lexsort((content, seed, doc))
    doc, seed, content, pos = doc[order], seed[order], content[order], pos[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1]) | (content[1:] != content[:-1])
    first = np.flatnonzero(head)
    others = np.diff(np.append(first, len(doc))) - 1
    ends = pa.array(np.concatenate(([0], np.cumsum(others))), pa.int32())
    more = pa.ListArray.from_arrays(ends, pa.array(pos[~head], pa.int64()), mask=pa.array(others == 0))
    return doc[first], seed[first], content[first], pos[first], more


def compress_texts(wanted):
    """Compressed texts of the rows that the membership table ``wanted`` lets through."""

    def run(batches):
        for whole in batches:
            for batch in slices(members(whole, wanted.value), "text"):
                more = [c for c in batch.schema.names if c == "carried"]
                texts = batch.column("text").cast(pa.large_string())
                size = [0 if t is None else len(t) for t in (x.as_buffer() for x in texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), _zip(texts), pa.array(size, pa.int64()), *(batch.column(c) for c in more)], ["doc", "mark", "z", "size", *more])

    return run


def _rows_of(lists: pa.Array) -> np.ndarray:
    """The row of each element of a column of lists."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return np.repeat(np.arange(len(sizes)), sizes)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch of compressed texts by their full size."""
    part = np.cumsum(np.asarray(batch.column("size"), np.int64)) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def expand_edges(k: int):
    """Edges of the paths named in ``at``, with their 128-bit hash and coordinates."""

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            row, at = _rows_of(batch.column("at")), np.asarray(batch.column("at").flatten(), np.int64)
            start, n = at >> _LEN_BITS, at & ((1 << _LEN_BITS) - 1)
            texts = pa.array([_unzip(z, size) for z, size in zip(batch.column("z").to_pylist(), batch.column("size").to_pylist(), strict=True)], pa.large_binary())
            codes, bounds, words = split_words(texts.view(pa.large_string()), raw=True)
            if not len(row) or len(codes) < k:
                continue
            i = np.unique(np.repeat(bounds[row] + start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            w1 = window_hash(hash_words(words)[codes], k)[i]
            w2 = window_hash(hash_words(words, 1)[codes], k)[i]
            row = np.searchsorted(bounds, i, "right") - 1
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(w1)), pa.array(_signed(w2)), batch.column("doc").take(at), batch.column("mark").take(at), pa.array(((i - bounds[row]) << _LEN_BITS) | 1)], ["w1", "w2", "doc", "mark", "pos"])

    return run


SPANS = "doc long, mark long, sdoc long, smark long, at array<struct<start:long,sstart:long,n:long>>"


def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``SPANS`` of rows (doc, mark, found), ``found`` a row's records as (at, sdoc, smark, spos), ``at`` their positions in it."""
    for batch in batches:
        found = batch.column("found").flatten()
        which = _rows_of(found.field("at"))
        row = _rows_of(batch.column("found"))[which]
        pos = np.asarray(found.field("at").flatten(), np.int64)
        sdoc, smark, spos = (np.asarray(found.field(f), np.int64)[which] for f in ("sdoc", "smark", "spos"))
        order = np.lexsort((pos, row))
        row, pos, sdoc, smark, sstart = row[order], pos[order], sdoc[order], smark[order], spos[order] >> _LEN_BITS
        start, n = pos >> _LEN_BITS, pos & ((1 << _LEN_BITS) - 1)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (sdoc[1:] != sdoc[:-1]) | (smark[1:] != smark[:-1]) | (start[1:] != (start + n)[:-1]) | (sstart[1:] != (sstart + n)[:-1])
        first = np.flatnonzero(new)
        n = np.add.reduceat(n, first) if len(first) else n
        row, start, sstart, sdoc, smark = row[first], start[first], sstart[first], sdoc[first], smark[first]
        order = np.lexsort((start, smark, sdoc, row))
        row, start, sstart, sdoc, smark, n = row[order], start[order], sstart[order], sdoc[order], smark[order], n[order]
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (sdoc[1:] != sdoc[:-1]) | (smark[1:] != smark[:-1])
        first = np.flatnonzero(head)
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(sstart), pa.array(n)], ["start", "sstart", "n"])
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), spans)
        kept = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(kept), batch.column("mark").take(kept), pa.array(sdoc[first]), pa.array(smark[first]), at], ["doc", "mark", "sdoc", "smark", "at"])


def compact(records: DataFrame) -> DataFrame:
    """``records`` (doc, mark, at, source) of repeated paths and edges, ``at`` their positions in the row, to spans: (doc, mark, sdoc, smark, at), ``at`` the (start, sstart, n) of a row's spans with one source row.

    Records that follow each other in their row and in one source row are one span; a row's records meet in a task, as its words did.  Equal rows
    have equal records, which count once.
    """
    found = F.struct("at", F.col("source.doc").alias("sdoc"), F.col("source.mark").alias("smark"), F.col("source.pos").alias("spos"))
    return records.distinct().groupBy(*ROW).agg(F.collect_list(found).alias("found")).mapInArrow(tidy(join_spans), SPANS)


def _digest(words: list[bytes], start: int, n: int, k: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n + k - 1]), digest_size=16).digest()


def read_spans(k: int):
    """(sdoc, smark, spots, digests) of the words under the spans of each list in ``at``."""

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            row, lists = _rows_of(batch.column("at")), batch.column("at").flatten()
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            digests = []
            for i, (z, size) in enumerate(zip(batch.column("z").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                words, known = _unzip(z, size).split(), {}
                for spots in lists.slice(begin[i], begin[i + 1] - begin[i]).to_pylist():
                    for s in spots:
                        if (x := (s["sstart"], s["n"])) not in known:
                            known[x] = _digest(words, *x, k)
                    digests.append([known[s["sstart"], s["n"]] for s in spots])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("mark").take(at), lists, pa.array(digests, pa.list_(pa.binary()))], ["sdoc", "smark", "spots", "digests"])

    return run


def cut(k: int, with_text: bool):
    """What is left of each document once the spans named in ``at`` are taken out whose words are those at their sources."""

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            row, spans = _rows_of(batch.column("at")), batch.column("at").flatten()
            start, n = (np.asarray(spans.field(f), np.int64) for f in ("start", "n"))
            end, source = start + n + (k - 1), spans.field("digest").to_pylist()
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            n_words, removed, digest, texts = [], [], [], []
            for i, (z, size) in enumerate(zip(batch.column("z").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                words = _unzip(z, size).split()
                n_words.append(len(words))
                gone, (a, b) = 0, begin[i : i + 2]
                same = np.array([j for j in range(a, b) if _digest(words, int(start[j]), int(n[j]), k) == source[j]], np.int64)
                if len(same):
                    edge = np.bincount(start[same], minlength=len(words) + 1) - np.bincount(end[same], minlength=len(words) + 1)
                    stay = np.cumsum(edge)[:-1] == 0
                    gone = len(words) - int(stay.sum())
                    words = list(itertools.compress(words, stay.tolist()))
                removed.append(gone)
                left = b" ".join(words)
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode() if gone else None if z is None else _unzip(z, size).decode())
            out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array(texts, pa.string()), batch.column("carried")], [*names, "kept_text", "carried"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def keep_whole(wanted, with_text: bool):
    """The digests of documents that the membership table ``wanted`` holds back: they lose nothing and move nowhere."""

    def run(batches):
        for whole in batches:
            for batch in slices(members(whole, wanted.value, inside=False), "text"):
                words = [t.as_py().encode().split() if t.is_valid else [] for t in batch.column("text")]
                none = pa.array(np.zeros(batch.num_rows, np.int64))
                out = [batch.column("doc_id"), pa.array(map(len, words), pa.int64()), none, pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    out, names = [*out, batch.column("text").cast(pa.string()), batch.column("carried")], [*names, "kept_text", "carried"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def with_repeats_removed(docs: DataFrame, k: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated windows' words taken out of the texts.

    A text that loses words becomes its kept words joined by one space, and n_chars, if there is
    one, its new length; other rows stay as they are.  See ``remove_repeats`` for the cases.
    """
    out = remove_repeats(docs, k, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    new = {c: F.col(f"carried.{c}") for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    new |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")}
    return out.select(*(new[c].alias(c) for c in docs.columns))


def remove_repeats(docs: DataFrame, k: int = 20, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, without the words of windows that start earlier elsewhere.

    Uses doc_id and text; other columns are ignored.  ``carry`` names columns to bring along in the struct
    ``carried`` and adds ``kept_text``: the kept words joined by one space for rows that lost words, else
    the text as it was.  A null, empty or short text loses nothing.
    Earlier means smaller doc_id (null is smallest), then earlier start; rows that share a
    doc_id, or have none, but not the text are ordered by a hash of the text, and fully equal rows keep their
    words both, as neither starts earlier.  An empty table gives no rows.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    with_text = carry is not None
    carried = [F.struct(*(F.col(c) for c in carry or []), F.lit(1).alias("_")).alias("carried")] if with_text else []
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), mark.alias("mark"), "text", *carried)
    paths = docs.select("doc", "mark", "text").mapInArrow(tidy(emit_paths(k, SEED_WORDS)), "seed long, doc long, mark long, pos long, content long, more array<long>")
    here = F.struct("doc", "mark", "pos")

    c = F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)).alias("c")
    often = paths.groupBy("seed").agg(c, F.min("content").alias("lo"), F.max("content").alias("hi")).where("c > 1")
    again = materialize(paths.join(often.select("seed", (F.col("lo") != F.col("hi")).alias("branches")), "seed"))
    first = again.groupBy("seed", "content").agg(F.min(here).alias("source"), c)
    # Rows that are equal have the source's place too; of its own positions all but the first are copies.
    every = F.concat(F.array("pos"), F.coalesce("more", F.array().cast("array<long>")))
    copies = again.join(first.where("c > 1").select("seed", "content", "source"), ["seed", "content"])
    copies = copies.select(*ROW, F.when(here == F.col("source"), F.col("more")).otherwise(every).alias("at"), "source").where("at is not null")
    heads = again.where("branches").join(first.select("seed", "content", "source"), ["seed", "content"]).where(here == F.col("source"))
    heads = materialize(heads.groupBy(*ROW).agg(F.collect_set("pos").alias("at")))

    docs = docs.withColumn("slot", slot(*ROW))
    schema = StructType([StructField("doc", LongType()), StructField("mark", LongType()), StructField("z", BinaryType()), StructField("size", LongType())])
    packed = lambda keys: docs.select(*ROW, "text", "slot").mapInArrow(tidy(compress_texts(membership(keys, *ROW))), schema).join(keys, ROW)
    edges = materialize(packed(heads).mapInArrow(tidy(expand_edges(k)), "w1 long, w2 long, doc long, mark long, pos long"))
    lead = edges.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(here).alias("source")).where("c > 1")
    later = edges.join(lead.select("w1", "w2", "source"), ["w1", "w2"]).where(here != F.col("source")).select(*ROW, F.array("pos").alias("at"), "source")

    pairs = compact(copies.unionByName(later))
    pairs = materialize(pairs.withColumn("spots", F.transform("at", lambda x: F.struct(x["sstart"].alias("sstart"), x["n"].alias("n")))))
    sources = materialize(pairs.select(F.col("sdoc").alias("doc"), F.col("smark").alias("mark"), "spots").distinct().groupBy(*ROW).agg(F.collect_list("spots").alias("at")))
    digests = packed(sources).mapInArrow(tidy(read_spans(k)), "sdoc long, smark long, spots array<struct<sstart:long,n:long>>, digests array<binary>")
    named = pairs.join(digests.distinct(), ["sdoc", "smark", "spots"])
    named = named.select(*ROW, F.zip_with("at", "digests", lambda x, d: F.struct(x["start"].alias("start"), x["n"].alias("n"), d.alias("digest"))).alias("at"))
    gone = materialize(named.groupBy(*ROW).agg(F.flatten(F.collect_list("at")).alias("at")))
    touched, wide = membership(gone, *ROW), StructType([*schema, *(docs.schema[c] for c in docs.columns if c == "carried")])
    some = docs.mapInArrow(tidy(compress_texts(touched)), wide).join(gone, ROW, "left").drop("mark")
    doc_id = F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id")
    digest = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    if with_text:
        digest = StructType([*digest, StructField("kept_text", StringType()), docs.schema["carried"]])
    some = some.select(doc_id, *(c for c in some.columns if c != "doc")).mapInArrow(tidy(cut(k, with_text)), digest)
    rest = docs.select(doc_id, *(c for c in docs.columns if c not in ("doc", "mark")))
    return some.unionByName(rest.mapInArrow(tidy(keep_whole(touched, with_text)), digest))
