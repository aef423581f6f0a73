"""Chat formatting as a prefix tree: conversations that share initial turns share their text.

Nodes are turn prefixes, named by a hash chain.  Each node is owned by the smallest
conversation through it, so a conversation's path falls into chains, runs of nodes
with one owner, and a chain's nodes follow each other in a depth-first walk.  That walk is
a sort: a chain's own nodes come first, then the branches off it, deepest first.  The
stream is the nodes in that order, each emitted once, at an offset.  A position is
the length of the path above.  What a chain attends to is one interval of the stream for each
chain above it, up to where the path left it, and its own beginning.

Units are tokens of a public byte-level vocabulary, whose ids give back every text; the turn's head, text and
end are tokenized apart, so the loss mask falls between tokens.  Turns are ``<|im_start|>role\\ntext<|im_end|>\\n``; a
control opening ``<|`` inside a role or text gets a backslash, as do runs that look like
one already escaped, so it can be undone.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import materialize, tidy

START, END = "<|im_start|>", "<|im_end|>"
_NONE = -(1 << 63)
_FAR = 1 << 40


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > 4 << 20 or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema.names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


@functools.cache
def tokenizer(path: str):
    """The vocabulary at ``path``, once per Python worker; its own control strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@functools.cache
def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids' bytes in a row, bounds per id) of a byte-level vocabulary.

    Its tokens are written in printable characters: a byte that is one stands for itself, the others follow from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
    vocabulary = tokenizer(path).get_vocab()
    raw = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


_TURN = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("position", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_from", pa.int64()), ("loss_length", pa.int64())])
TURNS = "conv long, depth long, node binary, position long, length long, ids array<int>, loss_from long, loss_length long"


def format_turns(path: str):
    """Rows sorted by conversation and turn to tokenized segments; holds one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch

        def rows():
            now, depth, node, position = None, 0, b"", 0
            for batch in batches:
                turns = [(conv, role or "", text or "") for conv, role, text in _rows(iter([batch]))]
                heads = [f"{START}{_escape_role(role)}\n" for _, role, _ in turns]
                known = sorted(set(heads))
                ids_of = dict(zip([*known, END], [np.array(e.ids, np.int32) for e in encode([*known, f"{END}\n"], add_special_tokens=False)], strict=True))
                for at in range(0, len(turns), 256):
                    bodies = [escape(text) for _, _, text in turns[at : at + 256]]
                    for (conv, role, _), head, body, e in zip(turns[at : at + 256], heads[at : at + 256], bodies, encode(bodies, add_special_tokens=False), strict=True):
                        if conv != now:
                            now, depth, node, position = conv, 0, b"", 0
                        body_ids = np.array(e.ids, np.int32)
                        ids = np.concatenate([ids_of[head], body_ids, ids_of[END]])
                        node = hashlib.blake2b(node + f"{head}{body}{END}\n".encode(), digest_size=16).digest()
                        loss = (len(ids_of[head]), len(body_ids)) if role == "assistant" else (0, 0)
                        yield conv, depth, node, position, len(ids), ids, *loss
                        depth, position = depth + 1, position + len(ids)

        return _batches(rows(), _TURN, lambda r: 8 * len(r[5]))

    return run


_NODE = pa.schema([("chain", pa.int64()), ("order", pa.list_(pa.int64())), ("depth", pa.int64()), ("position", pa.int64()), ("length", pa.int64())])
_SPAN = pa.schema([("conv", pa.int64()), ("chain", pa.int64()), ("position", pa.int64()), ("length", pa.int64()), ("depth", pa.int64()), ("turns", pa.int64())])


def own_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, depth, owner, position, length) sorted by conv and depth to the nodes each conversation owns, with their place in the walk."""

    def rows():
        now, path, last = None, [], None
        for conv, depth, owner, position, length in _rows(batches):
            if conv != now:
                now, path, last = conv, [], None
            if owner != last:
                path += [owner] if last is None else [_FAR - depth, owner]
                last = owner
            if owner == conv:
                yield owner, [*path, -1, depth], depth, position, length

    return _batches(rows(), _NODE, lambda r: 8 * len(r[1]))


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains on each conversation's path: (conv, chain, position where it begins, length on this path, first depth, turns)."""

    def rows():
        open_ = None
        for conv, depth, owner, position, length in _rows(batches):
            if open_ and (open_[0], open_[1]) == (conv, owner):
                open_ = (*open_[:3], open_[3] + length, open_[4], open_[5] + 1)
            else:
                if open_:
                    yield open_
                open_ = (conv, owner, position, length, depth, 1)
        if open_:
            yield open_

    return _batches(rows(), _SPAN, lambda r: 32)


def running_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column("length"))
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chain", "depth", "position", "length")), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], ["chain", "depth", "position", "length", "part", "local"])
        total = int(ends[-1]) if len(n) else total


@dataclass
class ChatForest:
    """``segments``: the stream, a row per node (chain, depth, offset, position, length, ids, loss_from, loss_length); a token's
    position id is the node's position plus its place in ``ids``.
    ``chains``: what each chain attends to besides its own beginning (chain, offset, length, attends: [offset, length, position]).
    ``paths``: the chains on each conversation's path (conv, chain, offset, position, length, depth, turns)."""

    segments: DataFrame
    chains: DataFrame
    paths: DataFrame


def build(conversations: DataFrame, tokenizer_path: str) -> ChatForest:
    """The prefix forest of ``conversations`` (conv_id, turn, role, text; other columns are ignored), in tokens of a byte-level vocabulary.

    Rows are ordered by turn (null first), ties by role and then text; repeated rows are turns of their
    own.  A null text or role is empty, a null conv_id is one conversation.  An empty table gives an empty forest.
    """
    c = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = c.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    turns = materialize(turns.mapInArrow(tidy(format_turns(tokenizer_path)), TURNS))
    thin = turns.select("conv", "depth", "node", "position", "length")
    owners = thin.groupBy("node").agg(F.min("conv").alias("owner"))
    path = materialize(thin.join(owners, "node").select("conv", "depth", "owner", "position", "length"))
    sorted_path = path.repartition("conv").sortWithinPartitions("conv", "depth")
    nodes = sorted_path.mapInArrow(own_nodes, "chain long, order array<long>, depth long, position long, length long")
    walk = nodes.repartitionByRange("order").sortWithinPartitions("order")
    walk = materialize(walk.mapInArrow(running_offsets, "chain long, depth long, position long, length long, part int, local long"))
    # One sum per partition comes to the driver.
    sums = {r.part: r.n for r in walk.groupBy("part").agg(F.sum("length").alias("n")).collect()}
    base, total = [], 0
    for part in sorted(sums):
        base.append((part, total))
        total += sums[part]
    bases = turns.sparkSession.createDataFrame(base, "part int, base long")
    walk = walk.join(F.broadcast(bases), "part").select("chain", "depth", "position", "length", (F.col("base") + F.col("local")).alias("offset"))
    segments = walk.select("chain", "depth", "offset").join(turns.withColumnRenamed("conv", "chain"), ["chain", "depth"]).drop("node")
    own = walk.groupBy("chain").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"))
    on_path = sorted_path.mapInArrow(spans, "conv long, chain long, position long, length long, depth long, turns long")
    paths = materialize(on_path.join(own.select("chain", "offset"), "chain").select("conv", "chain", "offset", "position", "length", "depth", "turns"))
    above = paths.where("conv <> chain").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("position", "offset", "length"))).alias("attends"))
    chains = own.join(above.withColumnRenamed("conv", "chain"), "chain", "left").select("chain", "offset", "length", F.coalesce("attends", F.array().cast("array<struct<position:bigint,offset:bigint,length:bigint>>")).alias("attends"))
    return ChatForest(segments, chains, paths)


def read_back(path: str):
    """Rows (conv, position, ids, loss_from, loss_length) sorted by conv and position to a digest per conversation."""
    return lambda batches: _digests(batches, path)


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple]:
    """(conv, position, tokens, segment, text under the loss mask) per row; the ids of a batch become bytes all at once."""
    table, bounds = id_bytes(path)
    for batch in batches:
        lists = batch.column("ids")
        ids, n = np.asarray(lists.flatten(), np.int64), np.asarray(pc.list_value_length(lists), np.int64)
        size = bounds[ids + 1] - bounds[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = table[np.repeat(bounds[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        first = np.cumsum(n) - n
        start, length = (np.asarray(batch.column(c), np.int64) for c in ("loss_from", "loss_length"))
        cuts = np.stack([ends[first], ends[first + n], ends[first + start], ends[first + start + length]], axis=1).tolist()
        for conv, position, tokens, (a, b, c, d) in zip(batch.column("conv").to_pylist(), batch.column("position").to_pylist(), n.tolist(), cuts, strict=True):
            yield conv, position, tokens, raw[a:b].decode(), raw[c:d].decode()


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows():
        now, state = None, None

        def done():
            n, turns, chars, loss, total, _ = state
            return (None if now == _NONE else now), n, turns.hexdigest(), chars, loss.hexdigest(), total

        for conv, position, tokens, segment, learned in _decoded(batches, path):
            if conv != now or state is None:
                if state is not None:
                    yield done()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            if position != state[5] or not segment.startswith(START) or not segment.endswith(END + "\n"):
                raise ValueError(f"conversation {conv}: the stream has a gap at {state[5]}")
            role, text = segment[len(START) : -len(END) - 1].split("\n", 1)
            state[0] += 1
            state[1].update(f"{_unescape_role(role)}\n{unescape(text)}\n".encode())
            learned = unescape(learned)
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(segment)
            state[5] += tokens
        if state is not None:
            yield done()

    return _batches(rows(), schema, lambda r: 200)


def digest(forest: ChatForest, tokenizer_path: str) -> DataFrame:
    """What each conversation reads as in the stream: its chains' intervals, cut into segments, decoded and parsed.

    A path names the depths it takes of a chain, so a conversation meets its own turns and no others.
    """
    depths = F.explode(F.sequence(F.col("depth"), F.col("depth") + F.col("turns") - 1)).alias("depth")
    p = forest.paths.select("conv", "chain", F.col("offset").alias("begin"), F.col("position").alias("at"), depths)
    s = forest.segments.select("chain", "depth", "offset", "ids", "loss_from", "loss_length")
    found = p.join(s, ["chain", "depth"]).select("conv", (F.col("at") + F.col("offset") - F.col("begin")).alias("position"), "ids", "loss_from", "loss_length")
    found = found.repartition("conv").sortWithinPartitions("conv", "position")
    return found.mapInArrow(tidy(read_back(tokenizer_path)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
