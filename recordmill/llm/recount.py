"""Edit-aware token counts: a tree of sums over each document's pre-tokens, in which an edit re-encodes only what it touches.

Leaves hold runs of pre-tokens (length and tokens of each); inner nodes hold the sums below them. An edit descends to its
place, re-reads from a pre-token it cannot have changed until the old boundaries are met again, and updates the sums above.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.session import widen

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 32                  # pre-tokens of a leaf at first
CONTEXT = 2                # a pre-token depends on no more than this many characters after its end
CACHED = 1 << 17           # pre-tokens whose counts a worker keeps
# Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRE_TOKEN = regex.compile(PATTERN)

Leaf = list[tuple[int, int]]  # (characters, tokens) of each pre-token


@lru_cache(2)
def _counter(path: str):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lru_cache(CACHED)(lambda piece: len(coder.encode_ordinary(piece)))


class Tree:
    """Sums of characters and tokens over leaves, as two heaps: node i has the children 2 i and 2 i + 1."""

    def __init__(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.width + i] = sum(c for c, _ in leaf)
            self.tokens[self.width + i] = sum(t for _, t in leaf)
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def put(self, at: int, leaf: Leaf) -> None:
        self.leaves[at] = leaf
        i = self.width + at
        self.chars[i], self.tokens[i] = sum(c for c, _ in leaf), sum(t for _, t in leaf)
        while i > 1:
            i //= 2
            self._add_up(i)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character's place, and where that leaf begins; the last leaf for places past the end."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if place - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        at = min(i - self.width, len(self.leaves) - 1)
        return (at, begin) if i - self.width == at else (at, self.chars[1] - self.chars[self.width + at])


def build(text: str, count) -> Tree:
    pairs = [(len(p), count(p)) for p in _PRE_TOKEN.findall(text)]
    return Tree([pairs[i : i + LEAF] for i in range(0, len(pairs), LEAF)])


def edit(tree: Tree, text: str, start: int, end: int, new: str, count) -> tuple[str, int]:
    """Replace ``text[start:end]`` by ``new`` in text and tree; the new text and the number of pre-tokens encoded again.

    Places beyond the text are cut to it, an end before its start counts as the start.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    after = text[:start] + new + text[end:]
    shift = len(after) - len(text)

    # The last boundary that the edit cannot have moved: the pre-token before it ends CONTEXT characters ahead of the edit.
    first, begin = tree.find(max(start - CONTEXT, 0))
    while begin > max(start - CONTEXT, 0) and first:
        first -= 1
        begin -= tree.chars[tree.width + first]
    kept, at = 0, begin
    for chars, _ in tree.leaves[first]:
        if at + chars > start - CONTEXT:
            break
        at += chars
        kept += 1

    # Read on until a boundary past the edit is an old one too.
    leaf, place, old = first, kept, at
    fresh: Leaf = []
    while True:
        while at - shift > old or old < end:
            if place < len(tree.leaves[leaf]):
                old += tree.leaves[leaf][place][0]
                place += 1
            elif leaf + 1 < len(tree.leaves):
                leaf, place = leaf + 1, 0
            else:
                break
        if at >= start + len(new) and at - shift == old and old >= end:
            break
        found = _PRE_TOKEN.match(after, at)
        if not found:
            break
        at = found.end()
        fresh.append((at - found.start(), count(found[0])))
    rest = tree.leaves[leaf][place:]
    head = tree.leaves[first][:kept]
    if leaf == first:
        tree.put(first, head + fresh + rest)
    else:
        tree.put(first, head + fresh)
        for i in range(first + 1, leaf):
            tree.put(i, [])
        tree.put(leaf, rest)
    return after, len(fresh)


_LEAVES = "array<array<struct<chars:int,tokens:int>>>"
_TYPE = pa.list_(pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())])))


def count_trees(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """``rows`` (doc_id, text and more) with ``leaves``, the state that is kept, and n_tokens. Null texts count as empty."""
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                trees = [build(t or "", count) for t in part.column(at).to_pylist()]
                leaves = [[[{"chars": c, "tokens": k} for c, k in leaf] for leaf in t.leaves] for t in trees]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(leaves, _TYPE), pa.array([t.tokens[1] for t in trees], pa.int64())],
                    [*part.schema.names, "leaves", "n_tokens"],
                )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, leaves {_LEAVES}, n_tokens long")


def apply_edits(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """Apply each row's edits, in order, to its text and its tree.

    ``rows`` has doc_id, text, leaves and edits, an array of (start, end, new) in code points of the text as the edits before left
    it. Returns doc_id, text, leaves, n_tokens and n_encoded (pre-tokens encoded again). Null edits and null parts change nothing
    (null ``new`` is empty); a null text counts as empty. Rows are independent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                out = []
                for text, leaves, edits in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    text, again = text or "", 0
                    tree = Tree([[(p["chars"], p["tokens"]) for p in leaf] for leaf in leaves])
                    for e in edits or ():
                        if e is not None and e["start"] is not None and e["end"] is not None:
                            text, n = edit(tree, text, e["start"], e["end"], e["new"] or "", count)
                            again += n
                    out.append((text, [[{"chars": c, "tokens": k} for c, k in leaf] for leaf in tree.leaves], tree.tokens[1], again))
                columns = [list(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], _TYPE),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    ["doc_id", "text", "leaves", "n_tokens", "n_encoded"],
                )

    return rows.select("doc_id", "text", "leaves", "edits").mapInArrow(run, f"doc_id long, text string, leaves {_LEAVES}, n_tokens long, n_encoded long")


def recount(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after and n_encoded of rows of doc_id, text and edits: trees are built, then edited.

    One pass over the rows: the tree of a document goes from building to editing without a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                text, again = text.as_py() or "", 0
                tree = build(text, count)
                before = tree.tokens[1]
                for e in edits.as_py() or ():
                    if e is not None and e["start"] is not None and e["end"] is not None:
                        text, n = edit(tree, text, e["start"], e["end"], e["new"] or "", count)
                        again += n
                out.append((before, tree.tokens[1], again, sum(map(len, tree.leaves))))
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "n_tokens_after", "n_encoded", "n_pre_tokens"])

    return widen(rows.select("doc_id", "text", "edits")).mapInArrow(
        run, "doc_id long, n_tokens long, n_tokens_after long, n_encoded long, n_pre_tokens long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text and three edits of every document at places its id decides: a replacement, a deletion and an addition."""
    n = F.length(F.coalesce("text", F.lit("")))

    def place(salt: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), n + 1).cast("int")

    def one(start, size: int, new: str):
        return F.struct(start.alias("start"), (start + size).alias("end"), F.lit(new).alias("new"))

    return docs.select("doc_id", "text", F.array(one(place(1), 12, "<redacted>"), one(place(2), 40, ""), one(n, 0, "\nAdded 2 words.")).alias("edits"))
