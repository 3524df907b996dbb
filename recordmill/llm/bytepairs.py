"""Byte-pair encoding and decoding by tree concatenation.

A long text is cut in halves, down to leaves that are encoded on their own, and the halves are joined again from the bottom.
At a join the pre-tokens around the cut are read anew, in growing windows, until they meet a boundary that the right half has
too. A pre-token that goes through the cut, however long, keeps the tokens of both sides: growing windows of tokens around
the cut are encoded again until the window's first and last token are the ones that were there. That is exact: a token
sequence is the encoding of its bytes if and only if each two neighbours are the encoding of theirs, since a merge over a
boundary would also happen with the two tokens alone. Texts beyond SPREAD are dealt piece by piece over the cluster, and
only their joins are made in one task, that of the document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordmill.llm.tables import texts
from recordmill.session import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LEAF = 1 << 13             # code points that are encoded at once
PIECE = 1 << 16            # code points of a long text that one row holds
SPREAD = 1 << 18           # texts of more code points are dealt over the cluster
WINDOW, SEAM = 64, 4       # first window around a join, in code points and in tokens
CONTEXT = 2                # a pre-token depends on no more than this many characters after its end
SHORT = 256                # pre-tokens up to this size are simply encoded again
ROWS = 128                 # rows a task holds at once as Python objects

# Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRE_TOKEN = regex.compile(PATTERN)
# Characters whose class all libraries surely agree on; a text with others is split by the vocabulary's own library.
_OTHER = regex.compile("[^\x00-՗‐-⁞　-ゖ一-鿿가-힣]")
# The last space after something else than white space: every text has a boundary there, whatever stands around it.
_SURE = regex.compile(r"(?r)(?<=\S) ")


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class Codec:
    """The vocabulary of a file: byte-level, without a normaliser; added tokens are matched as they stand."""

    def __init__(self, path: str, special: bool = True) -> None:
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        if self.library.normalizer is not None or any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("a normaliser and added tokens that look at their surroundings are not supported")
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        value = {c: i for i, c in enumerate(letters)}

        def spelled(token: str) -> bytes:
            return bytes(map(value.__getitem__, token)) if all(c in value for c in token) else token.encode()

        self.bytes = {i: spelled(token) for token, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.size = np.zeros(max(self.bytes) + 1, np.int64)
        for i, data in self.bytes.items():
            self.size[i] = len(data)
        self.added = {t.content: i for i, t in added.items()} if special else {}
        in_order = sorted(self.added, key=len, reverse=True)
        self._added = regex.compile("(" + "|".join(map(regex.escape, in_order)) + ")") if in_order else None

        # Where ids follow the order of the merges, the quicker coder gives the same tokens.
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [ids.get(a + b, -1) for a, b in merges]
        in_merge_order = order == list(range(256, 256 + len(order))) and not model.get("ignore_merges")
        ranks = {spelled(token): i for token, i in ids.items() if i not in added}
        self.coder = tiktoken.Encoding("leaf", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_merge_order else None

    def merge(self, data: bytes) -> list[int]:
        """Ids of bytes taken as one pre-token."""
        return [t.id for t in self.library.model.tokenize(data.decode("latin-1").translate(self.letters))] if data else []

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _PRE_TOKEN.findall(text)

    def leaf(self, text: str) -> list[int]:
        """Ids of a stretch of text encoded on its own."""
        if self.coder is None or _OTHER.search(text):
            return [i for word in self.words(text) for i in self.merge(word.encode())]
        return self.coder.encode_ordinary(text)

    # --- joining ------------------------------------------------------------------------------

    def seam(self, left: list[int], right: list[int]) -> list[int]:
        """One encoding from the encodings of adjacent bytes of a pre-token."""
        size = SEAM
        while left and right:
            x, y = left[-size:], right[:size]
            both = self.merge(b"".join(map(self.bytes.__getitem__, x + y)))
            if (size >= len(left) or both[0] == x[0]) and (size >= len(right) or both[-1] == y[-1]):
                return left[:-size] + both + right[size:]
            size *= 2
        return left + right

    def tree(self, text: str, start: int, end: int) -> np.ndarray:
        """Ids of text[start:end]."""
        if end - start <= LEAF:
            return np.array(self.leaf(text[start:end]), np.int32)
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self.tree(text, start, middle), self.tree(text, middle, end))

    def join(self, text: str, start: int, cut: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[start:end] from those of text[start:cut] and text[cut:end]."""
        if start == cut or cut == end:
            return np.concatenate([left, right])
        begin = self._last_boundary(text, start, cut)
        words, theirs = self._reread(text, begin, cut, end)
        kept = len(left) - self._tokens_in(left[::-1], text[begin:cut])
        taken = self._tokens_in(right, "".join(theirs))
        old = [(begin, self.words(text[begin:cut]), left[kept:].tolist()), (cut, theirs, right[:taken].tolist())]
        fresh: list[int] = []
        for word, at in zip(words, accumulate(map(len, words), initial=begin)):
            fresh += self.merge(word.encode()) if len(word) <= SHORT else self._from_both(text, at, at + len(word), old)
        return np.concatenate([left[:kept], np.array(fresh, np.int32), right[taken:]])

    def _last_boundary(self, text: str, start: int, cut: int) -> int:
        """The start of a pre-token of text[start:cut] that stays one, whatever follows: all before it end CONTEXT characters ahead of the cut."""
        sure = _SURE.search(text, start, max(cut - CONTEXT + 1, start))
        if sure:
            return sure.start()
        at = start
        for after in accumulate(map(len, self.words(text[start:cut])), initial=start):
            if after > cut - CONTEXT:
                break
            at = after
        return at

    def _reread(self, text: str, begin: int, cut: int, end: int) -> tuple[list[str], list[str]]:
        """Pre-tokens from ``begin``, and those of the right half, up to the first boundary that both have."""
        reach = WINDOW
        while True:
            stop = min(cut + reach, end)
            words, theirs = self.words(text[begin:stop]), self.words(text[cut:stop])
            known = end if stop == end else stop - CONTEXT
            ours = {at: n for n, at in enumerate(accumulate(map(len, words), initial=begin)) if cut <= at <= known}
            for n, at in enumerate(accumulate(map(len, theirs), initial=cut)):
                if at in ours:
                    return words[: ours[at]], theirs[:n]
            reach *= 2

    def _tokens_in(self, ids: np.ndarray, text: str) -> int:
        """How many of the first ids make up the bytes of ``text``."""
        size = len(text.encode())
        return int(np.searchsorted(np.cumsum(self.size[ids[:size]]), size)) + 1 if size else 0

    def _from_both(self, text: str, start: int, end: int, old: list[tuple[int, list[str], list[int]]]) -> list[int]:
        """Ids of the long pre-token text[start:end] from the old tokens that lie in it; what they leave open is encoded, then joined."""
        whole = text[start:end].encode()
        out: list[int] = []
        done = 0
        for place, words, ids in old:
            at = len(text[start:place].encode()) if place >= start else -len(text[place:start].encode())
            first = 0
            for word in words:
                stop, inside = at + len(word.encode()), []
                while at < stop:
                    token, first = ids[first], first + 1
                    if at >= done and at + self.size[token] <= len(whole):
                        if not inside:
                            out = self.seam(out, self.merge(whole[done:at]))
                        inside.append(token)
                        done = at + int(self.size[token])
                    at += int(self.size[token])
                out = self.seam(out, inside)
        return self.seam(out, self.merge(whole[done:]))

    # --- whole texts --------------------------------------------------------------------------

    def sections(self, text: str) -> list[tuple[int | None, str]]:
        """The text between added tokens, and those tokens with their id."""
        if not self._added:
            return [(None, text)] if text else []
        return [(self.added.get(part), part) for part in self._added.split(text) if part]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for added, part in self.sections(text):
            if added is not None:
                out.append(added)
            elif len(part) <= LEAF:
                out += self.leaf(part)
            else:
                out += self.tree(part, 0, len(part)).tolist()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that the vocabulary lacks give nothing, bytes that are no UTF-8 the replacement character."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str, special: bool = True) -> Codec:
    return Codec(path, special)


_IDS = pa.list_(pa.int32())


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def encode(docs: DataFrame, path: str = VOCABULARY, special: bool = True) -> DataFrame:
    """doc_id and ids of every whole text, as the vocabulary's library gives them without its post-processor.

    Null texts have null ids, empty ones none. ``special``: added tokens inside a text get their own id, else they are plain
    text. Other columns are ignored; null and repeated ids give a row each; an empty table gives none. The file must stand
    under ``path`` on every worker.
    """
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, special)
        for part in _some_rows(batches):
            ids = [None if t is None else c.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, _IDS)], ["doc_id", "ids"])

    rows = texts(docs)
    few = rows.where(F.col("text").isNull() | (F.length("text") <= SPREAD)).mapInArrow(whole, "doc_id long, ids array<int>")
    # Rows are told apart by a number that is written once, since ids may be null or repeated.
    many = stage(docs.select("doc_id", "text").where(F.length("text") > SPREAD).withColumn("_row", F.monotonically_increasing_id()), "long")
    return few.unionByName(_encode_dealt(many, path, special))


def _encode_dealt(many: DataFrame, path: str, special: bool) -> DataFrame:
    """Pieces of the long texts are encoded wherever there is room; each document's task joins them."""
    piece_type = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("added", pa.int32()), ("piece", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, special)
        for batch in batches:
            for doc, text, row in zip(*batch.columns, strict=True):
                pieces = (
                    (added, part[i : i + PIECE])
                    for added, part in c.sections(text.as_py()) for i in (range(0, len(part), PIECE) if added is None else (0,))
                )
                for place, (added, piece) in enumerate(pieces):
                    yield pa.RecordBatch.from_pylist(
                        [{"_row": row.as_py(), "doc_id": doc.as_py(), "place": place, "added": added, "piece": piece}], piece_type)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, special)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text, added = row.column(4)[0].as_py(), row.column(3)[0].as_py()
                ids = c.tree(text, 0, len(text)) if added is None else np.array([added], np.int32)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([ids], _IDS)], [*row.schema.names, "ids"])

    def join(table: pa.Table) -> pa.Table:
        c = codec(path, special)
        table = table.sort_by("place")
        added, pieces = table.column("added").to_pylist(), table.column("piece").to_pylist()
        made = [ids.values.to_numpy(zero_copy_only=False) for ids in table.column("ids")]
        out: list[np.ndarray] = []
        row = 0
        while row < len(added):
            last = row + 1
            while added[row] is None and last < len(added) and added[last] is None:
                last += 1
            parts = made[row:last]
            edges = list(accumulate(map(len, pieces[row:last]), initial=0))
            text = "".join(pieces[row:last])
            while len(parts) > 1:
                joined = [c.join(text, *edges[i : i + 3], *parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
                parts = joined + parts[2 * len(joined) :]
                edges = edges[:-1:2] + edges[-1:]
            out += parts
            row = last
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([np.concatenate(out)], _IDS)})

    types = "_row long, doc_id long, place long, added int, piece string"
    dealt = many.select("doc_id", "text", "_row").mapInArrow(cut, types).repartition("_row", "place")
    return dealt.mapInArrow(one, f"{types}, ids array<int>").groupBy("_row").applyInArrow(join, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids and text of ``rows`` (doc_id, ids). Null ids give a null text, unknown or null ids in the list give nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in _some_rows(batches):
            out = [None if x is None else c.decode(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def encoding_digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of every text; null texts count as empty.

    Ids are those of ``encode``, the text is that of ``decode``; rows are as described there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some_rows(batches):
            ids = [b"" if x.values is None else x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in part.column(2).to_pylist()], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return decode(encode(docs, path), path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
