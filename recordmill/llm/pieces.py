"""SentencePiece encoding and decoding by a streaming Viterbi search over a public vocabulary.

The best segmentation is searched from left to right; costs are kept for no more places than the longest piece can reach back to.
Whenever the back-pointers of all places that may still be extended lead over one common boundary, the ids before it are final.
Costs are whole numbers, and of equally cheap segmentations the one whose last piece costs more a character is taken: in a run of one
sign or one pattern the cheapest piece then fills the run from its start, so the paths meet after a few pieces. Where they nevertheless
stay apart, a place waits as two numbers, and the search for the boundary is made when the waiting part has doubled, so time stays linear.

Ids are not those of the model's own merges (see ``Pieces``); decoding gives back exactly the text that was encoded.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.tables import texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
COST_UNIT = 1 << 20
BYTE_COST = 16 * COST_UNIT  # more than any piece costs: bytes are used where no piece fits
CACHED_WORDS = 1 << 18      # words of up to CACHED_CHARS whose ids a worker keeps
CACHED_CHARS = 32
PART_CHARS = 1 << 18        # characters of a text, or ids of one, that are handled at once
PART_ROWS = 256
PAIR_BITS = 20              # of the hash of two neighbouring characters


class _Words(dict):
    """Ids of words (what lies between two certain boundaries) as bytes, made when first asked for. When full it starts anew and asks the former one first."""

    def __init__(self, stream) -> None:
        super().__init__()
        self.stream, self.former = stream, {}

    def clear_all(self) -> None:
        self.clear()
        self.former = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.former.get(word)
        if ids is None:
            ids = array("i", self.stream(word)).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.former = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _pairs(text: str) -> np.ndarray:
    """The hash of every character and the one after it."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)


def _tails(cost: dict[str, tuple[int, int]]) -> dict:
    """The pieces read backwards as a tree: for a character, what is known of the piece that begins there, and what may stand before."""
    top: dict = {}
    for piece in sorted(cost, key=len):
        level = top
        for i in range(len(piece) - 1, -1, -1):
            level = level.setdefault(piece[i], (cost.get(piece[i:]), {}))[1]
    return top


class Pieces:
    """A vocabulary: pieces with ids and costs, and the ids of the 256 bytes.

    The public model orders its pieces by merge and holds no probabilities; a piece's cost is the logarithm of its place in that
    order, as word ranks behave, and the segmentation of least total cost is taken.
    """

    def __init__(self, table: list[tuple[str, int]], byte_ids: list[int]) -> None:
        self.cost = {piece: (round(math.log(2 + rank) * COST_UNIT), i) for rank, (piece, i) in enumerate(table)}
        self.longest = max((len(p) for p in self.cost), default=1)
        self.byte_ids = byte_ids
        spelled = {i: piece.replace(BLANK, " ").encode() for piece, i in table}
        spelled.update({i: bytes([b]) for b, i in enumerate(byte_ids)})
        listed = [spelled.get(i, b"") for i in range(max(spelled, default=-1) + 1)]
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.sizes = np.array([len(x) for x in listed], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = _Words(self.stream)

    @cached_property
    def apart(self) -> np.ndarray:
        """For every hash of two neighbours whether no piece holds them."""
        pairs = "".join({p[i : i + 2] for p in self.cost for i in range(len(p) - 1)})
        out = np.ones(1 << PAIR_BITS, bool)
        out[_pairs(pairs)[::2]] = False
        return out

    @cached_property
    def tails(self) -> dict:
        return _tails(self.cost)

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of the cheapest segmentation, each as soon as it is certain; of equally cheap ones that with the dearer last piece
        a character wins, then that with the shorter one.

        ``sizes`` and ``pieces`` hold, for every place that is not yet final, the best last piece that ends there; a character
        spelled in bytes is held as the complement of its code point.
        """
        top, longest = self.tails, self.longest
        nowhere = (None, None)
        recent, costs = [], [0]
        sizes, pieces, check = [], [], 2 * longest
        window = 4 * longest
        for char in chars:
            at = len(recent)
            recent.append(char)
            hit, level = top.get(char, nowhere)
            last, piece = hit or (BYTE_COST * len(char.encode()), ~ord(char))
            least, start, end = last + costs[at], at, at + 1
            while level and at:
                at -= 1
                hit, level = level.get(recent[at], nowhere)
                if hit:
                    own, of = hit
                    cost = own + costs[at]
                    if cost < least or cost == least and own * (end - start) > last * (end - at):
                        least, start, last, piece = cost, at, own, of
            costs.append(least)
            sizes.append(end - start)
            pieces.append(piece)
            if end >= window:
                recent, costs = recent[-longest:], costs[-longest - 1 :]
            if len(sizes) >= check:
                edge = self._meeting(sizes)
                yield from self._ids(sizes, pieces, edge)
                del sizes[:edge], pieces[:edge]
                check = 2 * max(longest, len(sizes))
        yield from self._ids(sizes, pieces, len(sizes))

    def _meeting(self, sizes: list[int]) -> int:
        """The last boundary that lies on the paths to all places a further piece may start from."""
        n = len(sizes)
        first = max(n - self.longest + 1, 0)
        alive, paths = bytearray(first) + b"\1" * (n + 1 - first), n + 1 - first
        while True:
            if alive[n]:
                if paths == 1:
                    return n
                back = n - sizes[n - 1]
                paths -= alive[back]
                alive[back] = 1
            n -= 1

    def _ids(self, sizes: list[int], pieces: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end:
            piece = pieces[end - 1]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in reversed(chr(~piece).encode())]
            end -= sizes[end - 1]
        return out[::-1]

    def _words_of(self, part: str) -> Iterator[list[str]]:
        """A text cut between neighbours that no piece holds, as every path has a boundary there; about PART_CHARS characters at a time."""
        first = 0
        for at in range(0, len(part), PART_CHARS):
            cuts = (np.flatnonzero(self.apart[_pairs(part[at : at + PART_CHARS + 1])]) + (at + 1)).tolist()
            if cuts:
                yield [part[i:j] for i, j in zip([first, *cuts], cuts)]
                first = cuts[-1]
        yield [part[first:]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Its blanks become the blank sign, with one put in front; a blank sign of its own is spelled in bytes."""
        if not text:
            return np.empty(0, np.int32)
        out: list[bytes] = []
        sign = array("i", [self.byte_ids[b] for b in BLANK.encode()]).tobytes()
        for i, part in enumerate(text.split(BLANK)):
            if i:
                out.append(sign)
            part = part.replace(" ", BLANK)
            if not i:
                part = BLANK + part
            out += (b"".join(map(self.words.__getitem__, words)) for words in self._words_of(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode_bytes(self, ids) -> bytes:
        ids, out = np.asarray(ids, np.int64), []
        for at in range(0, len(ids), PART_CHARS):
            part = ids[at : at + PART_CHARS]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[part] - ends + sizes, sizes)].tobytes())
        return b"".join(out)[1:]

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode()


def read_model(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file. Control and unknown pieces are not used."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table, byte_ids = [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            table.append((piece, i))
    return Pieces(table, byte_ids)


@lru_cache(4)
def _model(path: str) -> Pieces:
    return read_model(path)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and ids of every whole text. Null texts have null ids, empty ones none; other columns are ignored.

    The model file must stand under ``path`` on every worker. Rows are independent: repeated rows give repeated results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(i, PART_ROWS)
                given = part.column(1)
                ids = [model.encode(t.as_py() or "") for t in given]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=given.is_null())
                yield pa.RecordBatch.from_arrays([part.column(0), held], ["doc_id", "ids"])
        model.words.clear_all()  # the worker may wait long for its next task

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` (doc_id, ids) with their text: exactly the one that was encoded. Null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(i, PART_ROWS)
                out = [model.decode_bytes(x.values.to_numpy()) if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids and the decoded text's sha256 and length in code points; one row per input row.

    A null text has null ids, no ids counted, and null sha256 and length; an empty one has no ids, and length 0. Repeated rows and
    null doc_ids are kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    decoded = decode(encode(docs, path), path)
    return decoded.select(
        "doc_id", "ids", F.coalesce(F.size(F.coalesce("ids", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_ids"),
        F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
    )
