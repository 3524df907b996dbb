"""How the tokens of two vocabularies cover the same text, counted over the corpus by exact-text deduplication.

Documents are shuffled by their full text, so each distinct text is encoded and aligned once and its pairs count as often as
it occurs. Aligned texts travel in blocks: a block lists its distinct pairs once, and only those are counted over the corpus
and joined with the counts again, so a pair that stands in every text is a row per block, not per text. The measures of a
text go back to its documents by the hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.llm.bytepairs import VOCABULARY, codec
from recordmill.llm.tables import join_counted, texts
from recordmill.session import stage

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 1 << 22            # bytes of text in a block; a longer text is one of its own
SEGMENT = 1 << 20          # code points that are encoded at once
BLANK = "▁"
# The last space after something else than white space: both vocabularies have a boundary there.
_SURE = regex.compile(r"(?r)(?<=\S) ")


class Aligner:
    """Two vocabularies: byte-level pairs (A) over a space and the text, and pieces (B) that put the space themselves."""

    def __init__(self, path: str, pieces: str) -> None:
        self.codec = codec(path, False)
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode())
        # No piece goes on after a blank that follows something else; else texts are never cut.
        names = (self.model.id_to_piece(i) for i in range(len(self.pieces)))
        self.cuts = not any(BLANK in name.lstrip(BLANK) for name in names)
        self.size_b = np.array([len(p) for p in self.pieces], np.int64)
        self.n_a, self.n_b = len(self.codec.size), len(self.pieces)
        # Each id as it is written, before another of its group and before the next list.
        written = [f"{i}{end}" for end in ",|" for i in range(self.n_a)] + [f"{i}{end}" for end in ",;" for i in range(self.n_b)]
        self.written = written

    def segments(self, text: str) -> Iterator[tuple[list[int], list[int], bytes]]:
        """Ids by A and by B of consecutive stretches of a space and the text, with their bytes."""
        whole = " " + text
        start = 0
        while start < len(whole):
            end = len(whole)
            if end - start > SEGMENT and self.cuts:
                cut = _SURE.search(whole, start + 1, start + SEGMENT)
                if cut and cut.start() < end - 1:
                    end = cut.start()
            part = whole[start:end]
            a = self.codec.tree(part, 0, len(part)).tolist() if len(part) > SEGMENT else self.codec.leaf(part)
            yield a, self.model.encode(part[1:]), part.encode()
            start = end

    def align(self, text: str):
        """n_a, n_b, n_groups, n_links, hash of the groups, pairs, links of each pair; nothing of all that if a vocabulary changes the bytes.

        A pair is id of A * size of B + id of B; pairs ascend.
        """
        digest = hashlib.sha256()
        counts = np.zeros(4, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for ids_a, ids_b, data in self.segments(text):
            if b"".join(map(self.codec.bytes.__getitem__, ids_a)) != data or b"".join(map(self.pieces.__getitem__, ids_b)) != data:
                return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
            a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            end_a, end_b = np.cumsum(self.codec.size[a]), np.cumsum(self.size_b[b])
            at_a, at_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
            both_a, both_b = end_b[np.minimum(at_a, len(b) - 1)] == end_a, end_a[np.minimum(at_b, len(a) - 1)] == end_b
            group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
            per_a, per_b = np.bincount(group_a), np.bincount(group_b)

            # Each group's A ids, then its B ids; the last of either is followed by another sign.
            codes = np.concatenate([a + self.n_a * both_a, 2 * self.n_a + b + self.n_b * both_b])
            place = np.concatenate([np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a], np.arange(len(b)) + np.cumsum(per_a)[group_b]])
            order = np.empty(len(codes), np.int64)
            order[place] = codes
            line = "".join(map(self.written.__getitem__, order.tolist()))
            digest.update(((";" if counts[2] else "") + line[:-1]).encode())

            times = per_b[group_a]
            first_b = (np.cumsum(per_b) - per_b)[group_a]
            links = int(times.sum())
            which = np.arange(links) + np.repeat(first_b - (np.cumsum(times) - times), times)
            pairs, n = np.unique(np.repeat(a, times) * self.n_b + b[which], return_counts=True)
            counts += (len(a), len(b), len(per_a), links)
            found.append((pairs, n))
        pairs, n = found[0]
        if len(found) > 1:
            pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([k for _, k in found])).astype(np.int64)
        return (*counts.tolist(), digest.hexdigest(), pairs, n)


@lru_cache(2)
def _aligner(path: str, pieces: str) -> Aligner:
    return Aligner(path, pieces)


_TEXTS = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCK = pa.schema([
    ("block", pa.binary()),
    ("texts", pa.list_(pa.struct([("key", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                                  ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int32())]))),
    ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("documents", pa.int64())]))),
    ("which", pa.list_(pa.int32())), ("links", pa.list_(pa.int64())),
])
_BLOCK_SQL = (
    "block binary, texts array<struct<key:binary,copies:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,n_pairs:int>>, "
    "pairs array<struct<a:int,b:int,documents:bigint>>, which array<int>, links array<bigint>"
)


def align_blocks(distinct: DataFrame, path: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """Blocks of aligned texts from distinct texts (text, copies).

    A block has its texts' own measures, its distinct pairs with the number of documents that hold each, and, text after text,
    the pairs (as places in that list) and their links. Texts that either vocabulary changes have zeros and no pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path, pieces)
        rows: list[dict] = []
        pairs: list[np.ndarray] = []
        links: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            sizes = [len(p) for p in pairs]
            known, which = np.unique(np.concatenate(pairs), return_inverse=True)
            documents = np.zeros(len(known), np.int64)
            np.add.at(documents, which, np.repeat(np.array([r["copies"] for r in rows], np.int64), sizes))
            listed = pa.StructArray.from_arrays(
                [pa.array((known // aligner.n_b).astype(np.int32)), pa.array((known % aligner.n_b).astype(np.int32)), pa.array(documents)],
                fields=list(_BLOCK.field("pairs").type.value_type))
            one = pa.array([0, len(known)], pa.int32()), pa.array([0, len(which)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([rows[0]["key"]], pa.binary()), pa.array([rows], _BLOCK.field("texts").type),
                pa.ListArray.from_arrays(one[0], listed), pa.ListArray.from_arrays(one[1], pa.array(which.astype(np.int32))),
                pa.ListArray.from_arrays(one[1], pa.array(np.concatenate(links).astype(np.int64)))], schema=_BLOCK)

        for batch in batches:
            for text, copies in zip(*batch.columns, strict=True):
                text = text.as_py()
                got = aligner.align(text)
                data = text.encode()
                rows.append({
                    "key": hashlib.sha256(data).digest(), "copies": copies.as_py(), "n_a": got[0], "n_b": got[1], "n_groups": got[2],
                    "n_links": got[3], "groups_sha256": got[4], "n_pairs": len(got[5])})
                pairs.append(got[5])
                links.append(got[6])
                size += len(data)
                if size >= BLOCK:
                    yield block()
                    rows, pairs, links, size = [], [], [], 0
        if rows:
            yield block()

    return distinct.select("text", "copies").mapInArrow(run, _BLOCK_SQL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, documents (how many hold the pair linked) and best (no pair of that a is held by more). An a has no more pairs than B has ids."""
    one = blocks.select(F.explode("pairs").alias("p")).select("p.a", "p.b", "p.documents")
    counts = one.groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(W.partitionBy("a")))


def _measured(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The measures of each text: its own, and n_best and count_sum from the corpus-wide counts of the block's pairs."""
    listed = blocks.select("block", F.posexplode("pairs").alias("place", "p")).select("block", "place", "p.a", "p.b")
    told = listed.join(counts, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("place", "documents", "best")).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, which, links, told in zip(*batch.columns, strict=True):
                known = told.values if told.is_valid else pa.array([], told.type.value_type)  # a block may hold no pair
                place, documents, best = (known.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                count, is_best = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
                count[place], is_best[place] = documents, best
                which, links = which.values.to_numpy(zero_copy_only=False), links.values.to_numpy(zero_copy_only=False)
                rows = rows.values
                ends = np.cumsum(rows.field("n_pairs").to_numpy())
                sums = []
                for value in (is_best, count):
                    total = np.zeros(len(which) + 1, np.int64)
                    np.cumsum(value[which] * links, out=total[1:])
                    sums.append(pa.array(np.diff(total[np.concatenate([[0], ends])])))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.field(i) for i in range(7)), *sums],
                    ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return blocks.select("block", "texts", "which", "links").join(told, "block", "left").select("texts", "which", "links", "told").mapInArrow(
        run, f"{_TEXTS}, n_best long, count_sum long")


def align_documents(docs: DataFrame, path: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """How two vocabularies cover each whole text of ``docs`` (doc_id, text): a row per row, other columns are ignored.

    n_a and n_b tokens are cut into n_groups where both end at one byte; n_links pairs of token occurrences share a group;
    n_best of them are pairs that no other pair of their A id is in more documents than; count_sum adds up those numbers of
    documents; groups_sha256 hashes the groups as ``a1,a2|b1;a3|b2,b3``. Each row counts as a document, repeated ids and texts
    too. Texts that are null, empty or not kept to the byte by both vocabularies have zeros and '' and count nowhere. An empty
    table gives an empty result. Both files must stand under their paths on every worker.
    """
    some = texts(docs).where("text <> ''")
    distinct = some.groupBy("text").agg(F.count("*").alias("copies"))
    blocks = stage(align_blocks(distinct, path, pieces), "aligned")
    counts = stage(pair_counts(blocks), "pairs")
    measured = stage(_measured(blocks, counts), "measured")

    key = F.unhex(F.sha2("text", 256)).alias("key")
    named = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    rows = docs.select("doc_id", F.when(F.col("text") != "", key).alias("key"))
    joined = join_counted(rows.where("key IS NOT NULL"), measured, ["key"], "copies")
    empty = rows.where("key IS NULL")
    return joined.unionByName(empty, allowMissingColumns=True).select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in named], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
