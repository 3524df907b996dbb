"""Exact removal of repeated byte strings by refining buckets of positions.

A string of LENGTH bytes is repeated where an equal one starts elsewhere. Ordering all suffixes would shuffle every byte
position several times. Here buckets hold ranges of neighbouring positions, and a bucket is refined only while its members may
still differ:

1. Every position is put to a q-gram that its string itself chooses (the least hash in it), so equal strings choose equal
   q-grams at equal offsets. Neighbouring positions with one q-gram are a range; the q-gram is its bucket.
2. Ranges of a bucket whose whole contents are equal are repeated and need no more work; a range alone in its bucket is unique.
3. What is left is cut into blocks of BLOCK positions, with the identifier of the later bytes that all strings of a block share
   as the bucket, and refined the same way; what then is left is refined position by position.

Buckets meet as counts that are added up before the shuffle, never as lists, and ranges of very frequent contents are told by a
broadcast of the few keys that can be so frequent, so a bucket's size does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import bytewise as B
from recordmill.llm.tables import join_counted, texts
from recordmill.session import delete, passing, scratch_path, stage

LENGTH = 400
GRAM = 32
BLOCK = 16
_PLACE_BITS = 28           # positions within a run: a single text must be shorter than 256 MB
_RANGE = "doc long, anchor int, first int, last int"


def _choices(prefix: np.ndarray, n: int, length: int, gram: int) -> np.ndarray:
    """For every start of ``length`` bytes, the place of the q-gram in it with the least hash, the last one of equals."""
    starts = np.arange(n - gram + 1)
    h = B.range_hash(prefix, starts, starts + gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h & ~low) | (low - starts.astype(np.uint64))
    width = length - gram + 1
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n - length + 1)
    return (low - (np.minimum(behind[at], ahead[at + width - 1]) & low)).astype(np.int64)


def _ranges(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Ranges of starts that chose one q-gram: owner, q-gram's place, first and last start; places count from the run's begin."""
    prefix = B.prefix_hash(data)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return prefix, none, none, none, none
    chosen = _choices(prefix, len(data), length, gram)
    owner = np.searchsorted(offsets, np.arange(len(chosen)), "right") - 1
    inside = np.flatnonzero(np.arange(len(chosen)) + length <= offsets[owner + 1])
    chosen, owner = chosen[inside], owner[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(inside)) - 1
    return prefix, owner[begin], chosen[begin], inside[begin], inside[end]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def _key(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = B.mix(h * np.uint64(31) + p.astype(np.uint64))
    return h


def _first_ranges(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.asarray(batch.column(0))
            for start, stop, data, offsets in B.runs(batch.column(1)):
                prefix, owner, at, first, last = _ranges(data, offsets, length, gram)
                base = offsets[owner]
                whole = _key(at - first, last - at, B.range_hash(prefix, first, last + length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[start:stop][owner])]
                    + [pa.array((v - base).astype(np.int32)) for v in (at, first, last)]
                    + [_signed(B.range_hash(prefix, at, at + gram)), _signed(whole)],
                    ["doc", "anchor", "first", "last", "bucket", "whole"],
                )

    return keyed.select("doc", "text").mapInArrow(run, f"{_RANGE}, bucket long, whole long")


def _finer_ranges(keyed: DataFrame, open_ranges: DataFrame, length: int, size: int) -> DataFrame:
    """Open ranges cut into blocks of ``size`` starts, aligned to the q-gram, and their new buckets."""
    listed = open_ranges.groupBy("doc").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("ranges"))
    # Rows of one id and text share their ranges, so both copies are counted again.
    rows = keyed.select("doc", "text").join(listed, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
                prefix = B.prefix_hash(data)
                items = batch.column(2).slice(i, 1).flatten()
                anchor, first, last = (np.asarray(items.field(k)).astype(np.int64) for k in range(3))
                # Starts stand before the q-gram or at it: block k holds distances k * size to (k + 1) * size - 1.
                low, high = (anchor - last) // size, (anchor - first) // size
                n = high - low + 1
                which = np.repeat(np.arange(len(anchor)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
                a = anchor[which]
                one = np.maximum(a - (k + 1) * size + 1, first[which])
                two = np.minimum(a - k * size, last[which])
                shared = B.range_hash(prefix, a - k * size, a - (k + 1) * size + 1 + length)
                whole = _key(a - one, two - one, B.range_hash(prefix, one, two + length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), batch.column(0)[i].as_py(), np.int64))]
                    + [pa.array(v.astype(np.int32)) for v in (a, one, two)] + [_signed(_key(k, shared)), _signed(whole)],
                    ["doc", "anchor", "first", "last", "bucket", "whole"],
                )

    return rows.mapInArrow(run, f"{_RANGE}, bucket long, whole long")


def _judge(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges with equal contents elsewhere, and those whose bucket holds other contents only."""
    # Of equal ranges one is enough for the others of the bucket to be compared with.
    place = ("doc", "anchor", "first", "last")
    contents = stage(ranges.groupBy("bucket", "whole").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in place]), "contents")
    again = contents.where("n > 1").select("bucket", "whole", "n")
    repeated = join_counted(ranges, again, ["bucket", "whole"], "n", "left_semi").select(*place)
    mixed = stage(contents.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    return repeated, join_counted(contents, mixed, ["bucket"], "kinds", "left_semi").select(*place)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc (hash of id and text), first and last: ranges of places at which a string of ``length`` bytes starts that starts elsewhere too."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    out, rest, held = [], None, None
    for size in (0, block, 1):
        repeated, left = scratch_path(spark, "repeated"), scratch_path(spark, "open")
        with passing(spark):  # a round's ranges and buckets are deleted once its result is written
            ranges = stage(_finer_ranges(keyed, rest, length, size) if size else _first_ranges(keyed, length, gram), "ranges")
            found, still = _judge(ranges)
            found.select("doc", "first", "last").write.parquet(repeated)
            if size != 1:
                still.write.parquet(left)
        if held:
            delete(spark, held)
        out.append(spark.read.schema("doc long, first int, last int").parquet(repeated))
        rest, held = (spark.read.schema(_RANGE).parquet(left), left) if size != 1 else (None, None)
    return out[0].union(out[1]).union(out[2])


def _keyed(docs: DataFrame) -> DataFrame:
    rows = texts(docs)
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("doc"))


def _merged(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Take every byte covered by a repeated string of ``length`` bytes out of each text.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes left). Null texts are
    empty: counts 0, the hash of nothing. Texts shorter than ``length`` stay whole. A repeated row is a copy like any other:
    both lose what they share, here all. Other columns are ignored; an empty table gives an empty result.
    """
    spans = repeated_ranges(docs, length).groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    rows = _keyed(docs).join(spans, "doc", "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                gone = _merged(ranges.as_py(), length)
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                made.append((len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
            columns = list(zip(*made, strict=True)) if made else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
