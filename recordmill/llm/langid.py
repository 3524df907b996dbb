"""Language identification by n-gram filters: one bit-sliced Bloom filter whose slots hold a bit for every language.

A lookup of an n-gram combines its slots and gives all languages that contain it at once. A text's hits are counted per
language, the hits expected from false positives are taken off, and the greatest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm import bytewise as B
from recordmill.llm.tables import bucket, texts

SLOT_BITS = 20             # the filter has 2 ** SLOT_BITS words of 8 bytes for every 63 languages: its whole size
HASHES = 3
MIN_SHARE = 0.02           # of a language's documents that must hold an n-gram
NEAR_BEST = 0.5            # of the n-gram's share in the language where it is most common
NOT_LEARNED = 2            # the remainder of documents held out
UNKNOWN = "und"
_SLICE = 63
_RUN_CHARS = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _runs(values: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about ``_RUN_CHARS`` in all; a longer one alone."""
    first = size = 0
    for i, v in enumerate(values):
        if i > first and size + len(v or "") > _RUN_CHARS:
            yield first, i
            first, size = i, 0
        size += len(v or "")
    if values:
        yield first, len(values)


def trigrams(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased letter with its two neighbours (a blank for anything but a letter), and the text it stands in."""
    lowered = [(v or "").lower() for v in values]
    code = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    h = B.mix((code[at - 1] << np.uint64(42)) | (code[at] << np.uint64(21)) | code[at + 1])
    ends = np.cumsum([len(v) + 1 for v in lowered])
    return h, np.searchsorted(ends, at, "right")


def _gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and the number of documents holding it, added up over each run of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, langs = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), object)
            for first, last in _runs(values):
                names, lang = np.unique(langs[first:last].astype(str), return_inverse=True)
                h, owner = trigrams(values[first:last])
                kinds, h = np.unique(h, return_inverse=True)
                held = np.unique(owner * len(kinds) + h)
                pair, n = np.unique(lang[held // max(len(kinds), 1)] * len(kinds) + held % max(len(kinds), 1), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[pair // max(len(kinds), 1)].tolist(), pa.string()),
                     pa.array(kinds[pair % max(len(kinds), 1)].view(np.int64)) if len(pair) else pa.array([], pa.int64()),
                     pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    return texts(docs, "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The words of the filter that an n-gram's hash selects."""
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(SLOT_BITS * i)) & mask).astype(np.int64) for i in range(HASHES)]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` in order, and the filter: an array of (slices of 63 languages, slots).

    Only rows with a language are learned from. What reaches the driver are the languages' names and the filter's own words,
    of which there are 2 ** SLOT_BITS for every 63 languages, whatever the size of the corpus.
    """
    known = docs.where("lang is not null")
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(totals)
    table = np.zeros((-(-len(names) // _SLICE), 1 << SLOT_BITS), np.int64)
    if not names:
        return names, table
    order = known.sparkSession.createDataFrame([(n, i, totals[n]) for i, n in enumerate(names)], "lang string, i int, total long")
    shares = _gram_counts(known).join(order, "lang").withColumn("share", F.col("n") / F.col("total"))
    shares = shares.where(F.col("share") >= MIN_SHARE)
    best = F.max("share").over(Window.partitionBy("gram"))  # a gram has one row per language
    grams = shares.withColumn("best", best).where(F.col("share") >= NEAR_BEST * F.col("best"))
    mask = (1 << SLOT_BITS) - 1
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * i).bitwiseAND(F.lit(mask).cast("long")) for i in range(HASHES)]))
    bits = (
        grams.select(F.floor(F.col("i") / _SLICE).cast("int").alias("part"), F.expr(f"shiftleft(1L, i % {_SLICE})").alias("bit"), slot.alias("slot"))
        .groupBy("part", "slot").agg(F.bit_or("bit").alias("word"))
    )
    for r in bits.toLocalIterator():
        table[r.part, r.slot] = r.word
    return names, table


def _decide(values: list[str | None], names: list[str], table: np.ndarray, false: np.ndarray) -> tuple[list[str], np.ndarray]:
    h, owner = trigrams(values)
    n = np.bincount(owner, minlength=len(values))
    hits = np.zeros((len(names), len(values)))
    slots = _slots(h)
    for part in range(len(table)):
        word = table[part][slots[0]]
        for s in slots[1:]:
            word = word & table[part][s]
        for i in range(part * _SLICE, min((part + 1) * _SLICE, len(names))):
            hits[i] = np.bincount(owner, weights=(word >> np.int64(i % _SLICE)) & 1, minlength=len(values))
    if not len(names):
        return [UNKNOWN] * len(values), np.zeros(len(values))
    clean = np.maximum(hits - n * false[:, None], 0) / (1 - false[:, None])
    best = clean.argmax(0)
    score = np.clip(clean.max(0) / np.maximum(n, 1), 0, 1)
    return [names[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (share of the text's n-grams that the language's filter holds) of every whole text.

    Null texts and texts without letters are ``und`` with score 0, as are all where no language was learned. Where languages
    tie, the first by name is taken. Repeated rows are judged alike; other columns are ignored.
    """
    fill = np.array([((table[i // _SLICE] >> np.int64(i % _SLICE)) & 1).mean() for i in range(len(names))])
    # fixed size: 8 MB for every 63 languages
    shared = docs.sparkSession.sparkContext.broadcast((names, table, np.minimum(fill**HASHES, 0.999)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for first, last in _runs(values):
                pred, score = _decide(values[first:last], *shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Languages of all texts, learned from the documents that are not held out: doc_id, held_out, lang_pred, score.

    A document is held out where crc32 of its id, modulo 4, is 2 (null ids are not). An empty table gives an empty result.
    """
    held = F.coalesce(bucket("doc_id", 4) == NOT_LEARNED, F.lit(False))
    names, table = learn(docs.where(~held))
    return identify(docs, names, table).select("doc_id", held.alias("held_out"), "lang_pred", "score")
