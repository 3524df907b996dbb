"""Benchmark decontamination by greedy string tiling of documents against benchmark items.

Seeds (runs of SEED words that a document and an item share) are joined to find the pairs worth tiling. A pair is then tiled:
the longest common run of unmarked words is looked for with rolling hashes and marked on both sides, again and again, until none
of SEED words is left. The marked share of the item tells whether the document holds it, also in another order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import bytewise as B
from recordmill.llm.tables import texts
from recordmill.session import stage

SEED = 5
PERCENT = 80               # of an item's words that a contaminated document covers
_FILTER_BITS = 23          # the seed filter takes 2 ** 23 bits, 1 MB, whatever the size of the benchmark


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    data = B.LOWER[data]
    starts, ends, _ = B.words(data, np.array([0, len(data)]))
    return B.range_hash(B.prefix_hash(data), starts, ends)


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all runs of ``size`` words."""
    power, back = B._powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    at = np.arange(len(words) - size + 1)
    return B.mix((sums[at + size] - sums[at]) * back[at])


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` words none of which is marked."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[size:] == sums[:-size])


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> np.ndarray:
    """Which of the item's words are covered by tiles of at least ``least`` words.

    Among equally long matches the item's runs are taken from left to right, each with the document's first free place.
    """
    mine, other = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    longest = min(len(item), len(doc))

    def common(size: int):
        a, b = _free(mine, size), _free(other, size)
        ha, hb = _windows(item, size)[a], _windows(doc, size)[b]
        return a, ha, b, hb, np.isin(ha, hb)

    while longest >= least:
        # A common run of some length holds shorter ones, so the longest is found by halving.
        low, high = least - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if common(middle)[4].any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        longest = low
        a, ha, b, hb, shared = common(longest)
        places: dict[int, list[int]] = {}
        for place, h in zip(b[np.isin(hb, ha)][::-1].tolist(), hb[np.isin(hb, ha)][::-1].tolist(), strict=True):
            places.setdefault(h, []).append(place)
        for at, h in zip(a[shared].tolist(), ha[shared].tolist(), strict=True):
            if mine[at] or mine[at + longest - 1]:
                continue
            free = places[h]
            while free and (other[free[-1]] or other[free[-1] + longest - 1]):
                free.pop()
            if free:
                place = free.pop()
                mine[at : at + longest] = True
                other[place : place + longest] = True
        longest -= 1  # what is left of this length overlaps a mark now
    return mine


def _seed_rows(rows: DataFrame, name: str, keep: np.ndarray | None = None) -> DataFrame:
    """(name, seed, n): the distinct seeds of each text and how often each stands in it; with a filter, those that may be in it."""
    shared = None if keep is None else rows.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in B.runs(batch.column(1)):
                data = B.LOWER[data]
                starts, ends, at = B.words(data, offsets)
                h, at = B.shingles(B.range_hash(B.prefix_hash(data), starts, ends), at, SEED)
                owner = B.owners(at)
                if shared is not None:
                    bit = h >> np.uint64(64 - _FILTER_BITS)
                    may = (shared.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    h, owner = h[may], owner[may]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).take(pa.array(owner[begin])),
                     pa.array(np.ascontiguousarray(h[begin]).view(np.int64)), pa.array(np.diff(np.append(begin, len(h))).astype(np.int64))],
                    [name, "seed", "n"],
                )

    return rows.mapInArrow(run, f"{name} long, seed long, n long")


def _filter(seeds: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every seed; grouped by byte, so at most 2 ** 20 small rows come back."""
    bit = F.shiftrightunsigned("seed", 64 - _FILTER_BITS)
    rows = seeds.select(bit.alias("bit")).select(F.shiftright("bit", 3).alias("place"), F.expr("shiftleft(1, cast(bit & 7 as int))").alias("b"))
    out = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for r in rows.groupBy("place").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.place] = r.b
    return out


def contaminated_pairs(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_words of the item and n_covered, for every pair with 100 * n_covered >= percent * n_words.

    ``items`` has item_id and text. Words are runs of characters other than ASCII white space, A-Z lower-cased. Items with fewer
    than SEED words hold no seed and match nothing; so do null and empty texts on either side. Repeated rows of a document or an
    item give one row for the pair, the greatest cover where their texts differ. Other columns are ignored.

    A pair is tiled only if enough of the item's seeds occur in the document: t words covered by tiles of SEED or more hold at
    least t / SEED seeds. No other pair is left out.
    """
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    seeds = stage(_seed_rows(items, "item_id"), "seeds")
    hits = stage(_seed_rows(texts(docs).where("doc_id is not null"), "doc_id", _filter(seeds)).select("doc_id", "seed").distinct(), "hits")
    shared = hits.join(seeds, "seed").groupBy("doc_id", "item_id").agg(F.sum("n").alias("found"))
    # Rows of one item_id with different texts: the shortest sets the bound.
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    sizes = items.select("item_id", words.alias("words")).where(F.col("words") >= SEED).groupBy("item_id").agg(F.min("words").alias("words"))
    pairs = shared.join(sizes, "item_id").where(100 * SEED * F.col("found") >= percent * F.col("words")).select("doc_id", "item_id")
    pairs = stage(pairs, "pairs")
    # Only texts of found documents travel: their few ids are staged, so Spark knows their size.
    found = docs.select("doc_id", "text").where("text is not null").join(stage(pairs.select("doc_id").distinct(), "found"), "doc_id", "left_semi")
    rows = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(found, "doc_id").select("doc_id", "item_id", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for item, text in zip(batch.column(2), batch.column(3), strict=True):
                words = word_hashes(item.as_py())
                made.append((len(words), int(tile(words, word_hashes(text.as_py())).sum())))
            n, covered = (list(c) for c in zip(*made, strict=True)) if made else ([], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(covered, pa.int64())],
                ["doc_id", "item_id", "n_words", "n_covered"],
            )

    tiled = rows.mapInArrow(run, "doc_id long, item_id long, n_words long, n_covered long")
    best = tiled.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_words", "n_covered"), F.col("n_covered") / F.col("n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.*").where(100 * F.col("n_covered") >= percent * F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null doc_id stay."""
    return docs.join(contaminated_pairs(docs, items, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
