"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

A text is a vector of weighted byte trigrams (case and signs included) and its length class. The space is spanned by the leading
singular vectors of the labelled texts. Every document is compared with all labelled vectors, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import bytewise as B
from recordmill.llm.tables import bucket, texts

TERMS = 2048               # hashed trigrams
LENGTHS = 24               # length classes, by doubling
RANK = 64
MAX_LABELLED = 6000        # labelled texts the votes come from: those of the least id hashes
NEIGHBOURS = 25
SHARPNESS = 8              # power of the similarity that weights a vote
HELD_OUT = 1
_WIDTH = TERMS + LENGTHS
_BLOCK = 256               # texts compared at once


def _term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, counts of terms, lengths in bytes) of blocks of whole texts."""
    for start in range(0, len(column), _BLOCK):
        part = column.slice(start, _BLOCK)
        for first, last, data, offsets in B.runs(part):
            d = data.astype(np.uint64)
            h = B.mix((d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]) if len(d) > 2 else np.zeros(0, np.uint64)
            owner = np.searchsorted(offsets, np.arange(len(h)), "right") - 1
            inside = np.arange(len(h)) + 3 <= offsets[owner + 1]
            at = owner[inside] * TERMS + (h[inside] % np.uint64(TERMS)).astype(np.int64)
            counts = np.bincount(at, minlength=(last - first) * TERMS).reshape(last - first, TERMS)
            yield start + first, start + last, counts, np.diff(offsets)


def _vectors(counts: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit vectors of logarithmic, weighted shares, with the length class beside them."""
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    terms = np.log1p(share * TERMS) * weight
    terms /= np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-9)
    out = np.zeros((len(counts), _WIDTH), np.float32)
    out[:, :TERMS] = terms
    level = np.minimum(np.ceil(np.log2(lengths + 1)), LENGTHS - 1).astype(np.int64)
    out[np.arange(len(counts)), TERMS + level] = np.where(lengths > 2, 0.2, 1.0)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def term_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every term over all texts: TERMS numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, _, counts, _ in _term_counts(batch.column(1)):
                held += (counts > 0).sum(0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.append(n, held))], ["term", "n"])

    rows = texts(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    n = found.get(-1, 0)
    return np.array([math.log((n + 1) / (found.get(i, 0) + 1)) + 0.1 for i in range(TERMS)])


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term weights, the projection, the labelled vectors in it and their labels.

    ``labels`` has doc_id and quality. At most ``limit`` labelled texts are used, those whose ids have the least hashes; each comes
    to the driver as one vector of fixed width, never as text. Of a doc_id with several labels the mean is used, of
    one with several texts the vector of each.
    """
    weight = term_weights(docs)
    chosen = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, counts, lengths in _term_counts(batch.column(1)):
                made = _vectors(counts, lengths, weight).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([v.tobytes() for v in made], pa.binary()), batch.column(2).slice(first, last - first)],
                    ["doc_id", "vector", "label"],
                )

    got = rows.mapInArrow(run, "doc_id long, vector binary, label double").orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(limit).collect()
    if not got:
        return weight, np.zeros((_WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32)
    made = np.stack([np.frombuffer(r.vector, np.float16) for r in got]).astype(np.float32)
    values, axes = np.linalg.eigh(made.T @ made)
    project = axes[:, np.argsort(values)[::-1][:RANK]].astype(np.float32)
    return weight, project, _unit(made @ project), np.array([r.label for r in got], np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _vote(vectors: np.ndarray, known: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Mean label of the nearest neighbours, weighted by similarity; 0.5 where nothing is similar."""
    if not len(known):
        return np.full(len(vectors), 0.5)
    cosine = vectors @ known.T
    k = min(NEIGHBOURS, len(known))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
    total = w.sum(1)
    return np.where(total > 0, (w * label[near]).sum(1) / np.maximum(total, 1e-300), 0.5)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every whole text; null texts count as empty, and an empty text is compared by its length class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 * RANK * (MAX_LABELLED + terms) bytes, some 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, project, known, label = shared.value
        for batch in batches:
            for first, last, counts, lengths in _term_counts(batch.column(1)):
                votes = _vote(_unit(_vectors(counts, lengths, weight) @ project), known, label)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.clip(votes, 0, 1))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of all texts, voted by labelled documents that are not held out: doc_id, held_out, score, predicted.

    A document is held out where crc32 of its id, modulo 3, is 1 (null ids are not). Without labels every score is 0.5. Repeated
    rows are scored alike, other columns are ignored, and an empty table gives an empty result.
    """
    held = F.coalesce(bucket("doc_id", 3) == HELD_OUT, F.lit(False))
    model = learn(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
