"""Near-duplicate groups by min-max hashing, with every link confirmed on whole shingle sets.

One hash evaluation per shingle and permutation gives two signature rows, its minimum and its maximum, so the
signature has twice as many rows as there are permutations. Bands of the signature are bucket keys.

* Equal shingle sets fall into one class first; only classes go on, so a hot group of copies is one class.
* In a bucket each class is compared with one representative, never with all others; a second round takes another one in every bucket.
* Members of buckets that are then still in several components meet in an exact set join (``similar_pairs``): by the rarest of
  their shingles, not by bucket, so texts that share a long passage but stay below the threshold make no pairs. No link is left out.
* Nothing is collected; each round's state is a written table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm import bytewise as B
from recordmill.llm.tables import join_counted, texts
from recordmill.session import stage

BANDS = 40
ROWS = 6
STAR_ROUNDS = 2
PART_PAIRS = 1000          # pairs of one end that a task gets at least, before the end is dealt to several
PARTS = 256                # about so many tasks share the pairs of an end that all pairs have in common

_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Distinct shingle hashes of each text, ordered within it, and each text's offsets."""
    data = B.LOWER[data]
    starts, ends, at = B.words(data, offsets)
    prefix = B.prefix_hash(data)
    h, at = B.shingles(B.range_hash(prefix, starts, ends), at, k, short=True)
    owner = B.owners(at)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h = h[new]
    return h, np.searchsorted(owner[new], np.arange(len(offsets)))


def min_max_rows(h: np.ndarray, at: np.ndarray, permutations: int) -> np.ndarray:
    """Signature of each non-empty text: for every permutation its least and its greatest value."""
    out = np.empty((len(at), 2 * permutations), np.uint64)
    for i in range(permutations):
        value = h * _MULTIPLIERS[i]
        out[:, 2 * i] = np.minimum.reduceat(value, at)
        out[:, 2 * i + 1] = np.maximum.reduceat(value, at)
    return out


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, size of the shingle set, two hashes of the set, and its band keys (none for an empty set)."""
    if rows % 2 or bands * rows > 2 * len(_MULTIPLIERS):
        raise ValueError("rows must be even, and bands * rows within the permutations there are")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in B.runs(batch.column(1)):
                h, at = _shingle_sets(data, offsets, k)
                n = np.diff(at)
                some = np.flatnonzero(n)
                one, two = B.sums(B.mix(h), at), B.sums(B.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    sig = min_max_rows(h, at[:-1][some], bands * rows // 2)
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(b * rows, (b + 1) * rows):
                            key = B.mix(key * np.uint64(31) + sig[:, r])
                        keys[:, b] = key
                listed = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, bands, 0), out=listed[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64)), pa.ListArray.from_arrays(pa.array(listed), pa.array(keys.reshape(-1).view(np.int64)))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its whole set of shingle hashes, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in B.runs(batch.column(1)):
                h, at = _shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))],
                    ["doc_id", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each end of ``edges`` (a, b): neighbours' minima, then a jump along the labels, until stable."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = stage(labels.withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = stage(step, "labels")
        jump = step.select(F.col("id").alias("at"), F.col("label").alias("beyond"))
        after = stage(
            step.join(jump, F.col("label") == F.col("at"), "left").select("id", F.least("label", F.coalesce("beyond", "label")).alias("label"), "was"),
            "labels",
        )
        labels = after.select("id", "label")
        if after.where("label <> was").isEmpty():
            return labels


def _with_set(rows: DataFrame, pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """``rows`` (``pairs`` and more) with the whole set of ``end``; the set of an end with very many pairs goes to several tasks.

    Such ends are at most twice PARTS, so the staged table of their ids is small at any size of input.
    """
    share = max(pairs.count() // PARTS, PART_PAIRS)
    parts = F.ceil(F.col("count") / share).cast("int").alias("parts")
    hot = stage(pairs.groupBy(end).count().where(F.col("count") > share).select(end, parts), "hot")
    dealt = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    ends = rows.join(hot, end, "left").select(*rows.columns, dealt)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    held = sets.withColumnRenamed("doc_id", end).join(hot, end, "left").select(end, F.col("shingles").alias(f"set_of_{end}"), copies)
    return ends.join(held, [end, "part"]).drop("part")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough; each set travels once for a pair."""
    shared = F.size(F.array_intersect("set_of_a", "set_of_b"))
    return (
        _with_set(_with_set(pairs, pairs, sets, "b", "a"), pairs, sets, "a", "b")
        .select("a", "b", shared.alias("shared"), F.size("set_of_a").alias("n_a"), F.size("set_of_b").alias("n_b"))
        .where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))
        .select("a", "b")
    )


def _near_size(percent: int):
    """Two sets can only be that similar when their sizes are."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def similar_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of ``rows`` (class, label, n) with different labels: every pair whose sets are similar enough, and few others.

    All shingles are put in one order, the rarest first; those that only one label holds come first of all, as no such pair shares them.
    If two sets of sizes n and m, whose first common shingle stands at places i and j, are similar enough, then 1 + min(n - i, m - j)
    is at least the overlap they need, and i and j lie in the first n - ceil(percent / 100 * n) + 1 shingles. Only these are joined, and
    only at such places. ``sets`` has doc_id and shingles.
    """
    held = rows.join(sets, rows["class"] == sets["doc_id"]).select("class", "label", "n", F.explode("shingles").alias("token"))
    shared = held.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = stage(shared.where("low <> high").select("token", "df"), "shared_tokens")
    met = join_counted(held, shared.withColumn("rows", F.col("df")), ["token"], "rows").select("class", "label", "n", "token", "df")
    # Places count from 1; the shingles of one label only stand before all of these.
    of = Window.partitionBy("class")
    place = F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("df", "token"))
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    heads = met.withColumn("place", place).where(F.col("place") <= first).select("class", "label", "n", "token", "place")
    heads = stage(heads, "heads")
    # A shingle at the head of very many sets is dealt to several tasks; such shingles are at most as many as PARTS.
    share = max(heads.count() // PARTS, PART_PAIRS)
    parts = F.ceil(F.col("count") / share).cast("int").alias("parts")
    hot = stage(heads.groupBy("token").count().where(F.col("count") > share).select("token", parts), "hot")
    dealt = heads.join(hot, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = dealt.select("token", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), "class", "label", "n", "place")
    copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    right = dealt.select("token", copies, *[F.col(c).alias(f"other_{c}") for c in ("class", "label", "n", "place")])
    rest = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    enough = (100 + percent) * rest >= percent * (F.col("n") + F.col("other_n"))
    near_size = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
    found = left.join(right, ["token", "part"]).where((F.col("class") < F.col("other_class")) & (F.col("label") != F.col("other_label")) & near_size & enough)
    return found.select(F.col("class").alias("a"), F.col("other_class").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Returns doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links) and kept (doc_id = component_id), one row per input row. A text with fewer than k
    words is one shingle. Null and empty texts have no shingles and stay alone. A repeated doc_id with the same text is one
    node; of several texts of one doc_id, one stands for it where links are confirmed, so number such rows first. A row with a null
    doc_id is no node: component_id null, kept. Other columns of ``docs`` are ignored. An empty table gives an empty result.

    Sets are compared as 64-bit hashes of whole shingles. A pair at the threshold shares no band with probability
    (1 - 0.8 ** rows) ** bands, about 5e-6 as set here; more similar pairs are missed far less.
    """
    signed = stage(signatures(docs, k, bands, rows), "signatures")
    classes = (
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("class"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    )
    classes = stage(classes, "classes")
    members = classes.select("class", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    members = stage(join_counted(members, stage(shared, "shared"), ["bucket"], "rows", "left_semi"), "members")

    ids = members.select(F.col("class").alias("doc_id")).distinct()
    sets = stage(shingle_sets(docs.select("doc_id", "text").dropDuplicates(["doc_id"]).join(ids, "doc_id", "left_semi"), k), "sets")
    labels = stage(ids.select(F.col("doc_id").alias("class"), F.col("doc_id").alias("label")), "labels")

    tested = links = None
    for turn in range(STAR_ROUNDS + 1):
        now = members.join(labels, "class")
        split = now.groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high"),
            F.min_by(F.struct("class", "n", "label"), F.col("class") if turn == 0 else F.xxhash64("class", "bucket", F.lit(turn))).alias("rep"),
            F.count("*").alias("rows"),
        ).where("low <> high").select("bucket", "rep", "rows")
        split = stage(split, "split")
        if split.isEmpty():  # no bucket is in several components
            break
        if turn < STAR_ROUNDS:
            pairs = join_counted(now, split, ["bucket"], "rows").where("label <> rep.label").select(
                F.col("class").alias("x"), F.col("rep.class").alias("y"), F.col("n").alias("n_a"), F.col("rep.n").alias("n_b"))
            pairs = pairs.where(_near_size(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:  # whatever is still apart within a bucket
            still = join_counted(now, split, ["bucket"], "rows", "left_semi").select("class", "label", "n").distinct()
            pairs = similar_pairs(stage(still, "apart"), sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = stage(_confirmed(pairs, sets, percent), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        joined = components(links)
        labels = stage(
            labels.select("class").join(joined, F.col("class") == F.col("id"), "left").select("class", F.coalesce("label", "class").alias("label")),
            "labels",
        )

    key = ["set_a", "set_b", "n_shingles"]
    named = classes.select(*key, "class", "copies").join(labels, "class", "left").select(*key, "copies", F.coalesce("label", "class").alias("label"))
    rows = signed.select("doc_id", *key)
    found = join_counted(rows.where("n_shingles > 0 and doc_id is not null"), stage(named, "named"), key, "copies").select("doc_id", "n_shingles", "label")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("label"))
    return found.union(alone).select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
