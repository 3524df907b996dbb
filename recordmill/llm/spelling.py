"""Spelling variants: words one edit apart, found by states that walk a distributed trie level by level.

The trie holds every word twice, forwards and backwards, and its edges carry whole stretches between branchings. A state is
(word, place in it, node, edits). At each level the states meet the edges of their nodes in a join. The one edit is allowed in
the second half of a word only: an edit of the first half is one of the second half backwards. So a state follows its own word
by one edge at a time to the middle and then branches where few words are left.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.tables import join_counted, texts
from recordmill.operators.reshape import number_rows
from recordmill.session import stage

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
TYPO_EVERY = 199
HELD = 1 << 17             # distinct words a task adds up before it passes them on
BROADCAST_EDGES = 1 << 16  # a level of so many edges is left to Spark's own choice
ROWS = 256
_KEPT = {**{c: c + 32 for c in range(65, 91)}, **{c: c for c in range(97, 123)}, **{c: c for c in range(0xC0, 0x100)}}
_LETTERS = bytes(_KEPT.get(c, 32) for c in range(256))  # of Latin-1: letters of words, A-Z lower-cased, all else blanks
_FORWARDS, _BACKWARDS = ">", "<"


def word_counts(docs: DataFrame, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """word and n, its occurrences in all whole texts, summed within each task first.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With ``typo_every`` a document whose id and word have a
    crc32 that it divides loses one letter of that word, wherever the document has it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array([word.decode("latin-1") for word in total], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    # A letter of a word is one byte of Latin-1, and no other character becomes one.
                    words = (text or "").encode("latin-1", "replace").translate(_LETTERS).split()
                    total.update(words)
                    if typo_every:
                        typos = dict(_typos(words, "" if doc is None else str(doc), typo_every))
                        for word, n in Counter(filter(typos.__contains__, words)).items():
                            total[word] -= n
                            if not total[word]:
                                del total[word]
                            total[typos[word]] += n
                    if len(total) > HELD:
                        yield counted()
        yield counted()

    found = texts(docs).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _typos(words: list[bytes], doc: str, every: int) -> Iterator[tuple[bytes, bytes]]:
    """The distinct words (Latin-1) that lose a letter in this document, and what is left of them."""
    ahead = zlib.crc32(f"{doc}:".encode())
    for word in set(words):
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), ahead)
        if h % every == 0:
            cut = h % len(word)
            yield word, word[:cut] + word[cut + 1 :]


# --- the trie -------------------------------------------------------------------------------


def _with_common(strings: DataFrame) -> DataFrame:
    """Each string (column ``s``) with its place in code-point order and ``common``, how many characters it shares with the one before it."""
    placed = stage(number_rows(strings, [F.col("s")], name="no"), "sorted")
    before = placed.select((F.col("no") + 1).alias("no"), F.col("s").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(commonprefix((a, b))) if b is not None else 0 for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int32())], ["no", "s", "common"])

    return placed.join(before, "no", "left").select("no", "s", "before").mapInArrow(run, "no long, s string, common int")


def trie(strings: DataFrame) -> DataFrame:
    """The edges of the trie of distinct ``strings`` (column ``s``): parent and child (numbers; the root, '', is 0), head, label, the
    child's string ``s`` if it is one of the strings, and ``heads``, the characters that go on from it.

    In order, strings branch where neighbours stop sharing characters; with those places among them, the parent of a string is
    what it shares with the one before it.
    """
    places = stage(_with_common(strings), "common").select(F.expr("substr(s, 1, common)").alias("s")).where("s <> ''")
    nodes = strings.select("s", F.lit(True).alias("ends")).unionByName(places.select("s", F.lit(False).alias("ends")))
    nodes = stage(nodes.groupBy("s").agg(F.max("ends").alias("ends")), "nodes")
    placed = stage(_with_common(nodes.select("s")), "placed").join(nodes, "s")
    placed = stage(placed.withColumn("above", F.expr("substr(s, 1, common)")), "placed")
    parents = placed.select(F.col("s").alias("above"), F.col("no").alias("parent"))
    edges = stage(placed.join(parents, "above", "left").select(
        F.coalesce("parent", F.lit(0)).alias("parent"), F.col("no").alias("child"),
        F.expr("substr(s, common + 1, 1)").alias("head"), F.expr("substr(s, common + 1)").alias("label"),
        F.when(F.col("ends"), F.col("s")).alias("s")), "edges")
    onward = edges.groupBy(F.col("parent").alias("child")).agg(F.array_join(F.collect_list("head"), "").alias("heads"))
    return edges.join(onward, "child", "left").select(*edges.columns, F.coalesce("heads", F.lit("")).alias("heads"))


# --- the walk -------------------------------------------------------------------------------


def _meet(states: DataFrame, level: DataFrame, keys: list[str], many: bool) -> DataFrame:
    """States with the edges of their level that they can go; of a level too large to broadcast, hot nodes are told apart."""
    if not many:
        return states.join(level, keys)
    rows = stage(states.groupBy(*keys).agg(F.count("*").alias("rows")), "ahead")
    return join_counted(states, rows, keys, "rows", "left_semi").join(level, keys) if keys == ["node"] else join_counted(
        states, stage(rows.join(level, keys), "ahead"), keys, "rows")


def _step(states: DataFrame, level: DataFrame, many: bool) -> DataFrame:
    """All states one edge further.

    With an edit, or before the middle, only the edge that begins with the word's next character will do; past the middle any
    edge of the node. A label is taken as it stands, with one letter replaced, or with one letter of the word left out, where
    the word's own letter is past the middle. States that can neither end nor go on are not kept.
    """
    head = F.expr("substr(word, place + 1, 1)")
    # The mark in front of a word belongs to its first half.
    now = states.withColumns({"middle": F.expr("1 + (length(word) - 1) div 2"), "head": head})
    bound = F.expr("edits = 1 OR place < middle")
    met = _meet(now.where(bound), level, ["node", "head"], many).unionByName(
        _meet(now.where(~bound).drop("head"), level, ["node"], many).drop("head"), allowMissingColumns=True)
    met = met.withColumn("size", F.length("label"))
    met = met.withColumn("fixed", F.expr("CASE WHEN edits = 1 THEN size ELSE least(greatest(middle - place, 0), size) END"))
    met = met.where("place + size <= length(word) AND substr(word, place + 1, fixed) = substr(label, 1, fixed)")
    rest = "substr(label, fixed + 1)"
    same = F.expr(f"levenshtein(substr(word, place + 1 + fixed, size - fixed), {rest}, 1)")
    longer = F.expr(
        "CASE WHEN edits = 0 AND place + size >= middle AND place + size < length(word)"
        f" THEN levenshtein(substr(word, place + 1 + fixed, size - fixed + 1), {rest}, 1) END")
    ways = F.array_compact(F.array(
        F.when(same >= 0, F.struct(F.expr("place + size").alias("place"), (F.col("edits") + same).alias("edits"))),
        F.when(longer == 1, F.struct(F.expr("place + size + 1").alias("place"), F.lit(1).alias("edits"))),
    ))
    after = met.select("word", "child", "s", "heads", F.explode(ways).alias("way")).select(
        "word", "way.place", F.col("child").alias("node"), "way.edits", "s", "heads")
    alive = F.expr("CASE WHEN place < length(word) THEN contains(heads, substr(word, place + 1, 1)) OR edits = 0 ELSE edits = 1 AND s IS NOT NULL END")
    return after.where(alive).drop("heads")


def near_words(words: DataFrame) -> DataFrame:
    """word and near: all ordered pairs of distinct ``words`` (column ``word``) that differ by exactly one code point inserted, deleted or replaced.

    Replaced and left-out letters are walked; an added one is a left-out one the other way round. Every state is at the same
    level, so a level needs only its own edges; there are no more levels than branchings on the way to a word.
    """
    both = words.select(F.concat(F.lit(_FORWARDS), "word").alias("s")).union(words.select(F.concat(F.lit(_BACKWARDS), F.reverse("word")).alias("s")))
    both = stage(both, "strings")
    edges = stage(trie(both), "edges").withColumnRenamed("parent", "node")
    states = both.select(F.col("s").alias("word"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("edits"))
    level = stage(edges.where("node = 0"), "level")
    pairs = None
    while (size := level.count()) and not states.isEmpty():
        after = stage(_step(states, level, size > BROADCAST_EDGES), "states")
        found = after.where("place = length(word)").select("word", F.col("s").alias("near"))
        pairs = found if pairs is None else pairs.union(found)
        states = after.where("place < length(word)").drop("s")
        level = stage(edges.join(level.select(F.col("child").alias("node")), "node"), "level")
    if pairs is None:
        return words.select("word", F.col("word").alias("near")).where("false")

    def plain(column: str):
        return F.when(F.col(column).startswith(_FORWARDS), F.expr(f"substr({column}, 2)")).otherwise(F.reverse(F.expr(f"substr({column}, 2)")))

    pairs = stage(pairs.select(plain("word").alias("word"), plain("near").alias("near")), "pairs")
    left_out = pairs.where("length(near) < length(word)").select(F.col("near").alias("word"), F.col("word").alias("near"))
    return pairs.union(left_out).distinct()


# --- forms and roots ------------------------------------------------------------------------


def _roots(links: DataFrame) -> DataFrame:
    """word and root of links (word, form): the last form reached, by jumps of doubling length. A form is more frequent than its word, so links end."""
    roots = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(roots.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = after.select("word", "root")
        if after.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """The words of all whole texts of ``docs`` (doc_id, text) with their more frequent spelling, one row per word.

    Words are those of ``word_counts`` with at least ``min_chars`` code points and ``min_count`` occurrences n. n_near words
    differ from a word by exactly one code point; of them form has the largest n (of equal ones the first in code-point
    order), where that (form_n) is at least ``ratio`` times the word's n, else it is null. root is the last form reached from
    the word, itself without one. Null and empty texts have no words; repeated rows count each time; a null doc_id counts as
    empty where typos are made; other columns are ignored; an empty table gives an empty result.
    """
    words = stage(word_counts(docs, typo_every).where((F.length("word") >= min_chars) & (F.col("n") >= min_count)), "words")
    counted = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near_words(words).join(counted, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    told = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.order") >= ratio * F.col("n"), -F.col("best.order")))
    told = stage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form")), "forms")
    return told.join(_roots(told.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
