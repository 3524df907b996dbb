"""Words of texts and their counts, against a plain count."""

import re
import zlib
from collections import Counter

import corpus_pipeline
from conftest import SF

from recordmill.llm import spelling


def plain(rows, every):
    total = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return total


def test_counts_of_odd_characters(spark):
    odd = "Größe÷×ÀÉ a\u00a0b?c\u0178d\u0130 İstanbul ſ K漢a\u0301ß\U0001f44dx-y_z0q naïve Naïve NAÏVE"
    rows = [(i, f"{odd} w{'abcdefgh'[i % 8] * 3} {odd}") for i in range(60)] + [(None, odd), (5, odd), (7, None), (8, ""), (9, "?  ?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for every in (None, 2, 7):
        found = {r.word: r.n for r in spelling.word_counts(docs, every).collect()}
        assert found == dict(plain(rows, every))


def test_texts_are_not_shuffled_to_leave_few_out(spark):
    docs = spark.createDataFrame([(i, "some words", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    plan = corpus_pipeline._decontaminate(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hash" not in plan
