"""Byte-pair encoding, alignment of two vocabularies and spelling variants against plain versions, and on edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from check import difference
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from recordmill.llm import alignment, bytepairs, spelling

SCHEMA = "doc_id long, text string, lang string, ids string, n long, word string, near string"
EDGES = [(1, None), (2, ""), (3, " "), (4, "a ▁ b"), (5, "same text here"), (5, "same text here"), (None, "null id <|endoftext|> and <s> 漢字 \U0001f44d  "), (7, "\n a \n")]


def library(special=True):
    tok = Tokenizer.from_file(bytepairs.VOCABULARY)
    tok.encode_special_tokens = not special
    return tok


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0, "w", "v") for i, t in rows], SCHEMA).repartition(3)


def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


# --- byte pairs -------------------------------------------------------------------------------


@pytest.mark.parametrize("special", [True, False])
def test_tree_gives_the_librarys_ids(monkeypatch, special):
    """Tiny leaves and windows, so that every kind of cut is met."""
    for name, value in {"LEAF": 5, "WINDOW": 3, "SEAM": 1, "SHORT": 4}.items():
        monkeypatch.setattr(bytepairs, name, value)
    c, lib, r = bytepairs.Codec(bytepairs.VOCABULARY, special), library(special), random.Random(3)
    parts = ["a", "b", " ", "  ", "'", "'re", "'ll", "\n", " \n", "é", "漢", "\U0001f44d", "1", "!", "!!", " the", "zzz", " ", "՘", "<|endoftext|>", "<|endof", "aaaaaaaa", "'s", "r", "e"]
    for _ in range(2500):
        some = r.sample(parts, r.choice([len(parts), 8, 4, 3]))
        text = "".join(r.choice(some) for _ in range(r.randint(0, 60)))
        assert c.encode(text) == lib.encode(text, add_special_tokens=False).ids, repr(text)
        assert c.decode(c.encode(text)) == text


def test_characters_all_libraries_class_alike():
    c = bytepairs.Codec(bytepairs.VOCABULARY)
    sure = [ch for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not bytepairs._OTHER.match(ch := chr(i))]
    for i in range(0, len(sure), 4096):
        text = "".join(f"a{ch}1{ch}!{ch} x" for ch in sure[i : i + 4096])
        assert c.words(text) == [text[a:b] for _, (a, b) in c.library.pre_tokenizer.pre_tokenize_str(text)]
        assert c.leaf(text) == c.library.encode(text, add_special_tokens=False).ids


def test_dealt_texts(spark):
    """Beyond SPREAD: pieces on several tasks, added tokens, one run without any boundary, a repeated row and a null id."""
    long = [(1, "a" * 300_000), (2, "some words, don't " * 20_000 + "<|endoftext|>" + "漢字" * 70_000 + "<|endoftext|>"), (2, " " * 270_000 + "x"), (None, "ab" * 140_000), (None, "ab" * 140_000)]
    lib = library()
    got = Counter((r.doc_id, tuple(r.ids)) for r in bytepairs.encode(frame(spark, [*long, (9, "short")])).collect())
    assert got == Counter((i, tuple(lib.encode(t, add_special_tokens=False).ids)) for i, t in [*long, (9, "short")])


def test_encoding_query(spark, duck):
    lib = library()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op12_bpe"](spark, SF).collect()}
    want = {}
    for i, text in documents(duck):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_encoding_edges(spark):
    rows = bytepairs.encoding_digests(frame(spark, EDGES)).collect()
    lib = library()
    want = Counter((i, len(lib.encode(t or "").ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGES)
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in rows) == want
    assert bytepairs.encoding_digests(frame(spark, EDGES).where("false")).collect() == []
    ids = spark.createDataFrame([(1, None), (2, []), (3, [64, 10**6, 65])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bytepairs.decode(ids).collect()} == {1: None, 2: "", 3: "ab"}


# --- alignment --------------------------------------------------------------------------------


def plain_alignment(rows):
    lib, model = library(False), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    c = bytepairs.Codec(bytepairs.VOCABULARY)
    told, count = [], Counter()
    for i, text in rows:
        a = lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        bytes_a = [c.bytes[x] for x in a]
        bytes_b = [bytes([int(model.id_to_piece(x)[1:-1], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        groups, links = [], Counter()
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            x = y = at_x = at_y = 0
            one = ([], [])
            while x < len(a) or y < len(b):
                if at_x <= at_y:
                    at_x += len(bytes_a[x])
                    one[0].append(a[x])
                    x += 1
                else:
                    at_y += len(bytes_b[y])
                    one[1].append(b[y])
                    y += 1
                if at_x == at_y:
                    groups.append(one)
                    one = ([], [])
        else:
            a, b = [], []
        for g in groups:
            links.update((p, q) for p in g[0] for q in g[1])
        count.update(links.keys())
        told.append((i, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = Counter()
    for i, n_a, n_b, groups, links in told:
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out[(i, n_a, n_b, len(groups), links.total(), sum(n for pair, n in links.items() if count[pair] == top[pair[0]]),
             sum(n * count[pair] for pair, n in links.items()), hashlib.sha256(line.encode()).hexdigest() if groups else "")] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query(spark, duck):
    got = Counter(tuple(r) for r in entry.queries()["op13_token_alignment"](spark, SF).select(*COLUMNS).collect())
    assert got == plain_alignment(documents(duck))


def test_alignment_edges(spark):
    hot = [(100 + i, "one text that many rows hold") for i in range(40)]
    rows = [*EDGES, *hot, (8, "x" * 70_000), (9, "")]
    assert Counter(tuple(r) for r in alignment.align_documents(frame(spark, rows)).select(*COLUMNS).collect()) == plain_alignment(rows)
    assert alignment.align_documents(frame(spark, rows).where("false")).collect() == []
    alone = alignment.align_documents(frame(spark, [(1, None), (2, "▁")])).collect()
    assert sorted((r.doc_id, r.n_a, r.count_sum, r.groups_sha256) for r in alone) == [(1, 0, 0, ""), (2, 0, 0, "")]


def test_alignment_in_segments(monkeypatch):
    """A text cut at sure boundaries gives what it gives whole."""
    text = "The quick   brown fox\n \n  jumps, don't   you see? 漢字 über  alles " * 40
    aligner = alignment.Aligner(alignment.VOCABULARY, alignment.PIECES)
    whole = aligner.align(text)
    for size in (7, 50, 333):
        monkeypatch.setattr(alignment, "SEGMENT", size)
        monkeypatch.setattr(bytepairs, "LEAF", 16)
        part = aligner.align(text)
        assert part[:5] == whole[:5] and (part[5] == whole[5]).all() and (part[6] == whole[6]).all()


# --- spelling ---------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_spelling_query(spark, duck):
    assert difference(entry.queries()["op11_spelling_variants"](spark, SF), duck, entry.oracle_sql()["op11_spelling_variants"]) is None


@pytest.mark.parametrize("many", [False, True])
def test_near_words(spark, monkeypatch, many):
    """Few letters, so that labels, prefixes and repeats of all kinds meet; also with levels too large to broadcast."""
    if many:
        monkeypatch.setattr(spelling, "BROADCAST_EDGES", 0)
    r = random.Random(7)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(150 if many else 400)} | {"a" * n for n in range(1, 14)})
    got = {tuple(x) for x in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).select("word", "near").collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_spelling_edges(spark):
    rows = [*EDGES, (11, "Common word " * 50), (12, "comon Zebras zebra " * 6), (12, "comon Zebras zebra " * 6), (13, "zebrass " * 200)]
    docs = frame(spark, rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, 5, 5, 5, None).collect()}
    assert got["zebras"] == ("zebrass", "zebrass", 12, 2, 200) and got["zebra"] == (None, "zebra", 12, 1, None)
    assert got["comon"] == (None, "comon", 12, 1, None) and got["common"] == (None, "common", 50, 1, None)
    assert spelling.spelling_variants(docs.where("false")).collect() == []
    assert spelling.spelling_variants(docs, 100, 5).collect() == []


def test_chain_of_forms(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")
    assert {r.word: r.root for r in spelling._roots(links).collect()} == dict.fromkeys("abcdx", "e")


def test_counts_are_summed_within_tasks_first(spark):
    plan = spelling.word_counts(spark.read.parquet(f"{SF}/documents.parquet").withColumn("word", F.lit(1)))
    assert plan.count() > 1000
