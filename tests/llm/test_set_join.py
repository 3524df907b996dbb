"""The exact set join of what the star rounds leave apart."""

import random

from recordmill.llm import minhash
from recordmill.llm.minhash import near_duplicates, similar_pairs


def alike(x, y, percent=80):
    return 100 * len(x & y) >= percent * len(x | y)


def joined(spark, sets, labels):
    rows = spark.createDataFrame([(i, labels[i], len(s)) for i, s in sets.items()], "class long, label long, n long")
    held = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id long, shingles array<long>")
    pairs = [(r.a, r.b) for r in similar_pairs(rows, held, 80).collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_no_similar_pair_is_left_out(spark, monkeypatch):
    """Random families of sets, copies with edits, sets of one, exact limits of 0.8; also with every shingle dealt to several tasks."""
    r = random.Random(3)
    sets, i = {}, 0
    for _ in range(60):
        core = r.sample(range(10**6), r.choice([1, 4, 5, 9, 10, 40]))
        for _ in range(8):
            s = set(core)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                s.discard(r.choice(core))
            s |= set(r.sample(range(300), r.choice([0, 1, 2, 10])))
            if s:
                sets[i], i = s, i + 1
    labels = {k: r.choice([k, k, 0]) for k in sets}
    want = {(a, b) for a in sets for b in sets if a < b and labels[a] != labels[b] and alike(sets[a], sets[b])}
    assert len(want) > 100 and want <= joined(spark, sets, labels)
    monkeypatch.setattr(minhash, "PART_PAIRS", 3)
    assert want <= joined(spark, sets, labels)


def test_a_large_group_below_the_threshold_makes_no_pairs(spark):
    """400 sets that share 87 of 100 shingles with each other (0.77): one bucket of them all would hold 79800 pairs."""
    sets = {i: set(range(87)) | {1000 + 13 * i + k for k in range(13)} for i in range(400)}
    assert joined(spark, sets, {i: i for i in sets}) == set()


def test_null_ids_and_groups(spark):
    """A null doc_id and repeated rows beside a chain that only the set join can close."""
    s, t, u, v = ([f"{c}3x{i}" for i in range(n)] for c, n in (("s", 70), ("t", 20), ("u", 5), ("v", 25)))
    rows = [(i, " ".join(x)) for i, x in enumerate((s + v, s + t, s + t + u, s + t), 1)] + [(4, " ".join(s + t)), (9, ""), (None, " ".join(s + t))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, bands=1, rows=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [
        (1, 1, True), (2, 2, True), (3, 2, False), (4, 2, False), (4, 2, False), (9, 9, True)]
    assert [(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id is None] == [(None, True, 90)]
