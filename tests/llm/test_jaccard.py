"""The pipeline's near copies against the similarity of all pairs."""

import random

from provender.llm import jaccard, simhash
from tests.llm.test_simhash import plain_fingerprint


def plain_set(text):
    w = (text or "").lower().split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def similar(x, y):
    return len(x & y) * 5 >= len(x | y) * 4


def plain_components(ids, sets):
    low = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if similar(sets[i], sets[j]) and low[i] != low[j]:
                a, b = low[i], low[j]
                low = [b if x == a else x for x in low]
    return [min(d for d, x in zip(ids, low) if x == c) for c in low]


def corpus(n=220, seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    texts = []
    for i in range(n):
        w = (rnd.choice(texts[:12] if rnd.random() < 0.7 else texts) if texts and rnd.random() < 0.7 else " ".join([*(word() for _ in range(rnd.randrange(1, 120))), line])).split(" ")
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + ["", " ", "One", "one", "a b c d", "a b c d e", "x " * 5_000]


def test_equals_all_pairs_also_where_many_share_a_shingle(spark):
    texts = corpus()
    ids = [1000 - 3 * i for i in range(len(texts))]
    want = sorted(zip(ids, plain_components(ids, [plain_set(t) for t in texts])))
    df = spark.createDataFrame(list(zip(texts, ids)), "text string, doc_id long")
    assert 20 < len({c for _, c in want}) < len(want) - 50
    for how in ({}, {"group": 2, "rounds": 1}):
        assert sorted(tuple(r) for r in jaccard.near_copies(df, **how).collect()) == want


def test_stage_drops_copies_that_fingerprints_miss(spark):
    w = [f"w{i}" for i in range(120)]
    near, far = list(w), list(w)
    near[30] = near[80] = "other"
    for i in (20, 40, 60, 80):
        far[i] = "other"
    rows = [(i, " ".join(t)) for i, t in enumerate((w, near, far))] + [(None, " ".join(w))]
    a, b = (plain_fingerprint(rows[i][1]) for i in (0, 1))
    assert (a ^ b).bit_count() > 4 and similar(plain_set(rows[0][1]), plain_set(rows[1][1]))
    assert not similar(plain_set(rows[0][1]), plain_set(rows[2][1]))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 2), (True, None)]


def test_wrong_first_links_make_no_links(spark):
    texts = corpus()
    ids = [1000 - 3 * i for i in range(len(texts))]
    want = sorted(zip(ids, plain_components(ids, [plain_set(t) for t in texts])))
    df = spark.createDataFrame(list(zip(texts, ids)), "text string, doc_id long")
    likely = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(ids[0], ids[0])], "a long, b long")
    assert sorted(tuple(r) for r in jaccard.near_copies(df, group=2, rounds=2, first_links=likely).collect()) == want
