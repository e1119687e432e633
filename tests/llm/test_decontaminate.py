"""Edit matching against the plain dynamic programme over every document and item."""

import random

from provender.llm import decontaminate as dec


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i = rnd.randrange(len(t))
        t[i : i + rnd.randrange(2)] = rnd.choice(["", "q", "e", "ß"])
    return "".join(t)


def made(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 18)))) for i in range(14)]
    items += [(20, items[0][1]), (21, None), (22, " ?! "), (23, "Ärger, überall!")]
    docs = []
    for d in range(120):
        t = " ".join(word() for _ in range(rnd.randrange(0, 40)))
        if rnd.random() < 0.6:
            t += " " + edit(rnd, rnd.choice([x for _, x in items if x]), rnd.randrange(0, 9)).upper() + ".\n" + word()
        docs.append((d, t))
    return items, [*docs, docs[0], (500, None), (501, ""), (502, "x y " * 20_000 + "ärger\nüberall"), (None, items[1][1])]


def test_equals_dynamic_programme(spark):
    items, docs = made()
    want = []
    for d, t in docs:
        for i, x in items:
            if p := dec.fold(x):
                k = len(p) // 8
                if len(t or "") < 10_000 and (n := plain_distance(p, dec.fold(t))) <= k:
                    want.append((d, i, n, k, len(p)))
    want.append((502, 23, 0, 1, 13))
    frame = spark.createDataFrame([(t, d, "clash") for d, t in docs], "text string, doc_id long, item_id string")
    bench = spark.createDataFrame([(i, x, 0) for i, x in items], "item_id long, text string, distance int")
    key = lambda r: tuple((x is None, x) for x in r)
    for block in (1_000_000, 100):  # one block, and several
        got = [tuple(r) for r in dec.contaminated(frame, bench, error_rate=0.125, block_chars=block).collect()]
        assert sorted(got, key=key) == sorted((w for w in want if w[0] != 502 or w[1] == 23), key=key)


def test_pieces_are_one_more_than_the_budget_and_cover():
    for n, k in ((30, 0), (30, 1), (97, 9), (400, 40)):
        chains = dec.pieces(n, k)
        leaves = [c[0] for c in chains]
        assert len(leaves) == k + 1 and leaves[0][0] == 0 and leaves[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:])) and all(c[-1] == (0, n, k) for c in chains)


def test_stage_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "clean text", "en"), (2, "see: The quick, brown fox jumps over it", "en"), (3, None, None), (None, "The quick brown fox jumps over it", "x"), (2, "clean too", "y")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(7, "the quick brown fox jumps over it")], "item_id long, text string")
    kept = dec.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in dec.without_leaks(docs, bench.unionByName(bench.selectExpr("item_id + 1 AS item_id", "'clean too' AS text")), block_chars=20).collect()) == [1, 3]
    assert dec.contaminated(docs, bench.limit(0)).collect() == [] and dec.contaminated(docs.limit(0), bench).collect() == []
