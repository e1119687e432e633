"""The index of grams loses no similar pair and keeps the best of each text."""

import random

from pyspark.sql import functions as F

from provender.functions.grams import GramIndex, common_at_least, grams
from provender.functions.similarity import ratio
from provender.operators import search


def texts(rng, n):
    words = ["milk", "whole", "rice", "5", "25", "lb", "oat", "a", "x" * 70, "é", ""]
    out = {" ".join(sorted(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for _ in range(n)}
    base = sorted(out)
    for t in base:  # near ones
        for _ in range(3):
            i = rng.randrange(len(t) + 1)
            out.add(t[:i] + rng.choice(["q", "", "1"]) + t[min(len(t), i + rng.randrange(3)) :])
    return sorted(out)


def test_bound_holds_for_every_pair():
    rng = random.Random(1)
    ts = texts(rng, 80)
    for a in ts[:80]:
        for b in ts:
            x, y, r = grams(a), grams(b), ratio(a, b)
            for least in (50.0, 90.0, 97.0, r):
                if r >= least:
                    assert len(x & y) >= common_at_least(len(a), len(b), len(x), len(y), least) - 1e-9, (a, b, least)


def test_best_of_each_text():
    rng = random.Random(2)
    asks, others = texts(rng, 30), texts(rng, 60)
    for k, cells in ((1, 10**6), (3, 100), (50, 1000)):
        best = GramIndex(asks).best(k, 80.0, cells)
        next(best)
        for lo in range(0, len(others), 17):
            best.send(others[lo : lo + 17])
        who, place, found, score = best.send(None)
        got = {}
        for t, p, o, s in zip(who, place.tolist(), found, score.tolist()):
            assert others[p] == o and abs(ratio(t, o) - s) < 1e-9
            got.setdefault(t, []).append((-s, p))
        for t in asks:
            want = sorted((-r, p) for p, o in enumerate(others) if (r := ratio(t, o)) >= 80)[:k]
            assert sorted(got.get(t, []))[: len(want)] == want


def test_join_in_blocks_and_empty_sides(spark):
    rng = random.Random(3)
    asks, others = texts(rng, 20), texts(rng, 40)
    x = spark.createDataFrame([(t,) for t in asks], "_x string")
    y = spark.createDataFrame([(t, i) for i, t in enumerate(others)], "_y string, _first long").repartition(3)
    ranked = lambda t: sorted((-ratio(t, o), p) for p, o in enumerate(others) if ratio(t, o) >= 90)
    want = sorted((t, others[p]) for t in asks for _, p in ranked(t)[:2])
    for block in (20_000, 5):
        assert sorted((r["_x"], r["_y"]) for r in search.similar_texts(x, y, 2, block_texts=block).collect()) == want
    assert search.similar_texts(x.limit(0), y, 2).count() == 0 and search.similar_texts(x, y.limit(0), 2).count() == 0


def test_no_nested_loop_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "MILK"), (2, "MILK 2")], "product_id long, name string").withColumn("ord", F.col("product_id"))
    plan = search.match_uploads(rows.withColumnRenamed("product_id", "upload_id").drop("ord"), rows, skip_own=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
