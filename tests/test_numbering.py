"""Consecutive numbers in an order."""

import random

from pyspark.sql import functions as F

from provender.operators.numbering import numbered


def test_numbers_follow_the_order_and_are_dense(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 2, 2, 3]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, i long").repartition(7)
    got = [(r.k, r.i, r.number) for r in numbered(df, [F.asc_nulls_last("k"), F.desc("i")]).collect()]
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert sorted(got, key=lambda r: r[2]) == [(*r, n) for n, r in enumerate(want, 1)]


def test_empty_and_first(spark):
    df = spark.createDataFrame([(5,), (4,)], "i long")
    assert numbered(df.limit(0), ["i"]).count() == 0
    assert sorted(tuple(r) for r in numbered(df, ["i"], "n", first=10).collect()) == [(4, 10), (5, 11)]
