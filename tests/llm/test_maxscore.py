"""MaxScore against all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from provender.llm import maxscore


def made(n, dim, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([rnd.gauss(0, 0.2), 0.0, 0.125]) for _ in range(dim)], 1) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [None] * dim, 1), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1)]
    return rows + [(n + 10 + i, rows[5 * i % n][1], 2) for i in range(20)]


def plain(rows, k, every):
    vs = [(i, [math.floor(x * 1024) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in vs:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vs if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "how"), [(300, 12, {}), (300, 12, {"query_block": 7, "broadcast_bytes": 0}), (4, 3, {}), (120, 1, {})])
def test_equals_all_scores(spark, n, dim, how):
    rows = made(n, dim, n + dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(5)
    got = sorted(tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 10 == 0, **how).collect())
    assert got == plain(rows, 10, 10)


def test_mixed_dimensions_no_components_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0]), (2, [0.5, 0.5]), (3, []), (10, [])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == [(0, 1, 2, 512 * 1024 + 512 * 512), (10, 1, 3, 0)]
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_components_of_any_finite_size(spark):
    """Products beyond longs: right ranks, scores cut to fit a long; large ones that fit are exact."""
    rnd = random.Random(8)
    sizes = [1e300, 1.7e308, 4e6, 2.0**52, 3e9, 1.0, 1e-300, 0.0]
    rows = [(i, [rnd.choice(sizes) * rnd.choice([1, -1]) for _ in range(3)], 1) for i in range(120)]
    rows += [(200 + i, [4e6 + i, 4e6, -4e6 - 2 * i], 1) for i in range(20)] + [(300, [2.0**46, 0.0, 0.0], 1), (310, [2.0**-3, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 10 == 0).collect())
    vs = [(i, [math.floor(x * 1024) if abs(x) < 1e15 else int(x) * 1024 for x in v]) for i, v, _ in rows]
    want = []
    for i, q in vs:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vs if j != i)[:10]
            want += [(i, r + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
