"""The solver against all plans, its bounds, and searches that end with a proof."""

import itertools

import numpy as np
import pandas as pd
import pytest

from provender.operators import menu
from provender.operators import simplex as s

INF = np.inf


def programme(rng, trial):
    n, m = int(rng.integers(1, 5)), int(rng.integers(1, 4))
    a, c = rng.integers(-3, 6, (m, n)).astype(float), rng.integers(-5, 6, n).astype(float)
    if trial % 3 == 0:
        c = rng.normal(size=n)
        a = a + rng.normal(size=a.shape) * (trial % 2)
    low = rng.integers(-2, 3, n).astype(float)
    high = low + rng.integers(0, 5, n)
    mid = a @ rng.integers(low, high + 1)
    row_low, row_high, kind = mid - rng.integers(0, 4, m), mid + rng.integers(0, 4, m), rng.integers(0, 3, m)
    row_low, row_high = np.where(kind == 1, -INF, row_low), np.where(kind == 2, INF, row_high)
    if trial % 5 == 0:
        row_low = row_low + 3
        row_high = np.maximum(row_high, row_low)
    return c, a, row_low, row_high, low, high


def inside(x, a, row_low, row_high, low, high, tol=1e-7):
    r = a @ x
    return (r >= row_low - tol).all() and (r <= row_high + tol).all() and (x >= low - tol).all() and (x <= high + tol).all()


def test_whole_numbers_against_all_plans():
    rng = np.random.default_rng(7)
    for trial in range(600):
        c, a, row_low, row_high, low, high = programme(rng, trial)
        grid = np.array(list(itertools.product(*(np.arange(x, y + 1) for x, y in zip(low, high)))))
        rows = grid @ a.T
        ok = ((rows >= row_low - 1e-9) & (rows <= row_high + 1e-9)).all(1)
        if not ok.any():
            with pytest.raises(s.InfeasibleScenario):
                s.whole(c, a, row_low, row_high, low, high)
            continue
        search = s.Search()
        x = s.whole(c, a, row_low, row_high, low, high, search=search)
        assert search.status == "optimal" and inside(x, a, row_low, row_high, low, high)
        assert c @ x == pytest.approx((grid[ok] @ c).min(), abs=1e-7)
        y = s.minimise(c, a, row_low, row_high, low, high)
        assert c @ y <= c @ x + 1e-7 and inside(y, a, row_low, row_high, low, high)


def test_best_corner_is_found():
    rng = np.random.default_rng(11)
    for trial in range(200):
        c, a, row_low, row_high, low, high = programme(rng, trial)
        n = len(c)
        planes = np.vstack([a, a, np.eye(n), np.eye(n)])
        sides = np.concatenate([row_low, row_high, low, high])
        planes, sides = planes[np.isfinite(sides)], sides[np.isfinite(sides)]
        best = INF
        for k in itertools.combinations(range(len(planes)), n):
            if abs(np.linalg.det(planes[list(k)])) > 1e-9:
                x = np.linalg.solve(planes[list(k)], sides[list(k)])
                if inside(x, a, row_low, row_high, low, high, 1e-9):
                    best = min(best, c @ x)
        if best == INF:
            with pytest.raises(s.InfeasibleScenario):
                s.minimise(c, a, row_low, row_high, low, high)
        else:
            assert c @ s.minimise(c, a, row_low, row_high, low, high) == pytest.approx(best, abs=1e-6)


def test_sizes_far_apart():
    w = np.array([1e6, 3.0, 2e4, 0.5])
    x = s.minimise(np.array([1.0, 2.0, 3.0, 0.1]), np.ones((1, 4)), np.array([w.sum()]), np.array([w.sum()]), w * 0.85, w * 1.15)
    assert x.sum() == pytest.approx(w.sum(), rel=1e-12) and x[0] == pytest.approx(w.sum() - (w[1] + w[2]) * 0.85 - w[3] * 1.15)


def test_large_menus_end_with_a_proof():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        n = 30
        freq, cost = rng.integers(2, 40, n).astype(float), rng.integers(100, 900, n) / 100
        green = cost * (np.arange(n) % 2)
        search = s.Search()
        x = s.whole(-green, np.array([np.ones(n), cost]), np.array([freq.sum(), -INF]), np.array([freq.sum(), cost @ freq * 0.98]), np.ceil(freq / 2), np.floor(freq * 1.5), search=search)
        assert search.status == "optimal" and x.sum() == freq.sum() and cost @ x <= cost @ freq * 0.98 + 1e-9


def test_grid():
    assert s.grid(np.array([0.25, 1.5, 0.0])) == 0.25 and s.grid(np.array([3.0, 6.0])) == 3.0
    assert s.grid(np.array([0.01, 0.35])) == pytest.approx(0.01) and s.grid(np.array([np.pi, 1.0])) is None and s.grid(np.zeros(3)) is None


def test_a_stopped_search_says_so():
    search = s.Search()
    assert s.whole(np.array([1.0]), np.array([[1.0]]), np.array([1.0]), np.array([2.0]), np.zeros(1), np.ones(1) * 3, most=0, search=search) is None
    assert search.status == "unfinished"


def test_a_limit_beside_eighths_is_taken_as_it_is():
    """62.5 * (1 - 0.07) is a little less than 58.125 as a double, so 465 eighths are over it."""
    most = 62.5 * (1 - 0.07)
    x = s.whole(np.array([-1.0, 0.0]), np.array([[1.0, 1.0], [0.125, 0.0]]), np.array([465.0, -INF]), np.array([465.0, most]), np.zeros(2), np.full(2, 500.0))
    assert most < 58.125 and x.tolist() == [464.0, 1.0]


HARD = (
    [49, 15, 26, 48, 33, 20, 49, 24, 43, 4, 49, 34], [1.5, 1.0, 6.75, 11.375, 7.5, 6.125, 1.5, 7.5, 2.5, 9.375, 1.5, 13.125],
    [0, 0, 1, 1, 0, 1, 0, 1, 0, 1, 0, 1], [0.625, 1.25, 4.5, 4.375, 3.75, 4.375, 0.625, 3.0, 1.25, 3.125, 0.875, 4.375],
)


@pytest.mark.parametrize("goal", ["cost", "sustainable", "ghg"])
def test_menus_with_many_equal_bounds_need_few_branches(goal):
    """Branches alone took 3,236, 18,602 and more for this menu."""
    freq, cost, green, ghg = HARD
    dishes = pd.DataFrame({"baseline_freq": freq, "cost": cost, "sus_cost": np.array(cost) * green, "ghg": ghg})
    search = s.Search()
    x = menu.plan(dishes, goal, cut=0.02 if goal == "ghg" else 0.0, search=search)
    assert search.status == "optimal" and search.branches < 1_500 and x.sum() == sum(freq)


def test_sweep_against_all_plans():
    rng = np.random.default_rng(8)
    for trial in range(150):
        n = int(rng.integers(2, 5))
        cost, row = rng.integers(-8, 20, n) / 4, rng.integers(-4, 12, n) / 8
        low = rng.integers(-1, 3, n).astype(float)
        high = low + rng.integers(0, 6, n)
        a = np.array([np.ones(n), row])
        total, limit = float(rng.integers(int(low.sum()), int(high.sum()) + 1)), float(row @ high) * 0.6
        sides = (np.array([total, -INF]), np.array([total, limit])) if trial % 2 else (np.array([total, limit]), np.array([total, INF]))
        plans = [np.array(p) for p in itertools.product(*(range(int(x), int(y) + 1) for x, y in zip(low, high)))]
        good = [p for p in plans if ((a @ p >= sides[0]) & (a @ p <= sides[1])).all()]
        fits, x = s._swept(cost, a, *s._rounded_rows(a, *sides), low, high, np.zeros(n), INF, 10_000)
        assert fits and (x is None) == (not good)
        if good:
            assert any((x == p).all() for p in good) and cost @ x == min(cost @ p for p in good)
            some = s._swept(cost, a, *s._rounded_rows(a, *sides), low, high, np.zeros(n), INF, 10_000, 3)[1]
            assert some is None or any((some == p).all() for p in good)
            # what prices may leave out are plans that are dearer than the room above the relaxation
            for room in (0.0, 1.0):
                tight = s._swept(cost, a, *s._rounded_rows(a, *sides), low, high, cost, room, 10_000)[1]
                best = min(cost @ p for p in good)
                assert (tight is not None) == (best <= np.minimum(cost * low, cost * high).sum() + room)


def test_branches_and_sweeps_agree():
    rng = np.random.default_rng(9)
    for _ in range(12):
        n = 6
        cost, green = rng.integers(4, 40, n) / 8, rng.integers(0, 2, n)
        x0 = rng.integers(1, 9, n).astype(float)
        args = (cost, np.array([np.ones(n), cost * green]), np.array([x0.sum(), x0 @ (cost * green)]), np.array([x0.sum(), INF]), np.ceil(x0 / 2), np.floor(x0 * 1.5))
        each = [s.whole(*args, tries=0, patience=10**9), s.whole(*args, tries=0, patience=1), s.whole(*args)]
        assert len({float(cost @ x) for x in each}) == 1
