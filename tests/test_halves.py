"""Menus by halves and by all plans at once, against plain lists of plans."""

import itertools

import numpy as np
import pandas as pd
import pytest

from provender.operators import menu
from provender.operators.simplex import InfeasibleScenario
from tests.test_simplex import HARD

GOALS = [("cost", 0.0), ("sustainable", 0.0), ("ghg", 0.02), ("sustainable", 0.3), ("ghg", 0.3)]


def menus(trials, seed):
    rng = np.random.default_rng(seed)
    for t in range(trials):
        n = int(rng.integers(1, 6))
        x0, unit = rng.integers(0, 9, n).astype(float), (0.125, 0.25, 0.01, 1.0)[t % 4]
        cost = rng.integers(0, 40, n) * unit
        low, high = np.ceil(x0 / 2), np.floor(x0 * 1.5)
        if t % 5 == 0:  # a new dish
            x0[0], low[0], high[0] = 0, 0, 4
        yield x0, cost, cost * rng.integers(0, 2, n), rng.integers(0, 30, n) / 8 if t % 3 else rng.random(n), low, high


def best(figures, goal, cut):
    """(value of a plan, the best one or None, whether a plan is allowed) from all plans."""
    x0, cost, green, ghg, low, high = figures
    every = np.array(list(itertools.product(*(np.arange(a, b + 1) for a, b in zip(low, high)))))
    every = every[every.sum(1) == x0.sum()]
    slack = 0.0 if (cost * 8 == np.round(cost * 8)).all() else 1e-9
    ok = every @ green >= green @ x0 - 1e-9 if goal == "cost" else every @ cost <= cost @ x0 * (1 - cut) + slack
    if goal == "ghg" and ok.any():
        ok &= every @ green >= (every @ green)[ok].max() - 1e-6
    of = {"cost": cost, "sustainable": -green, "ghg": ghg}[goal]
    return of, (every[ok] @ of).min() if ok.any() else None, {tuple(x) for x in every[ok]}


def test_halves_against_all_plans(monkeypatch):
    monkeypatch.setattr(menu, "whole", None)  # the general search isn't asked
    for figures in menus(300, 3):
        if not figures[1].any():
            continue
        for goal, cut in GOALS:
            of, want, allowed = best(figures, goal, cut)
            if want is None:
                with pytest.raises(InfeasibleScenario):
                    menu.Menu(*figures).plan(goal, cut)
            else:
                x = menu.Menu(*figures).plan(goal, cut)
                assert tuple(x) in allowed and of @ x == pytest.approx(want, abs=1e-9)


def test_a_hard_menu_needs_no_branches(monkeypatch):
    """It took some hundred branches and sweeps, the better part of a second; the best values are those of that search."""
    freq, cost, green, ghg = HARD
    dishes = pd.DataFrame({"baseline_freq": freq, "cost": cost, "sus_cost": np.array(cost) * green, "ghg": ghg})
    goals = [("cost", 0.0, "cost"), ("sustainable", 0.0, "sus_cost"), ("ghg", 0.02, "ghg")]
    slow = menu.Menu.of(dishes)
    slow.halves = None
    want = [slow.plan(goal, cut) @ dishes[of] for goal, cut, of in goals]
    monkeypatch.setattr(menu, "whole", None)
    assert [menu.plan(dishes, goal, cut=cut) @ dishes[of] for goal, cut, of in goals] == want


def test_other_menus_are_left_to_the_general_search():
    x0 = np.array([4.0, 6.0, 5.0])
    for cost, green in (([1.5, 2.0, 3.0], [1.0, 0, 3.0]), ([np.pi, 2.0, 3.0], [0, 2.0, 0]), ([np.nan, 2.0, 3.0], [0, 2.0, 0])):
        assert menu.Menu(x0, np.array(cost), np.array(green), np.ones(3), np.ceil(x0 / 2), np.floor(x0 * 1.5)).halves is None


def test_all_plans_at_once():
    """Each menu was searched by itself, some milliseconds each."""
    done = 0
    rows = list(menus(300, 4))
    for n in range(1, 6):
        some = [m for m in rows if len(m[0]) == n]
        fits, freq = menu.all_plans(*map(np.stack, zip(*some)), GOALS, at_once=200)
        for i, figures in enumerate(some):
            assert fits[i] == ((figures[1] * 8 % 1 == 0) & (figures[3] * 8 % 1 == 0)).all()
            for g, (goal, cut) in enumerate(GOALS if fits[i] else []):
                of, want, allowed = best(figures, goal, cut)
                assert np.isnan(freq[g, i]).all() if want is None else tuple(freq[g, i]) in allowed and of @ freq[g, i] == want
                done += 1
    assert done > 500
    assert not menu.all_plans(*(np.array([v]) for v in ([30.0] * 9, [1.0] * 9, [0.0] * 9, [1.0] * 9, [15.0] * 9, [45.0] * 9)), GOALS)[0].any()


def test_menus_go_on_in_the_next_batch(spark):
    """Batches cut menus anywhere; a null hall is a menu of its own."""
    rng = np.random.default_rng(6)
    rows = [(None if h == 3 else h, f"d{i:02}", int(rng.integers(1, 12)), c, c * (i % 2), float(rng.integers(1, 30)) / 8) for h in range(9) for i, c in enumerate((rng.integers(4, 40, (2, 5, 9)[h % 3]) / 4).tolist())]
    dishes = spark.createDataFrame(rows, "hall int, ingredient string, baseline_freq int, cost double, sus_cost double, ghg double")
    goals = {"a": ("cost", 0.0), "b": ("ghg", 0.02)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
        got = menu.plans(dishes, ["hall"], goals).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 2 * len(rows) and got["hall"].isna().sum() == 4
    every = pd.DataFrame(rows, columns=dishes.columns)
    for h, one in every.fillna({"hall": -1}).groupby("hall"):
        for name, (goal, cut) in goals.items():
            mine = got[(got["hall"].fillna(-1) == h) & (got["scenario"] == name)].sort_values("ingredient")
            of = one["cost" if goal == "cost" else "ghg"].to_numpy()
            try:
                want = menu.plan(one, goal, cut=cut) @ of
            except InfeasibleScenario:
                assert (mine["status"] == "infeasible").all() and mine["freq"].isna().all()
                continue
            assert (mine["status"] == "optimal").all() and mine["ingredient"].tolist() == one["ingredient"].tolist() and mine["freq"].to_numpy() @ of == want


def test_plans_of_the_details_are_searched_once(spark):
    """The sort reads its rows twice, to find its ranges; plans were searched each time."""
    from provender.plans import scenarios

    plan = scenarios.menu_deliverable_details(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "Sort" in plan
