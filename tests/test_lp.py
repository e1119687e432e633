"""The solver: golden plans, invariants, whole numbers, infeasibility."""

import itertools

import numpy as np
import pandas as pd
import pytest

from provender.operators import lp, menu


def base(rows):
    cols = ["category", "food_group", "w", "sw", "cw", "sp", "cp"]
    df = pd.DataFrame(rows, columns=cols)
    return pd.DataFrame({"category": df.category, "food_group": df.food_group, "baseline_weight_lbs": df.w.astype(float), "baseline_spend": df.sw * df.sp.fillna(0) + df.cw * df.cp.fillna(0), "baseline_sustainable_spend": df.sw * df.sp.fillna(0), "sustainable_price_per_lb": df.sp.astype(float), "conventional_price_per_lb": df.cp.astype(float), "ghg_factor_kg_per_kg": [10.0] * len(df)})


def invariants(plan, bounds=(0.85, 1.15)):
    w, b = plan["optimized_weight_lbs"], plan["baseline_weight_lbs"]
    assert w.sum() == pytest.approx(b.sum())
    assert (w >= b * bounds[0] - 1e-6).all() and (w <= b * bounds[1] + 1e-6).all()


TWO = base([("beef", "protein", 200, 100, 100, 7.0, 5.0), ("chicken", "protein", 200, 100, 100, 2.5, 1.5)])


def test_min_spend_keeps_sustainability():
    plan = lp.scenario(TWO, "min_spend")
    invariants(plan)
    assert plan["optimized_sustainable_spend"].sum() >= TWO["baseline_sustainable_spend"].sum() - 1e-6
    assert plan["optimized_spend"].sum() < TWO["baseline_spend"].sum()
    assert dict(zip(plan["category"], plan["optimized_weight_lbs"].round(6))) == {"beef": 170.0, "chicken": 230.0}


def test_group_band_holds_the_cheap_group_back():
    three = base([("apples", "fruit", 100, 0, 100, None, 1.0), ("beef", "protein", 200, 0, 200, None, 5.0), ("chicken", "protein", 200, 0, 200, None, 2.0)])
    plan = lp.scenario(three, "min_spend").set_index("category")
    assert plan.loc["apples", "optimized_weight_lbs"] == pytest.approx(115)
    assert plan.loc[["beef", "chicken"], "optimized_weight_lbs"].sum() == pytest.approx(385)


def test_max_sustainable_and_cost_target():
    for name, target in (("max_sustainable", 0.0), ("cost_target", 0.05), ("threshold_third", 0.0)):
        plan = lp.scenario(TWO, name, target=target)
        invariants(plan)
        assert plan["optimized_spend"].sum() <= TWO["baseline_spend"].sum() * (1 - (target if name == "cost_target" else 0)) + 1e-6
        assert plan["optimized_sustainable_spend"].sum() >= TWO["baseline_sustainable_spend"].sum() - 1e-6 or name == "cost_target"


def test_hypothetical_item_and_errors():
    plan = lp.scenario(TWO, "hypothetical", item=lp.Item("chicken", 2.0, 50.0))
    assert plan.set_index("category").loc["chicken", "hypothetical_weight_lbs"] <= 50 + 1e-9
    cheap = lp.scenario(TWO, "hypothetical", item=lp.Item("chicken", 2.0, 5.0)).set_index("category")
    assert cheap.loc["chicken", "hypothetical_weight_lbs"] == pytest.approx(5)
    with pytest.raises(ValueError):
        lp.scenario(TWO, "hypothetical", item=lp.Item("fish", 1.0, 5.0))
    with pytest.raises(lp.InfeasibleScenario):
        lp.scenario(TWO, "cost_target", target=0.9)


def test_excluded_categories_carry_their_baseline():
    rows = pd.concat([TWO, base([("water", "drinks", 0, 0, 0, None, None)]).assign(baseline_spend=12.0)])
    plan = lp.scenario(rows, "max_sustainable").set_index("category")
    assert not plan.loc["water", "in_optimization"] and plan.loc["water", "optimized_spend"] == 12.0


def test_simplex_against_corners():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = 3, 4
        a, b, c = rng.integers(-3, 6, (m, n)).astype(float), rng.integers(1, 12, m).astype(float), rng.integers(-4, 5, n).astype(float)
        a, b = np.vstack([a, np.eye(n)]), np.append(b, [10.0] * n)
        planes = np.vstack([a, np.eye(n)])
        best = np.inf
        for k in itertools.combinations(range(len(planes)), n):
            try:
                x = np.linalg.solve(planes[list(k)], np.append(b, np.zeros(n))[list(k)])
            except np.linalg.LinAlgError:
                continue
            if (x >= -1e-9).all() and (a @ x <= b + 1e-9).all():
                best = min(best, c @ x)
        assert c @ lp.simplex(c, a, ["<="] * len(b), b) == pytest.approx(best, abs=1e-6)


def test_whole_number_menus_against_enumeration():
    dishes = pd.DataFrame({"baseline_freq": [4, 6, 5], "cost": [3.0, 1.0, 2.0], "sus_cost": [3.0, 0.0, 2.0], "ghg": [5.0, 1.0, 2.0]})
    x0, cost, green = (dishes[c].to_numpy(float) for c in ("baseline_freq", "cost", "sus_cost"))
    grid = [np.array(x) for x in itertools.product(*(range(int(np.ceil(f * 0.5)), int(np.floor(f * 1.5)) + 1) for f in x0)) if sum(x) == x0.sum()]
    assert cost @ menu.plan(dishes, "cost") == min(cost @ x for x in grid if green @ x >= green @ x0)
    top = max(green @ x for x in grid if cost @ x <= cost @ x0)
    assert green @ menu.plan(dishes, "sustainable") == top
    ghg = dishes["ghg"].to_numpy()
    assert ghg @ menu.plan(dishes, "ghg") == min(ghg @ x for x in grid if cost @ x <= cost @ x0 and green @ x >= top)


def test_menus_of_some_dozen_dishes_and_how_a_search_ends():
    rng = np.random.default_rng(3)
    n = 36
    dishes = pd.DataFrame({"baseline_freq": rng.integers(2, 40, n), "cost": rng.uniform(1, 9, n), "ghg": rng.uniform(1, 30, n)})
    dishes["sus_cost"] = dishes["cost"] * (np.arange(n) % 2)
    x0, cost, green = (dishes[c].to_numpy(float) for c in ("baseline_freq", "cost", "sus_cost"))
    for goal in ("cost", "sustainable", "ghg"):
        search = lp.Search()
        x = menu.plan(dishes, goal, cut=0.02, search=search)
        assert search.status in ("optimal", "feasible") and x is not None
        assert x.sum() == x0.sum() and (x == np.round(x)).all() and (x >= np.ceil(x0 * 0.5)).all() and (x <= np.floor(x0 * 1.5)).all()
        assert green @ x >= green @ x0 - 1e-6 if goal == "cost" else cost @ x <= cost @ x0 * 0.98 + 1e-6
    one = np.ones((1, 2))
    search = lp.Search()
    assert lp.whole_numbers(np.array([1.0, 2.0]), one, ["="], np.array([3.0]), most=0, search=search) is None and search.status == "unfinished"
    with pytest.raises(lp.InfeasibleScenario):
        lp.whole_numbers(np.array([1.0]), np.array([[2.0]]), ["="], np.array([3.0]))


def test_menu_plans_say_how_they_ended(spark):
    df = spark.createDataFrame([("h", "a", 4, 3.0, 3.0, 1.0), ("h", "b", 6, 1.0, 0.0, 2.0), ("none", "c", 1, 1.0, 1.0, 1.0)], "hall string, ingredient string, baseline_freq int, cost double, sus_cost double, ghg double")
    got = {(r.hall, r.ingredient): (r.freq, r.status) for r in menu.plans(df, ["hall"], {"s": ("sustainable", 0.9)}).collect()}
    assert got["none", "c"] == (None, "infeasible") and got["h", "a"][1] == "infeasible"
    got = {(r.hall, r.ingredient): (r.freq, r.status) for r in menu.plans(df, ["hall"], {"s": ("cost", 0.0)}).collect()}
    assert got["h", "a"] == (4.0, "optimal") and got["none", "c"] == (1.0, "optimal")


def test_a_wrong_item_is_an_error_not_an_infeasible_plan():
    with pytest.raises(ValueError, match="no weight"):
        lp.scenario(TWO, "hypothetical", item=lp.Item("nowhere", 1.0, 5.0))


def test_one_scope_without_the_category_stops_no_other(spark):
    rows = [("x", r.category) + tuple(r)[1:] for r in TWO.itertuples(index=False)]
    cols = ["scope", "category", *TWO.columns[1:]]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=cols))
    other = df.where("category = 'beef'").replace("x", "y", "scope")
    got = {(r.scope, r.category): (r.status, r.hypothetical_weight_lbs) for r in lp.solve(df.unionByName(other), ["scope"], "hypothetical", item=lp.Item("chicken", 2.0, 5.0)).collect()}
    assert got["y", "beef"] == ("no_category", 0.0) and got["x", "chicken"] == ("optimal", 5.0)
    with pytest.raises(ValueError, match="no weight"):
        lp.solve(df, ["scope"], "hypothetical", item=lp.Item("nowhere", 1.0, 5.0))


def test_least_cost_follows_bands_of_groups():
    three = base([("apples", "fruit", 100, 0, 100, None, 1.0), ("beef", "protein", 200, 0, 200, None, 5.0), ("chicken", "protein", 200, 0, 200, None, 2.0)])
    plan = lp.scenario(three, "least_cost", bounds=(0.85, 1.15, 0.9, 1.04)).set_index("category")
    assert plan.loc["apples", "optimized_weight_lbs"] == pytest.approx(104) and plan.loc["beef", "optimized_weight_lbs"] == pytest.approx(170)
    with_item = lp.scenario(three, "least_cost", bounds=(0.85, 1.15, 0.9, 1.04), item=lp.Item("beef", 0.5, 20.0)).set_index("category")
    assert with_item.loc["beef", "hypothetical_weight_lbs"] == pytest.approx(20)


def test_a_new_dish(spark):
    rows = [("h", "a", "Beef", 4, "no", 0.5, 6.0, 8.0, 10.0), ("h", "b", "Soy", 6, "yes", 0.25, 2.0, 3.0, 1.0), ("k", "c", "Beef", 3, "no", 1.0, 6.0, 8.0, 10.0)]
    dishes = spark.createDataFrame(rows, "hall string, ingredient string, category string, baseline_freq int, default_sus string, portion_lb double, conventional_price_lb double, sustainable_price_lb double, ghg_per_lb double")
    ghg = spark.createDataFrame([("Soy", 1.0), ("Beef", 10.0), ("Fish", 4.0)], "category string, ghg_per_lb double")
    how = dict(conventional_price_lb=1.0, sustainable_price_lb=2.0, cap=3, ghg=ghg)
    out, without = menu.with_new_dish(dishes, ["hall"], "new", "Fish", **how)
    assert out.count() == 0 and without.count() == 2
    out, without = menu.with_new_dish(dishes, ["hall"], "new", "Soy", **how)
    new = {r.hall: r for r in out.where("ingredient = 'new'").collect()}
    assert without.count() == 0 and new["h"].portion_lb == 0.25 and new["k"].cost == 0.5
    out, _ = menu.with_new_dish(dishes, ["hall"], "new", "Beef", **how)
    assert {r.hall: r.portion_lb for r in out.where("ingredient = 'new'").collect()} == {"h": 0.5, "k": 1.0}
    found = {(r.hall, r.ingredient): r.freq for r in menu.plans(out, ["hall"], {"s": ("ghg", 0.07)}).collect()}
    assert 0 < found["h", "new"] <= 3 and found["h", "a"] + found["h", "b"] + found["h", "new"] == 10
    with pytest.raises(ValueError, match="no emissions"):
        menu.with_new_dish(dishes, ["hall"], "new", "Nothing", **how)
