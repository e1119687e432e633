"""Purchasing scenarios: linear programmes over category baselines, solved where each scope's few rows lie."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.operators.lineage import checkpointed
from provender.operators.simplex import EPS, InfeasibleScenario, Search, minimise, whole

KG_PER_LB = 0.45359237
LOWER, UPPER = 0.85, 1.15


@dataclass(frozen=True)
class Item:
    """A product that isn't bought yet: one more source for one category, up to a supply."""

    category: str
    price_per_lb: float
    max_weight_lbs: float
    is_sustainable: bool = True


class NoCategory(ValueError):
    """An item's category has no weight in the scope to compare it with."""


def _as_bounds(a: np.ndarray, kinds: list[str], b: np.ndarray):
    """Rows (<=, >=, =) over x >= 0 as (a, row_low, row_high, low, high); a row of one variable becomes a bound of it."""
    n = a.shape[1]
    low, high, rows = np.zeros(n), np.full(n, math.inf), []
    for row, k, v in zip(a, kinds, b):
        at = np.flatnonzero(row)
        if len(at) == 1 and row[at[0]] > 0:
            j, v = at[0], v / row[at[0]]
            low[j] = max(low[j], v) if k != "<=" else low[j]
            high[j] = min(high[j], v) if k != ">=" else high[j]
        else:
            rows.append((row, -math.inf if k == "<=" else v, math.inf if k == ">=" else v))
    far = 1e6 * max(1.0, float(np.abs(b).max(initial=0)))  # beyond any corner of rows whose factors are of one size
    grid = np.array([r[0] for r in rows]).reshape(-1, n)
    return grid, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), low, np.minimum(high, far), far


def simplex(cost: np.ndarray, a: np.ndarray, kinds: list[str], b: np.ndarray) -> np.ndarray:
    """Minimises cost @ x for x >= 0 under rows a @ x (<=, >=, =) b."""
    *parts, far = _as_bounds(a, kinds, b)
    x = minimise(cost, *parts)
    if (x >= far * (1 - EPS)).any():
        raise InfeasibleScenario("unbounded")
    return x


def whole_numbers(cost: np.ndarray, a: np.ndarray, kinds: list[str], b: np.ndarray, most: int | None = None, gap: float = 0.0, search: Search | None = None) -> np.ndarray | None:
    """The same over whole numbers; see simplex.whole for ``most``, ``gap`` and ``search``."""
    *parts, _ = _as_bounds(a, kinds, b)
    return whole(cost, *parts, most=most, gap=gap, search=search)


def _plan(base: pd.DataFrame, goal: str, cap: float | None, bounds, item: Item | None) -> pd.DataFrame:
    """One programme: goal 'cost' keeps the sustainable spend, 'least' keeps nothing, 'sustainable' keeps cost under cap.

    A category has a variable a channel; its band, its group's band and the total are bounds of a row each, a missing price and
    an item's supply are bounds of the variable.
    """
    rows = base[base["baseline_weight_lbs"] > 0].sort_values("category").reset_index(drop=True)
    n = len(rows)
    if item is not None and item.category not in set(rows["category"]):
        raise NoCategory(f"{item.category!r} has no weight to compare an item with")
    sus, conv = (rows[f"{k}_price_per_lb"].to_numpy(float) for k in ("sustainable", "conventional"))
    price = np.concatenate([np.nan_to_num(sus), np.nan_to_num(conv), [item.price_per_lb] if item else []])
    green = np.concatenate([np.nan_to_num(sus), np.zeros(n), [item.price_per_lb * item.is_sustainable] if item else []])
    of = np.hstack([np.eye(n), np.eye(n)])
    if item is not None:
        of = np.hstack([of, (rows["category"] == item.category).to_numpy(float)[:, None]])
    weight = rows["baseline_weight_lbs"].to_numpy(float)
    groups = [(of[g.index].sum(0), weight[g.index].sum()) for _, g in rows.groupby("food_group")]
    lines = [of.sum(0), *(g for g, _ in groups), *of]
    low = [weight.sum(), *(w * bounds[2] for _, w in groups), *(weight * bounds[0])]
    high = [weight.sum(), *(w * bounds[3] for _, w in groups), *(weight * bounds[1])]
    if goal == "cost":
        lines, low, high = [*lines, green], [*low, rows["baseline_sustainable_spend"].sum()], [*high, math.inf]
    elif goal == "sustainable":
        lines, low, high = [*lines, price], [*low, -math.inf], [*high, cap]
    most = np.where(np.isnan(np.concatenate([sus, conv])), 0.0, np.tile(weight * bounds[1], 2))  # no price: not bought
    most = np.append(most, [item.max_weight_lbs] if item else [])
    x = minimise(-green if goal == "sustainable" else price, np.array(lines), np.array(low, float), np.array(high, float), np.zeros(len(most)), most) if n else np.zeros(0)
    x = np.maximum(x, 0.0)
    adopted = np.where(rows["category"] == item.category, x[-1], 0.0) if item is not None else np.zeros(n)
    spend = adopted * item.price_per_lb if item is not None else adopted
    spent_sus = x[:n] * np.nan_to_num(sus) + (spend if item is not None and item.is_sustainable else 0)
    spent_conv = x[n : 2 * n] * np.nan_to_num(conv) + (spend if item is not None and not item.is_sustainable else 0)
    got = pd.DataFrame({"category": rows["category"], "w": x[:n] + x[n : 2 * n] + adopted, "s": spent_sus, "c": spent_conv, "hypothetical_weight_lbs": adopted})
    out = base.merge(got, on="category", how="left")
    inside = out["w"].notna()
    factor = out["ghg_factor_kg_per_kg"].astype(float).fillna(0)
    res = out[["category", "food_group", "baseline_weight_lbs", "baseline_spend", "baseline_sustainable_spend", "sustainable_price_per_lb", "conventional_price_per_lb"]].copy()
    res["optimized_weight_lbs"] = out["w"].where(inside, out["baseline_weight_lbs"])
    res["optimized_spend"] = (out["s"] + out["c"]).where(inside, out["baseline_spend"])
    res["optimized_sustainable_spend"] = out["s"].where(inside, out["baseline_sustainable_spend"])
    res["baseline_ghg_kg"] = out["baseline_weight_lbs"] * KG_PER_LB * factor
    res["optimized_ghg_kg"] = res["optimized_weight_lbs"] * KG_PER_LB * factor
    res["in_optimization"] = inside
    res["hypothetical_weight_lbs"] = out["hypothetical_weight_lbs"].fillna(0.0)
    found = ["optimized_weight_lbs", "optimized_spend", "optimized_sustainable_spend", "baseline_ghg_kg", "optimized_ghg_kg", "hypothetical_weight_lbs"]
    res[found] = res[found].astype(float).round(6)  # what is beyond is the solver's rounding
    return res


def scenario(base: pd.DataFrame, name: str, *, target: float = 0.0, bounds=(LOWER, UPPER, LOWER, UPPER), item: Item | None = None) -> pd.DataFrame:
    """A scope's plan by name: least_cost, min_spend, max_sustainable, cost_target, threshold_third, hypothetical."""
    optimised = base[base["baseline_weight_lbs"] > 0]
    spend = float(optimised["baseline_spend"].sum())
    if name in ("min_spend", "least_cost"):
        return _plan(base, "cost" if name == "min_spend" else "least", None, bounds, item if name == "least_cost" else None)
    if name == "threshold_third":
        first = _plan(base, "cost", None, bounds, None)
        before, after = first["baseline_spend"].sum(), first["optimized_spend"].sum()
        target = max(100 * (before - after) / before, 0.0) / 3 / 100 if before else 0.0
    return _plan(base, "sustainable", spend * (1 - (0 if name == "max_sustainable" else target)), bounds, item if name == "hypothetical" else None)


FIELDS = ["category string", "food_group string", "baseline_weight_lbs double", "baseline_spend double", "baseline_sustainable_spend double", "sustainable_price_per_lb double", "conventional_price_per_lb double", "optimized_weight_lbs double", "optimized_spend double", "optimized_sustainable_spend double", "baseline_ghg_kg double", "optimized_ghg_kg double", "in_optimization boolean", "hypothetical_weight_lbs double", "status string"]


def solve(baseline: DataFrame, scope: list[str], name: str, *, target: float = 0.0, bounds=(LOWER, UPPER, LOWER, UPPER), item: Item | None = None) -> DataFrame:
    """The scenario of every scope, each in its own group of a few dozen category rows.

    A scope without a plan keeps its baseline with status 'infeasible', one where nothing of an item's category is bought with
    status 'no_category', so that none can stop the others. An item whose category no scope buys is an error.
    """
    needed = ["category", "food_group", "baseline_weight_lbs", "baseline_spend", "baseline_sustainable_spend", "sustainable_price_per_lb", "conventional_price_per_lb", "ghg_factor_kg_per_kg"]
    baseline = baseline.select(*scope, *needed)
    if item is not None:
        baseline = checkpointed(baseline)
        if baseline.where((F.col("category") == item.category) & (F.col("baseline_weight_lbs") > 0)).isEmpty():
            raise NoCategory(f"{item.category!r} has no weight in any scope")
    kinds = {f.name: f.dataType.simpleString() for f in baseline.schema}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = scenario(rows, name, target=target, bounds=bounds, item=item).assign(status="optimal")
        except (InfeasibleScenario, NoCategory) as e:
            out = rows.assign(optimized_weight_lbs=rows["baseline_weight_lbs"], optimized_spend=rows["baseline_spend"], optimized_sustainable_spend=rows["baseline_sustainable_spend"], baseline_ghg_kg=0.0, optimized_ghg_kg=0.0, in_optimization=False, hypothetical_weight_lbs=0.0, status="no_category" if isinstance(e, NoCategory) else "infeasible")
        for c in scope:
            out[c] = rows[c].iloc[0]
        return out[[*scope, *(f.split(" ")[0] for f in FIELDS)]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in scope), *FIELDS])
    tasks = int(baseline.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plans = baseline.repartition(tasks, *scope).groupBy(*scope).applyInPandas(one, schema)
    return with_shares(plans)


def with_shares(plans: DataFrame) -> DataFrame:
    share = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0))) * 100
    return plans.withColumns({
        "weight_pct_change": share(F.col("optimized_weight_lbs") - F.col("baseline_weight_lbs"), F.col("baseline_weight_lbs")),
        "baseline_sustainable_pct": share(F.col("baseline_sustainable_spend"), F.col("baseline_spend")),
        "optimized_sustainable_pct": share(F.col("optimized_sustainable_spend"), F.col("optimized_spend")),
    })


def money(value: Column | str) -> Column:
    """An exact sum of amounts of six places, so that the order of rows can't decide how a total is rounded."""
    return F.sum((F.col(value) if isinstance(value, str) else value).cast("decimal(28,6)"))


def totals(plans: DataFrame, scope: list[str]) -> DataFrame:
    """Each scope's totals and their change in percent."""
    names = {"spend": "cost", "sustainable_spend": "sustainable_spend", "ghg_kg": "ghg_kg", "weight_lbs": "total_weight_lbs"}
    sums = plans.groupBy(*scope).agg(*(money(f"{when}_{c}").cast("double").alias(f"{when}_{n}") for c, n in names.items() for when in ("baseline", "optimized")), F.first("status").alias("status"))
    change = {f"{n}_pct_change": F.try_divide(F.col(f"optimized_{n}") - F.col(f"baseline_{n}"), F.nullif(f"baseline_{n}", F.lit(0.0))) * 100 for n in names.values()}
    return sums.withColumns(change)


def movers(plans: DataFrame, scope: list[str], least_share: float = 0.01) -> DataFrame:
    """Categories whose sustainable share moved, with the price ratio that explains it; the largest gains first."""
    spend = F.sum("baseline_spend").over(Window.partitionBy(*scope))
    ok = F.col("in_optimization") & F.col("sustainable_price_per_lb").isNotNull() & F.col("conventional_price_per_lb").isNotNull() & (F.col("baseline_spend") >= F.col("_all") * least_share)
    out = plans.withColumn("_all", spend).where(ok)
    ratio = F.try_divide("sustainable_price_per_lb", "conventional_price_per_lb")
    out = out.withColumns({"delta_pts": F.col("optimized_sustainable_pct") - F.col("baseline_sustainable_pct"), "price_ratio_sus_to_conv": ratio, "cost_neutral_or_better": ratio <= 1.0})
    return out.select(*scope, "category", "food_group", "baseline_spend", "baseline_sustainable_pct", "optimized_sustainable_pct", "delta_pts", "price_ratio_sus_to_conv", "cost_neutral_or_better").orderBy(*scope, F.desc("delta_pts"), "category")


def greedy_min_cost(baseline: DataFrame, scope: list[str], low: float = LOWER, high: float = UPPER) -> DataFrame:
    """The cheapest plan under category bands and a fixed total alone, in closed form: all at the lower bound, then the cheapest
    filled up first. No solver; a window over a scope's few categories."""
    price = F.least("sustainable_price_per_lb", "conventional_price_per_lb")
    rows = baseline.where("baseline_weight_lbs > 0").withColumn("price", price).where("price is not null")
    order = Window.partitionBy(*scope).orderBy("price", "category")
    spare = F.sum("baseline_weight_lbs").over(Window.partitionBy(*scope)) * (1 - low)
    before = F.coalesce(F.sum("baseline_weight_lbs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) * (high - low)
    room = F.col("baseline_weight_lbs") * (high - low)
    return rows.withColumn("optimized_weight_lbs", F.round(F.col("baseline_weight_lbs") * low + F.greatest(F.lit(0.0), F.least(room, spare - before)), 3)).select(*scope, "category", "optimized_weight_lbs")


def long_form(plans: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, food_group, stage, spend_type, spend) for charts; spend is a decimal, summed exactly."""
    sums = plans.groupBy(*scope, "food_group").agg(*(money(f"{w}_spend").alias(f"{w}_all") for w in ("baseline", "optimized")), *(money(f"{w}_sustainable_spend").alias(f"{w}_sus") for w in ("baseline", "optimized")))
    cells = F.array(*(F.struct(F.lit(w).alias("stage"), F.lit(k).alias("spend_type"), v.alias("spend")) for w in ("baseline", "optimized") for k, v in (("sustainable", F.col(f"{w}_sus")), ("conventional", F.col(f"{w}_all") - F.col(f"{w}_sus")))))
    return sums.select(*scope, "food_group", F.explode(cells).alias("c")).select(*scope, "food_group", "c.*")
