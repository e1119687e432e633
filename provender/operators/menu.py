"""Menus of dishes: ingredient summaries, whole-number plans, and their reports."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provender.operators.halves import Halves, all_plans
from provender.operators.simplex import InfeasibleScenario, Search, whole

# Fixed value: the portion of a new dish of this category, pounds.
SOY_PORTION_LB = 0.25


def ingredient_summary(meals: DataFrame) -> DataFrame:
    """Per dish: appearances, the mean portion without missing ones, the first known category. meals: ord, ingredient, category, portion_lb."""
    rows = meals.where(F.trim("ingredient") != "").withColumn("ingredient", F.trim("ingredient"))
    return rows.groupBy("ingredient").agg(F.count("*").alias("baseline_freq"), F.avg("portion_lb").alias("portion_lb"), F.min_by("category", F.when(F.col("category").isNotNull(), F.col("ord"))).alias("category"))


def with_prices(summary: DataFrame, prices: DataFrame, ghg: DataFrame) -> DataFrame:
    """Prices by dish and emissions by category, the first row of a key; the category falls back to the prices' own."""
    one = prices.groupBy("ingredient").agg(*(F.min_by(c, "ord").alias(c if c != "category" else "_pc") for c in ("category", "default_sus", "conventional_price_lb", "sustainable_price_lb")))
    factor = ghg.groupBy(F.lower("meat_type").alias("_g")).agg(F.min_by("factor", "ord").alias("ghg_per_lb"))
    out = summary.join(one, "ingredient", "left").withColumn("category", F.coalesce("category", "_pc")).drop("_pc")
    return out.join(factor, F.lower("category") == F.col("_g"), "left").drop("_g")


def metrics(dishes: DataFrame) -> DataFrame:
    """Price, cost, sustainable cost and emissions of one appearance; the dish's name without its category."""
    sus = F.lower(F.trim("default_sus")) == "yes"
    price = F.when(sus, F.col("sustainable_price_lb")).otherwise(F.col("conventional_price_lb"))
    cost = price * F.col("portion_lb")
    short = F.trim(F.regexp_replace(F.col("ingredient"), F.concat(F.lit("(?i)"), F.col("category")), F.lit("")))
    return dishes.withColumns({"price_lb": price, "cost": cost, "sus_cost": F.when(sus, cost).otherwise(0.0), "ghg": F.col("ghg_per_lb") * F.col("portion_lb"), "short_name": F.coalesce(short, F.col("ingredient"))})


def missing_inputs(dishes: DataFrame) -> DataFrame:
    """Dishes that can't be planned, for lack of a price, portion or factor."""
    return dishes.where("portion_lb is null or ghg_per_lb is null or (lower(trim(default_sus)) = 'yes' and sustainable_price_lb is null) or (coalesce(lower(trim(default_sus)), '') <> 'yes' and conventional_price_lb is null)")


def plan(dishes: pd.DataFrame, goal: str, *, cut: float = 0.0, low: float = 0.5, high: float = 1.5, gap: float = 1e-6, most: int | None = None, search: Search | None = None) -> np.ndarray | None:
    """Appearances of each dish as whole numbers with their sum fixed, each within its band; a dish with a ``cap`` is new and may
    appear from never up to its cap.

    Goals: 'cost' keeps the sustainable spend; 'sustainable' keeps the cost, less a cut; 'ghg' has the least emissions among
    the plans of the most sustainable spend. A plan counts as the best if none is better by more than ``gap`` (a millionth) of today's
    figure. The search runs to its proof; ``most`` branches stop it only where that is asked for, and ``search`` then says how it
    ended. None if it was stopped without a plan.
    """
    return Menu.of(dishes, low, high).plan(goal, cut, gap, most, search)


class Menu:
    """The figures of one menu's dishes, for one goal after the other."""

    def __init__(self, x0, cost, green, ghg, low, high):
        self.figures = (x0, cost, green, ghg, low, high)
        self.x0, self.cost, self.green, self.ghg, self.low, self.high = self.figures

    @staticmethod
    def of(dishes: pd.DataFrame, low: float = 0.5, high: float = 1.5) -> Menu:
        x0, cost, green, ghg = (dishes[c].to_numpy(float) for c in ("baseline_freq", "cost", "sus_cost", "ghg"))
        cap = dishes["cap"].to_numpy(float) if "cap" in dishes else np.full(len(x0), np.nan)
        return Menu(x0, cost, green, ghg, np.where(np.isnan(cap), np.ceil(x0 * low), 0.0), np.where(np.isnan(cap), np.floor(x0 * high), np.nan_to_num(cap)))

    @functools.cached_property
    def halves(self) -> Halves | None:
        return Halves.of(self.cost, self.green, self.low, self.high, float(self.x0.sum()))

    def _best_of(self, of, rows, gap, most, search, start=None):
        a, row_low, row_high = zip((np.ones(len(self.x0)), self.x0.sum(), self.x0.sum()), *rows)
        return whole(of, np.array(a), np.array(row_low), np.array(row_high), self.low, self.high, most=most, gap=gap * abs(of @ self.x0), search=search, start=start)

    def plan(self, goal: str, cut: float, gap: float = 1e-6, most: int | None = None, search: Search | None = None) -> np.ndarray | None:
        x0, cost, green, search = self.x0, self.cost, self.green, search or Search()
        halves = self.halves if most is None else None
        if goal == "cost":
            return halves.cheapest(green @ x0) if halves else self._best_of(cost, [(green, green @ x0, math.inf)], gap, most, search)
        limit = cost @ x0 * (1 - cut)
        if halves and goal == "ghg":
            out = halves.cleanest(limit, self.ghg)
            if out is not None:
                return out
        best = halves.greenest(limit) if halves else self._best_of(-green, [(cost, -math.inf, limit)], gap, most, search)
        if goal == "sustainable" or best is None:
            return best
        first = search.status
        out = self._best_of(self.ghg, [(cost, -math.inf, limit), (green, green @ best - 1e-6, math.inf)], gap, most, search, best)
        if out is None:  # the plan of the first step is one of the second's
            search.status = "feasible"
            return best
        if first != "optimal":
            search.status = first
        return out


def with_new_dish(dishes: DataFrame, scope: list[str], name: str, category: str, *, conventional_price_lb: float, sustainable_price_lb: float, cap: int, ghg: DataFrame, default_sus: str = "Yes") -> tuple[DataFrame, DataFrame]:
    """(dishes with a new one on every menu, scopes that can't have it). A dish that isn't served yet has no portion of its own:
    it takes the mean portion of its category on that menu, Soy a fixed one, and its category's emissions a pound from ``ghg``
    (category, ghg_per_lb). A menu without a dish of the category can't be planned with it.
    """
    factor = ghg.where(F.col("category") == category).select("ghg_per_lb").first()
    if factor is None or factor[0] is None:
        raise ValueError(f"no emissions are known for {category!r}")
    own = F.avg(F.when(F.col("category") == category, F.col("portion_lb")))
    menus = dishes.groupBy(*scope).agg((F.lit(SOY_PORTION_LB) if category == "Soy" else own).alias("portion_lb"))
    new = menus.where("portion_lb is not null").select(*scope, F.lit(name).alias("ingredient"), F.lit(category).alias("category"), F.lit(0).alias("baseline_freq"), F.lit(default_sus).alias("default_sus"), "portion_lb", F.lit(float(conventional_price_lb)).alias("conventional_price_lb"), F.lit(float(sustainable_price_lb)).alias("sustainable_price_lb"), F.lit(float(factor[0])).alias("ghg_per_lb"), F.lit(float(cap)).alias("cap"))
    old = dishes.select(*scope, "ingredient", "category", F.col("baseline_freq").cast("int").alias("baseline_freq"), "default_sus", "portion_lb", "conventional_price_lb", "sustainable_price_lb", "ghg_per_lb", F.lit(None).cast("double").alias("cap"))
    return metrics(old.join(new.select(*scope), scope, "left_semi").unionByName(new)), menus.where("portion_lb is null").select(*scope)


def plans(dishes: DataFrame, scope: list[str], goals: dict[str, tuple[str, float]]) -> DataFrame:
    """(scope, ingredient, scenario, freq, status): every goal for every menu of some dozen dishes. Menus go through a task one after the
    other, those of few plans many at once.

    Status 'optimal' is proven, 'feasible' a plan that the search ended with before its proof, 'infeasible' a proof that
    there is none, 'unfinished' neither; the last two have null frequencies.
    """
    kinds = {f.name: f.dataType.simpleString() for f in dishes.schema}

    def starts(rows: pd.DataFrame) -> np.ndarray:
        keys = rows[scope]
        other = (keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())).any(axis=1).to_numpy()
        other[0] = True
        return np.flatnonzero(other)

    def solved(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        size = np.diff(np.append(first, len(rows)))
        whole_table, freq, status = Menu.of(rows), np.full((len(goals), len(rows)), np.nan), np.full((len(goals), len(first)), "optimal", object)
        for n in np.unique(size):
            menus = np.flatnonzero(size == n)
            at = first[menus][:, None] + np.arange(n)
            fits, best = all_plans(*(f[at] for f in whole_table.figures), list(goals.values()))
            freq[:, at[fits]] = best[:, fits]
            status[:, menus[fits]] = np.where(np.isnan(best[:, fits, 0]), "infeasible", "optimal")
            for m, i in zip(menus[~fits], at[~fits, 0]):
                one = Menu(*(f[i : i + n] for f in whole_table.figures))
                for g, (goal, cut) in enumerate(goals.values()):
                    search = Search()
                    try:
                        found = one.plan(goal, cut, search=search)
                    except InfeasibleScenario:
                        found, search.status = None, "infeasible"
                    if found is not None:
                        freq[g, i : i + n] = found
                    status[g, m] = search.status
        out = {c: np.tile(rows[c].to_numpy(), len(goals)) for c in [*scope, "ingredient"]}
        return pd.DataFrame({**out, "scenario": np.repeat(list(goals), len(rows)), "freq": freq.ravel(), "status": status.repeat(size, axis=1).ravel()})

    def run(batches):
        rest = None  # a menu may go on in the next batch
        for rows in batches:
            if not len(rows):
                continue
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            first = starts(rows)
            if len(first) > 1:
                yield solved(rows.iloc[: first[-1]], first[:-1])
            rest = rows.iloc[first[-1] :]
        if rest is not None:
            yield solved(rest, np.zeros(1, int))

    # groups are small but their work isn't, so they are not left to be drawn together by size. The exchange goes by a column of its own:
    # one by the scope is left out over inputs that seem to have it, and joins changed at run time then cut menus
    tasks = int(dishes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    menus = dishes.withColumn("_menu", F.xxhash64(*scope)).repartition(tasks, "_menu").sortWithinPartitions(*scope, "ingredient").drop("_menu")
    return menus.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in scope) + ", ingredient string, scenario string, freq double, status string")


def contributions(dishes: DataFrame, freq: DataFrame) -> DataFrame:
    """A row for each scenario and dish, the baseline first: frequency, cost, sustainable and conventional spend, emissions."""
    base = dishes.select("ingredient", "category", F.lit("baseline").alias("scenario"), F.lit(0).alias("scenario_ord"), F.col("baseline_freq").cast("double").alias("freq"), "baseline_freq", "cost", "sus_cost", "ghg")
    planned = freq.join(dishes.select("ingredient", "category", "baseline_freq", "cost", "sus_cost", "ghg"), "ingredient").select("ingredient", "category", "scenario", F.lit(1).alias("scenario_ord"), "freq", "baseline_freq", "cost", "sus_cost", "ghg")
    return base.unionByName(planned).withColumns({"total_cost": F.col("freq") * F.col("cost"), "sus_spend": F.col("freq") * F.col("sus_cost"), "total_ghg": F.col("freq") * F.col("ghg")})


def scenario_summary(rows: DataFrame) -> DataFrame:
    """Totals a scenario and their change against the baseline's."""
    r = lambda c: F.round(F.sum(c), 4).alias(c)
    sums = rows.groupBy("scenario", "scenario_ord").agg(F.round(F.sum("freq"), 4).alias("meals"), r("total_cost"), r("sus_spend"), r("total_ghg"))
    w = Window.orderBy("scenario_ord", "scenario").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    change = lambda c: F.round(F.try_divide(F.col(c) - F.first(c).over(w), F.nullif(F.first(c).over(w), F.lit(0.0))) * 100, 4)
    return sums.withColumns({"sus_pct": F.round(F.try_divide("sus_spend", F.nullif("total_cost", F.lit(0.0))), 6), "cost_pct_change": change("total_cost"), "sus_spend_pct_change": change("sus_spend"), "ghg_pct_change": change("total_ghg")}).drop("scenario_ord")


def category_frequency(rows: DataFrame) -> DataFrame:
    """Per scenario and category: meals before and after, shares of all, change in percent."""
    sums = rows.where("scenario_ord > 0").groupBy("scenario", "category").agg(F.sum("baseline_freq").cast("double").alias("baseline_meals"), F.sum("freq").alias("optimized_meals"))
    w = Window.partitionBy("scenario")
    return sums.withColumns({
        "change_meals": F.col("optimized_meals") - F.col("baseline_meals"),
        "baseline_share": F.round(F.try_divide("baseline_meals", F.sum("baseline_meals").over(w)), 6), "optimized_share": F.round(F.try_divide("optimized_meals", F.sum("optimized_meals").over(w)), 6),
        "pct_change_meals": F.round(F.try_divide(F.col("optimized_meals") - F.col("baseline_meals"), F.nullif("baseline_meals", F.lit(0.0))) * 100, 4),
    })


def category_sustainability(rows: DataFrame) -> DataFrame:
    s = lambda c: F.round(F.sum(c), 4)
    return rows.groupBy("scenario", "category").agg(s("sus_spend").alias("sustainable_spend"), s(F.col("total_cost") - F.col("sus_spend")).alias("conventional_spend"), s("total_cost").alias("cost"), s("total_ghg").alias("ghg")).withColumn("sus_pct", F.round(F.try_divide("sustainable_spend", F.nullif("cost", F.lit(0.0))), 6))


def indicator_counts(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n) of the 0/1 columns that are ever set."""
    long = wide.unpivot([], columns, "name", "flag")
    return long.groupBy("name").agg(F.sum(F.coalesce(F.col("flag"), F.lit(0))).alias("n")).where("n > 0")


def names_of(columns: list[str]):
    """The names of the 0/1 columns that a row has set, joined."""
    return F.array_join(F.filter(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in columns)), lambda x: x.isNotNull()), ", ")


def with_subcategory(rows: DataFrame, dictionary: DataFrame, item: str = "item") -> DataFrame:
    """rows with the sub-category that a dictionary (item, sub_category) gives an item, spaces and case aside; null where it has none.
    The first row of an item counts, by ``ord``."""
    key = F.lower(F.trim(item))
    one = dictionary.groupBy(key.alias("_k")).agg(F.min_by("sub_category", "ord").alias("sub_category"))
    return rows.join(one, key == F.col("_k"), "left").drop("_k")


def coverage(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).isNotNull().cast("double")), 6).alias("covered")).orderBy(F.desc("n"), key)


def extreme(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """The row of the largest value, one only."""
    return rows.orderBy(F.desc_nulls_last(by), tie).limit(1)


def narrative(summary: DataFrame) -> DataFrame:
    """(scenario, text): one sentence about each planned scenario."""
    return summary.where("scenario <> 'baseline'").select("scenario", F.format_string("%s: cost %+.1f%%, sustainable spend %+.1f%%, emissions %+.1f%%.", "scenario", "cost_pct_change", "sus_spend_pct_change", "ghg_pct_change").alias("text"))
