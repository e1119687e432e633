"""Queries of scenarios, menus and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from provender.operators import deliverable, lp, menu, report
from provender.operators.lineage import checkpointed
from provender.plans import aggregates as agg
from provender.plans.base import query

SCOPE = agg.SCOPE


def _base(spark, d):
    return agg.base(spark, d)


def _rounded(plans):
    return plans.select(*(F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in plans.dtypes))


@query(f"""{agg.B}, g AS (SELECT campus, fiscal_year, category, baseline_weight_lbs AS w, least(sustainable_price_per_lb, conventional_price_per_lb) AS price FROM base WHERE baseline_weight_lbs > 0),
o AS (SELECT *, sum(w) OVER (PARTITION BY campus, fiscal_year) * (1 - 0.85::DOUBLE) AS spare, coalesce(sum(w) OVER (PARTITION BY campus, fiscal_year ORDER BY price, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (1.15::DOUBLE - 0.85::DOUBLE) AS before FROM g WHERE price IS NOT NULL)
SELECT campus, fiscal_year, category, round(w * 0.85::DOUBLE + greatest(0.0, least(w * (1.15::DOUBLE - 0.85::DOUBLE), spare - before)), 3) AS optimized_weight_lbs FROM o""")
def lp_greedy_min_cost(spark, d):
    return lp.greedy_min_cost(_base(spark, d), SCOPE)


@query()
def lp_min_spend(spark, d):
    return _rounded(lp.solve(_base(spark, d), SCOPE, "min_spend"))


@query()
def lp_max_sustainable(spark, d):
    return _rounded(lp.solve(_base(spark, d), SCOPE, "max_sustainable"))


@query()
def lp_cost_target(spark, d):
    return _rounded(lp.solve(_base(spark, d), SCOPE, "cost_target", target=0.02))


@query()
def lp_threshold_third(spark, d):
    return _rounded(lp.totals(lp.solve(_base(spark, d), SCOPE, "threshold_third"), SCOPE))


@query()
def lp_hypothetical(spark, d):
    return _rounded(lp.solve(_base(spark, d), SCOPE, "hypothetical", item=lp.Item("ECONOMY", 900.0, 50.0)))


# ---- the programmes' best values by duality: one multiplier for the one row that isn't a band. With it fixed a category costs
# its cheaper channel and the bands are filled in order of cost (group bands of the same factors add nothing); the value is
# concave in the multiplier and linear between the points where two costs cross, so its best is at one of those
_CATS = """c AS (SELECT campus, fiscal_year, category, baseline_weight_lbs AS w, sustainable_price_per_lb AS ps, conventional_price_per_lb AS pc FROM base WHERE baseline_weight_lbs > 0),
sc AS (SELECT campus, fiscal_year, sum(baseline_sustainable_spend) AS need, sum(baseline_spend) AS spent FROM base WHERE baseline_weight_lbs > 0 GROUP BY ALL)"""


#: Amounts are often halves of a cent times a band's factor, so they may lie right between two tenths: places beyond the fourth
#: are the rounding of doubles and go first, so that the last bit of a sum can't decide.
_ONE_PLACE = "CAST(round(CAST({0} AS DECIMAL(38,4)), 1) AS DOUBLE)"


def _one_place(value):
    return F.round(value.cast("decimal(38,4)"), 1).cast("double")


def _dual(fixed, crossing, unit, order, free, best, wrong):
    return f"""{agg.B}, {_CATS}, lam AS (SELECT DISTINCT * FROM (SELECT campus, fiscal_year, unnest([{fixed}]) AS l FROM sc UNION ALL SELECT a.campus, a.fiscal_year, {crossing} FROM c a JOIN c b USING (campus, fiscal_year)) WHERE l >= 0 AND isfinite(l)),
ends AS (SELECT campus, fiscal_year, max(l) AS top FROM lam GROUP BY ALL), pts AS (SELECT * FROM lam UNION ALL SELECT campus, fiscal_year, 2 * top + 1 FROM ends),
k AS (SELECT c.*, l, {unit} AS cost FROM c JOIN pts USING (campus, fiscal_year)),
g AS (SELECT *, sum(w) OVER (PARTITION BY campus, fiscal_year, l) * 0.15::DOUBLE AS spare, coalesce(sum(w * 0.3::DOUBLE) OVER (PARTITION BY campus, fiscal_year, l ORDER BY cost {order}, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
dual AS (SELECT campus, fiscal_year, l, any_value({free}) + sum(cost * (w * 0.85::DOUBLE + greatest(0.0::DOUBLE, least(w * 0.3::DOUBLE, spare - before)))) AS v FROM g JOIN sc USING (campus, fiscal_year) GROUP BY ALL),
sides AS (SELECT campus, fiscal_year, {best}(v) FILTER (l <= top) AS v, {best}(v) FILTER (l > top) AS beyond FROM dual JOIN ends USING (campus, fiscal_year) GROUP BY ALL)
SELECT campus, fiscal_year, CASE WHEN {wrong} THEN 'infeasible' ELSE 'optimal' END AS status, CASE WHEN NOT ({wrong}) THEN {_ONE_PLACE.format('v')} END AS value FROM sides"""


CHEAPEST_SQL = _dual("0.0::DOUBLE, 1.0::DOUBLE", "1 - b.pc / nullif(a.ps, 0)", "least(pc, ps * (1 - l))", "", "l * need", "max", "beyond > v + 1e-6 * abs(v)")
GREENEST_SQL = _dual("0.0::DOUBLE, 1.0::DOUBLE", "a.ps / nullif(a.ps - b.pc, 0)", "greatest(ps * (1 - l), -l * pc)", "DESC", "l * spent", "min", "beyond < v - 1e-6 * abs(v)")


def _value(plans, column):
    total = _one_place(lp.money(F.when(F.col("in_optimization"), F.col(column))))
    return plans.groupBy(*SCOPE).agg(F.first("status").alias("status"), total.alias("value")).withColumn("value", F.when(F.col("status") == "optimal", F.col("value")))


@query(CHEAPEST_SQL)
def lp_min_spend_value(spark, d):
    return _value(lp.solve(_base(spark, d), SCOPE, "min_spend"), "optimized_spend")


@query(GREENEST_SQL)
def lp_max_sustainable_value(spark, d):
    return _value(lp.solve(_base(spark, d), SCOPE, "max_sustainable"), "optimized_sustainable_spend")


@query(GREENEST_SQL.replace("l * spent", "l * spent * (1 - 0.02::DOUBLE)"))
def lp_cost_target_value(spark, d):
    return _value(lp.solve(_base(spark, d), SCOPE, "cost_target", target=0.02), "optimized_sustainable_spend")


# ---- group bands tighter than the categories' own, so that they bind. For one multiplier the cheapest plan is filled in by steps:
# each group's least from its cheapest rows, then the cheapest rows of all groups up to each group's most
TIGHT = (0.85, 1.15, 0.97, 1.04)


def _filled(keys, order=""):
    """``filled``: the rows of ``seg`` (keys, food_group, category, w, lo, room, cost) with the weight x that the best plan gives them."""
    by = f"ORDER BY cost {order}, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""gr AS (SELECT {keys}, food_group, sum(w) AS gw, sum(lo) AS glo FROM seg GROUP BY ALL),
f1 AS (SELECT seg.*, greatest(gw * 0.97::DOUBLE - glo, 0) AS owed, gw * 1.04::DOUBLE - glo - greatest(gw * 0.97::DOUBLE - glo, 0) AS more, coalesce(sum(room) OVER (PARTITION BY {keys}, food_group {by}), 0) AS b1 FROM seg JOIN gr USING ({keys}, food_group)),
f2 AS (SELECT *, greatest(0.0::DOUBLE, least(room, owed - b1)) AS a1 FROM f1),
f3 AS (SELECT *, coalesce(sum(room - a1) OVER (PARTITION BY {keys}, food_group {by}), 0) AS b2 FROM f2),
f4 AS (SELECT *, greatest(0.0::DOUBLE, least(room - a1, more - b2)) AS most FROM f3),
f5 AS (SELECT *, coalesce(sum(most) OVER (PARTITION BY {keys} {by}), 0) AS b3, sum(w - lo - a1) OVER (PARTITION BY {keys}) AS spare FROM f4),
filled AS (SELECT *, lo + a1 + greatest(0.0::DOUBLE, least(most, spare - b3)) AS x FROM f5)"""


def _grouped(fixed, crossing, unit, order, free, best, wrong):
    return f"""{agg.B}, {_CATS.replace('category, baseline_weight_lbs', 'category, food_group, baseline_weight_lbs')}, lam AS (SELECT DISTINCT * FROM (SELECT campus, fiscal_year, unnest([{fixed}]) AS l FROM sc UNION ALL SELECT a.campus, a.fiscal_year, {crossing} FROM c a JOIN c b USING (campus, fiscal_year)) WHERE l >= 0 AND isfinite(l)),
ends AS (SELECT campus, fiscal_year, max(l) AS top FROM lam GROUP BY ALL), pts AS (SELECT * FROM lam UNION ALL SELECT campus, fiscal_year, 2 * top + 1 FROM ends),
seg AS (SELECT campus, fiscal_year, l, food_group, category, w, w * 0.85::DOUBLE AS lo, w * 0.3::DOUBLE AS room, {unit} AS cost FROM c JOIN pts USING (campus, fiscal_year)), {_filled('campus, fiscal_year, l', order)},
dual AS (SELECT campus, fiscal_year, l, any_value({free}) + sum(cost * x) AS v FROM filled JOIN sc USING (campus, fiscal_year) GROUP BY ALL),
sides AS (SELECT campus, fiscal_year, {best}(v) FILTER (l <= top) AS v, {best}(v) FILTER (l > top) AS beyond FROM dual JOIN ends USING (campus, fiscal_year) GROUP BY ALL)
SELECT campus, fiscal_year, CASE WHEN {wrong} THEN 'infeasible' ELSE 'optimal' END AS status, CASE WHEN NOT ({wrong}) THEN {_ONE_PLACE.format('v')} END AS value FROM sides"""


@query(_grouped("0.0::DOUBLE, 1.0::DOUBLE", "1 - b.pc / nullif(a.ps, 0)", "least(pc, ps * (1 - l))", "", "l * need", "max", "beyond > v + 1e-6 * abs(v)"))
def lp_grouped_min_spend_value(spark, d):
    return _value(lp.solve(_base(spark, d), SCOPE, "min_spend", bounds=TIGHT), "optimized_spend")


@query(_grouped("0.0::DOUBLE, 1.0::DOUBLE", "a.ps / nullif(a.ps - b.pc, 0)", "greatest(ps * (1 - l), -l * pc)", "DESC", "l * spent", "min", "beyond < v - 1e-6 * abs(v)"))
def lp_grouped_max_sustainable_value(spark, d):
    return _value(lp.solve(_base(spark, d), SCOPE, "max_sustainable", bounds=TIGHT), "optimized_sustainable_spend")


# ---- the solved plan that the reports are about: the least cost within the bands, each category from its cheaper channel, and
# with it an item that isn't bought yet, as one more and limited source of a category
ITEM = lp.Item("ECONOMY", 1200.0, 400.0)
PLAN_SQL = f"""{agg.B}, own AS (SELECT *, baseline_weight_lbs AS bw, least(sustainable_price_per_lb, conventional_price_per_lb) AS price, coalesce(sustainable_price_per_lb < conventional_price_per_lb, conventional_price_per_lb IS NULL) AS green FROM base WHERE baseline_weight_lbs > 0),
seg AS (SELECT campus, fiscal_year, food_group, category, bw AS w, bw * 0.85::DOUBLE AS lo, bw * 0.3::DOUBLE AS room, price AS cost FROM own), {_filled('campus, fiscal_year')},
plan AS (SELECT b.campus, b.fiscal_year, b.category, b.food_group, b.baseline_spend, b.baseline_sustainable_spend, b.baseline_weight_lbs, b.sustainable_price_per_lb, b.conventional_price_per_lb, x IS NOT NULL AS in_optimization, round(coalesce(x, b.baseline_weight_lbs), 6) AS optimized_weight_lbs,
  round(coalesce(x * price, b.baseline_spend), 6) AS optimized_spend, round(CASE WHEN x IS NULL THEN b.baseline_sustainable_spend WHEN green THEN x * price ELSE 0 END, 6) AS optimized_sustainable_spend
  FROM base b LEFT JOIN filled f USING (campus, fiscal_year, category) LEFT JOIN own o USING (campus, fiscal_year, category))"""


def _solved(spark, d):
    return lp.solve(_base(spark, d), SCOPE, "least_cost", bounds=TIGHT)


@query(f"{PLAN_SQL} SELECT campus, fiscal_year, category, food_group, in_optimization, {', '.join(f'CAST(round(CAST({c} AS DECIMAL(28,6)), 3) AS DOUBLE) AS {c}' for c in ('optimized_weight_lbs', 'optimized_spend', 'optimized_sustainable_spend'))} FROM plan")
def lp_least_cost(spark, d):
    amounts = ("optimized_weight_lbs", "optimized_spend", "optimized_sustainable_spend")
    return _solved(spark, d).select(*SCOPE, "category", "food_group", "in_optimization", *(F.round(F.col(c).cast("decimal(28,6)"), 3).cast("double").alias(c) for c in amounts))


MOVERS_SQL = f"""{PLAN_SQL}, m AS (SELECT *, baseline_sustainable_spend / nullif(baseline_spend, 0) * 100 AS b0, optimized_sustainable_spend / nullif(optimized_spend, 0) * 100 AS b1, sum(baseline_spend) OVER (PARTITION BY campus, fiscal_year) AS everything FROM plan),
movers AS (SELECT campus, fiscal_year, category, food_group, baseline_spend, round(b0, 6) AS baseline_sustainable_pct, round(b1, 6) AS optimized_sustainable_pct, round(b1 - b0, 6) AS delta_pts, round(sustainable_price_per_lb / conventional_price_per_lb, 6) AS price_ratio_sus_to_conv,
  sustainable_price_per_lb / conventional_price_per_lb <= 1 AS cost_neutral_or_better FROM m WHERE in_optimization AND sustainable_price_per_lb IS NOT NULL AND conventional_price_per_lb IS NOT NULL AND baseline_spend >= everything * 0.01)"""


def _movers(spark, d):
    out = lp.movers(_solved(spark, d), SCOPE)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" and c != "baseline_spend" else F.col(c) for c, t in out.dtypes))


@query(f"{MOVERS_SQL} SELECT * FROM movers")
def category_movers(spark, d):
    return _movers(spark, d)


@query(f"""{MOVERS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY campus, fiscal_year ORDER BY delta_pts DESC, category) AS up, row_number() OVER (PARTITION BY campus, fiscal_year ORDER BY delta_pts, category) AS down FROM movers)
SELECT campus, fiscal_year, 'gainer' AS kind, category, CAST(round(CAST(delta_pts AS DECIMAL(18,6)), 4) AS DOUBLE) AS delta_pts FROM k WHERE delta_pts > 1 AND up <= 5 UNION ALL SELECT campus, fiscal_year, 'loser', category, CAST(round(CAST(delta_pts AS DECIMAL(18,6)), 4) AS DOUBLE) FROM k WHERE delta_pts < -1 AND down <= 5
UNION ALL SELECT campus, fiscal_year, 'free win', category, CAST(round(CAST(delta_pts AS DECIMAL(18,6)), 4) AS DOUBLE) FROM k WHERE cost_neutral_or_better AND delta_pts > 1""")
def key_takeaways(spark, d):
    return report.takeaways(_movers(spark, d), SCOPE)


_SIX = lambda c: f"sum(CAST({c} AS DECIMAL(28,6)))"


@query(f"""{PLAN_SQL}, s AS (SELECT campus, food_group, {_SIX('baseline_spend')} AS ba, {_SIX('baseline_sustainable_spend')} AS bs, {_SIX('optimized_spend')} AS oa, {_SIX('optimized_sustainable_spend')} AS os FROM plan GROUP BY ALL)
SELECT campus, food_group, stage, spend_type, CAST(round(CAST(spend AS DECIMAL(38,4)), 2) AS DOUBLE) AS spend FROM (SELECT campus, food_group, 'baseline' AS stage, 'sustainable' AS spend_type, bs AS spend FROM s UNION ALL SELECT campus, food_group, 'baseline', 'conventional', ba - bs FROM s
UNION ALL SELECT campus, food_group, 'optimized', 'sustainable', os FROM s UNION ALL SELECT campus, food_group, 'optimized', 'conventional', oa - os FROM s)""")
def scenario_long_form(spark, d):
    out = lp.long_form(_solved(spark, d), ["campus"])
    return out.withColumn("spend", F.round(F.col("spend").cast("decimal(38,4)"), 2).cast("double"))


@query(f"""{PLAN_SQL} SELECT campus, fiscal_year, category, round(baseline_weight_lbs / m * 100, 1) AS baseline_bar, round(optimized_weight_lbs / m * 100, 1) AS optimized_bar
FROM (SELECT *, nullif(max(greatest(baseline_weight_lbs, optimized_weight_lbs)) OVER (PARTITION BY campus, fiscal_year), 0) AS m FROM plan)""")
def weight_chart(spark, d):
    return report.weight_chart(_solved(spark, d), SCOPE)


# ---- menus: parts are dishes, their lines are appearances
MENU_SQL = """meals AS (SELECT l_orderkey * 10 + l_linenumber AS ord, p_name AS ingredient, CASE WHEN l_linenumber % 3 <> 0 THEN p_type END AS category, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 64 END AS portion_lb FROM lineitem JOIN part ON l_partkey = p_partkey),
ing AS (SELECT ingredient, count(*) AS baseline_freq, avg(portion_lb) AS portion_lb FROM meals GROUP BY ingredient)"""


def _meals(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("p_name").alias("ingredient"), F.when(F.col("l_linenumber") % 3 != 0, F.col("p_type")).alias("category"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 64).alias("portion_lb"))


@query(f"WITH {MENU_SQL} SELECT ingredient, baseline_freq, round(portion_lb, 8) AS portion_lb FROM ing")
def menu_ingredient_summary(spark, d):
    return menu.ingredient_summary(_meals(spark, d)).select("ingredient", "baseline_freq", F.round("portion_lb", 8).alias("portion_lb"))


CONTRIB_SQL = """d AS (SELECT p_partkey, p_name || ' ' || p_partkey AS ingredient, p_type AS category, CAST(p_size AS DOUBLE) AS f, p_size % 2 = 0 AS sus, (p_size % 7 + 1) * 0.25::DOUBLE AS portion, p_size % 5 + 2.0::DOUBLE AS conv, p_size % 5 + 3.5::DOUBLE AS sp, length(p_type) / 2.0::DOUBLE AS g FROM part),
c AS (SELECT *, CASE WHEN sus THEN sp ELSE conv END * portion AS cost, CASE WHEN sus THEN sp * portion ELSE 0 END AS sus_cost, g * portion AS ghg FROM d),
r AS (SELECT 'baseline' AS scenario, 0 AS o, category, f AS freq, f AS base, cost, sus_cost, ghg FROM c UNION ALL SELECT 'more', 1, category, CASE WHEN sus THEN f + 1 ELSE f - 1 END, f, cost, sus_cost, ghg FROM c)"""


def _dishes(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size")
    dishes = part.select(F.concat_ws(" ", "p_name", "p_partkey").alias("ingredient"), F.col("p_type").alias("category"), size.alias("baseline_freq"), F.when(size % 2 == 0, "Yes").otherwise("no").alias("default_sus"), ((size % 7 + 1) * 0.25).alias("portion_lb"), (size % 5 + 2.0).alias("conventional_price_lb"), (size % 5 + 3.5).alias("sustainable_price_lb"), (F.length("p_type") / 2.0).alias("ghg_per_lb"))
    return menu.metrics(dishes)


def _contrib(spark, d):
    dishes = _dishes(spark, d)
    freq = dishes.select("ingredient", F.lit("more").alias("scenario"), F.when(F.col("default_sus") == "Yes", F.col("baseline_freq") + 1).otherwise(F.col("baseline_freq") - 1).cast("double").alias("freq"))
    return menu.contributions(dishes, freq)


@query(f"""WITH {CONTRIB_SQL}, s AS (SELECT scenario, o, round(sum(freq), 4) AS meals, round(sum(freq * cost), 4) AS total_cost, round(sum(freq * sus_cost), 4) AS sus_spend, round(sum(freq * ghg), 4) AS total_ghg FROM r GROUP BY scenario, o),
b AS (SELECT * FROM s WHERE o = 0) SELECT s.scenario, s.meals, s.total_cost, s.sus_spend, s.total_ghg, round(s.sus_spend / s.total_cost, 6) AS sus_pct, round((s.total_cost - b.total_cost) / b.total_cost * 100, 4) AS cost_pct_change,
round((s.sus_spend - b.sus_spend) / b.sus_spend * 100, 4) AS sus_spend_pct_change, round((s.total_ghg - b.total_ghg) / b.total_ghg * 100, 4) AS ghg_pct_change FROM s, b""")
def menu_scenario_summary(spark, d):
    return menu.scenario_summary(_contrib(spark, d))


@query(f"""WITH {CONTRIB_SQL}, s AS (SELECT scenario, category, sum(base) AS baseline_meals, sum(freq) AS optimized_meals FROM r WHERE o = 1 GROUP BY scenario, category)
SELECT scenario, category, baseline_meals, optimized_meals, optimized_meals - baseline_meals AS change_meals, round(baseline_meals / sum(baseline_meals) OVER (), 6) AS baseline_share, round(optimized_meals / sum(optimized_meals) OVER (), 6) AS optimized_share, round((optimized_meals - baseline_meals) / baseline_meals * 100, 4) AS pct_change_meals FROM s""")
def menu_category_frequency(spark, d):
    return menu.category_frequency(_contrib(spark, d))


@query(f"""WITH {CONTRIB_SQL}, s AS (SELECT scenario, category, round(sum(freq * sus_cost), 4) AS sustainable_spend, round(sum(freq * cost - freq * sus_cost), 4) AS conventional_spend, round(sum(freq * cost), 4) AS cost, round(sum(freq * ghg), 4) AS ghg FROM r GROUP BY scenario, category)
SELECT *, round(sustainable_spend / nullif(cost, 0), 6) AS sus_pct FROM s""")
def menu_category_sustainability(spark, d):
    return menu.category_sustainability(_contrib(spark, d))


_SPENT = "round(sum({0} * sus_cost), 4) AS {1}s, round(sum({0} * cost - {0} * sus_cost), 4) AS {1}c"
_LABEL = "CASE WHEN {0}s + {0}c > 0 THEN printf('%.0f%%', round({0}s / ({0}s + {0}c) * 100, 6)) ELSE '' END"


@query(f"""WITH {CONTRIB_SQL}, s AS (SELECT scenario, category, {_SPENT.format('base', 'b')}, {_SPENT.format('freq', 'o')} FROM r WHERE o = 1 GROUP BY scenario, category)
SELECT scenario, category, 'Baseline' AS version, 'Sustainable' AS spend_type, bs AS spend, {_LABEL.format('b')} AS label FROM s UNION ALL SELECT scenario, category, 'Baseline', 'Conventional', bc, {_LABEL.format('b')} FROM s
UNION ALL SELECT scenario, category, 'Optimized', 'Sustainable', os, {_LABEL.format('o')} FROM s UNION ALL SELECT scenario, category, 'Optimized', 'Conventional', oc, {_LABEL.format('o')} FROM s""")
def menu_spend_chart(spark, d):
    return deliverable.spend_chart(_contrib(spark, d))


@query(f"""WITH {CONTRIB_SQL}, s AS (SELECT scenario, category, sum(base) AS b, sum(freq) AS f FROM r WHERE o = 1 GROUP BY scenario, category) SELECT scenario, category, 'Baseline' AS version, b AS meals FROM s UNION ALL SELECT scenario, category, 'Optimized', f FROM s""")
def menu_frequency_chart(spark, d):
    return deliverable.frequency_chart(menu.category_frequency(_contrib(spark, d)))


@query(f"""WITH {CONTRIB_SQL}, s AS (SELECT scenario, o, round(sum(freq * cost), 4) AS c, round(sum(freq * sus_cost), 4) AS g, round(sum(freq * ghg), 4) AS e FROM r GROUP BY scenario, o)
SELECT s.scenario, b.c AS baseline_cost, s.c AS optimized_cost, round((s.c - b.c) / b.c * 100, 4) AS cost_pct_change, b.g AS baseline_sus_spend, s.g AS optimized_sus_spend, round((s.g - b.g) / b.g * 100, 4) AS sus_spend_pct_change,
  round(b.g / b.c, 6) * 100 AS baseline_sus_pct, round(s.g / s.c, 6) * 100 AS optimized_sus_pct, b.e AS baseline_ghg, s.e AS optimized_ghg, round((s.e - b.e) / b.e * 100, 4) AS ghg_pct_change FROM s JOIN s b ON b.o = 0 WHERE s.o = 1""")
def menu_headline(spark, d):
    return deliverable.headline(menu.scenario_summary(_contrib(spark, d)))


@query()
def menu_deliverable_details(spark, d):
    """Dish by dish what the proven plans of all halls change; tests read the exported files back."""
    rows = _halls(spark, d, 12)
    found = menu.plans(rows.select("hall", "ingredient", "baseline_freq", "cost", "sus_cost", "ghg"), ["hall"], {"scenario1": ("cost", 0.0)})
    found = checkpointed(found)  # the sort reads its rows twice, and plans aren't to be searched twice
    return deliverable.details(menu.contributions(rows, found.where("freq is not null").select("ingredient", "scenario", "freq")))


@query()
def menu_integer_plans(spark, d):
    """Whole-number plans of menus whose variables are the dishes themselves, a dozen a hall, each with its proof. The query of
    small menus compares the same search with all plans."""
    rows = _halls(spark, d, 12)
    return menu.plans(rows.select("hall", "ingredient", "baseline_freq", "cost", "sus_cost", "ghg"), ["hall"], MENU_GOALS)


MENU_GOALS = {"scenario1": ("cost", 0.0), "scenario2": ("sustainable", 0.0), "scenario3": ("ghg", 0.02)}


def _halls(spark, d, dishes):
    return _dishes(spark, d).withColumn("hall", F.expr(f"cast(element_at(split(ingredient, ' '), -1) as bigint) div {dishes}"))


def _seats(n, extra=""):
    """Menus of ``n`` dishes side by side: bounds lo, hi and cost c, sustainable cost s, emissions e of each; a missing dish has none."""
    pick = lambda c, k: f"coalesce(any_value({c}) FILTER (k = {k}), 0) AS {c}{k}"
    return f"""WITH {CONTRIB_SQL}, h AS (SELECT *, p_partkey // {n} AS hall, p_partkey % {n} AS k, ceil(f * 0.5)::BIGINT AS lo, floor(f * 1.5)::BIGINT AS hi, cost AS c, sus_cost AS s, ghg AS e FROM c),
m AS (SELECT hall, sum(f)::BIGINT AS total, sum(f * c) AS cost0, sum(f * s) AS green0, {', '.join(pick(c, k) for k in range(n) for c in ('lo', 'hi', 'c', 's', 'e'))}{extra} FROM h GROUP BY hall)"""


@query(f"""{_seats(3)}, x0 AS (SELECT *, unnest(range(lo0, hi0 + 1)) AS x0 FROM m), x1 AS (SELECT *, unnest(range(lo1, hi1 + 1)) AS x1 FROM x0),
x AS (SELECT hall, cost0, green0, x0 * c0 + x1 * c1 + (total - x0 - x1) * c2 AS cost, x0 * s0 + x1 * s1 + (total - x0 - x1) * s2 AS green, x0 * e0 + x1 * e1 + (total - x0 - x1) * e2 AS ghg FROM x1 WHERE total - x0 - x1 BETWEEN lo2 AND hi2),
top AS (SELECT hall, max(green) AS top FROM x WHERE cost <= cost0 * 0.98::DOUBLE GROUP BY hall),
v AS (SELECT hall, min(cost) FILTER (green >= green0) AS v1, max(green) FILTER (cost <= cost0) AS v2, min(ghg) FILTER (cost <= cost0 * 0.98::DOUBLE AND green >= top - 1e-6) AS v3 FROM x LEFT JOIN top USING (hall) GROUP BY hall)
SELECT hall, s AS scenario, CASE WHEN v IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, v AS value FROM (SELECT hall, 'scenario1' AS s, v1 AS v FROM v UNION ALL SELECT hall, 'scenario2', v2 FROM v UNION ALL SELECT hall, 'scenario3', v3 FROM v)""")
def menu_small_plan_values(spark, d):
    """The best values of menus of three dishes; SQL tries all plans."""
    rows = _halls(spark, d, 3)
    found = menu.plans(rows.select("hall", "ingredient", "baseline_freq", "cost", "sus_cost", "ghg"), ["hall"], MENU_GOALS)
    of = F.when(F.col("scenario") == "scenario1", F.col("cost")).when(F.col("scenario") == "scenario2", F.col("sus_cost")).otherwise(F.col("ghg"))
    return found.join(rows.select("ingredient", "cost", "sus_cost", "ghg"), "ingredient").groupBy("hall", "scenario", "status").agg(F.sum(F.col("freq") * of).alias("value"))


@query(f"""{_seats(2, ", avg(portion) FILTER (category = 'ECONOMY') AS p")}, x0 AS (SELECT *, unnest(range(lo0, hi0 + 1)) AS x0 FROM m WHERE p IS NOT NULL), x1 AS (SELECT *, unnest(range(0, 7)) AS n FROM x0),
x AS (SELECT hall, x0 * c0 + (total - x0 - n) * c1 + n * 4.0::DOUBLE * p AS cost, x0 * s0 + (total - x0 - n) * s1 + n * 4.0::DOUBLE * p AS green, x0 * e0 + (total - x0 - n) * e1 + n * 3.5::DOUBLE * p AS ghg, cost0 FROM x1 WHERE total - x0 - n BETWEEN lo1 AND hi1),
ok AS (SELECT * FROM x WHERE cost <= cost0 * (1 - 0.07::DOUBLE)), top AS (SELECT hall, max(green) AS top FROM ok GROUP BY hall), low AS (SELECT hall, any_value(top) AS sustainable_spend, min(ghg) AS ghg FROM ok JOIN top USING (hall) WHERE green >= top - 1e-6 GROUP BY hall)
SELECT hall, CASE WHEN p IS NULL THEN 'no_category' WHEN ghg IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, sustainable_spend, ghg FROM m LEFT JOIN low USING (hall)""")
def menu_new_dish_values(spark, d):
    """Menus of two dishes that may take up six times a new one; SQL tries all plans."""
    rows = _halls(spark, d, 2)
    ghg = spark.createDataFrame([("ECONOMY", 3.5)], "category string, ghg_per_lb double")
    dishes, without = menu.with_new_dish(rows, ["hall"], "new dish", "ECONOMY", conventional_price_lb=3.0, sustainable_price_lb=4.0, cap=6, ghg=ghg)
    found = menu.plans(dishes.select("hall", "ingredient", "baseline_freq", "cost", "sus_cost", "ghg", "cap"), ["hall"], {"hypothetical": ("ghg", 0.07)})
    sums = found.join(dishes.select("hall", "ingredient", "sus_cost", "ghg"), ["hall", "ingredient"]).groupBy("hall", "status").agg(F.sum(F.col("freq") * F.col("sus_cost")).alias("sustainable_spend"), F.sum(F.col("freq") * F.col("ghg")).alias("ghg"))
    none = F.lit(None).cast("double")
    return sums.unionByName(without.select("hall", F.lit("no_category").alias("status"), none.alias("sustainable_spend"), none.alias("ghg")))


@query("""SELECT name, sum(flag)::BIGINT AS n FROM (SELECT unnest(['small', 'large', 'even', 'never']) AS name, unnest([CASE WHEN p_size < 10 THEN 1 ELSE 0 END, CASE WHEN p_size > 40 THEN 1 ELSE 0 END, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END, 0]) AS flag FROM part) GROUP BY name HAVING sum(flag) > 0""")
def cert_indicator_counts(spark, d):
    size = F.col("p_size")
    wide = spark.read.parquet(f"{d}/part.parquet").select(F.when(size < 10, 1).otherwise(0).alias("small"), F.when(size > 40, 1).otherwise(0).alias("large"), F.when(size % 2 == 0, 1).otherwise(0).alias("even"), F.lit(0).alias("never"))
    return menu.indicator_counts(wide, ["small", "large", "even", "never"])


@query("SELECT p_type AS category, count(*) AS n, round(avg(CASE WHEN p_size % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS covered FROM part GROUP BY p_type")
def subcategory_coverage(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("category"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("sub"))
    return menu.coverage(rows, "category", "sub")


# ---- reports over the solved plan
PRINTED_SQL = "CASE WHEN {0} IS NULL THEN '–' ELSE '$' || format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT)) END"
SHARE_SQL = "CASE WHEN {0} IS NULL THEN '–' ELSE printf('%.1f%%', {0}) END"


@query(f"""{PLAN_SQL} SELECT campus, fiscal_year, 'least cost' AS scenario, category, food_group, {PRINTED_SQL.format('baseline_spend')} AS baseline, {PRINTED_SQL.format('optimized_spend')} AS optimized,
  {SHARE_SQL.format('round(baseline_sustainable_spend / nullif(baseline_spend, 0) * 100, 6)')} AS sustainable_before, {SHARE_SQL.format('round(optimized_sustainable_spend / nullif(optimized_spend, 0) * 100, 6)')} AS sustainable_after,
  {SHARE_SQL.format('round((optimized_weight_lbs - baseline_weight_lbs) / nullif(baseline_weight_lbs, 0) * 100, 6)')} AS weight_change FROM plan""")
def scenario_table(spark, d):
    plans = _solved(spark, d)
    change = F.round((F.col("optimized_weight_lbs") - F.col("baseline_weight_lbs")) / F.nullif("baseline_weight_lbs", F.lit(0.0)) * 100, 6)
    shares = {c: F.round(c, 6) for c in ("baseline_sustainable_pct", "optimized_sustainable_pct")}
    return report.scenario_table(plans.withColumns({**shares, "weight_pct_change": change}), SCOPE, "least cost")


@query(f"""{PLAN_SQL} SELECT campus, fiscal_year, category, round(baseline_sustainable_spend / nullif(baseline_spend, 0) * 100, 6) AS baseline_sustainable_pct,
  round(optimized_sustainable_spend / nullif(optimized_spend, 0) * 100, 6) AS optimized_sustainable_pct, baseline_spend FROM plan WHERE in_optimization""")
def sustainable_share(spark, d):
    out = report.sustainable_share(_solved(spark, d), SCOPE)
    return out.withColumns({c: F.round(c, 6) for c in ("baseline_sustainable_pct", "optimized_sustainable_pct")})


@query(f"""{PLAN_SQL.replace("price AS cost FROM own)", "price AS cost FROM flat)").replace("seg AS (", f"""flat AS (SELECT * REPLACE (CASE WHEN i THEN greatest(lo - cap, 0) ELSE lo END AS lo, CASE WHEN i THEN lo + room - greatest(lo, cap) ELSE room END AS room) FROM (SELECT *, bw * 0.85::DOUBLE AS lo, bw * 0.3::DOUBLE AS room, least({ITEM.max_weight_lbs}::DOUBLE, bw * 1.15::DOUBLE) AS cap, category = '{ITEM.category}' AND {ITEM.price_per_lb}::DOUBLE < price AS i FROM own)),
seg AS (""", 1).replace("bw AS w, bw * 0.85::DOUBLE AS lo, bw * 0.3::DOUBLE AS room, price AS cost FROM flat)", f"""bw AS w, lo, room, price AS cost FROM flat UNION ALL
  SELECT campus, fiscal_year, food_group, category, 0, least(cap, bw * 0.85::DOUBLE), greatest(cap - bw * 0.85::DOUBLE, 0), {ITEM.price_per_lb}::DOUBLE FROM flat WHERE i)""").partition(", plan AS (")[0].rstrip().rstrip(",")},
taken AS (SELECT campus, fiscal_year, category, round(coalesce(sum(x) FILTER (cost = {ITEM.price_per_lb}::DOUBLE), 0), 6) AS lbs FROM filled WHERE category = '{ITEM.category}' GROUP BY ALL)
SELECT campus, fiscal_year, category, CASE WHEN lbs > 0 THEN 'competitive' ELSE 'not competitive' END AS verdict, round(lbs, 2) AS adopted_lbs, round(lbs / {ITEM.max_weight_lbs}::DOUBLE * 100, 1) AS share_of_cap_pct,
  CASE WHEN sustainable_price_per_lb > 0 THEN round({ITEM.price_per_lb}::DOUBLE / sustainable_price_per_lb, 2) END AS times_sustainable_price, CASE WHEN conventional_price_per_lb > 0 THEN round({ITEM.price_per_lb}::DOUBLE / conventional_price_per_lb, 2) END AS times_conventional_price FROM taken JOIN own USING (campus, fiscal_year, category)""")
def item_verdict(spark, d):
    plans = lp.solve(_base(spark, d), SCOPE, "least_cost", bounds=TIGHT, item=ITEM)
    return report.verdict(plans.where("in_optimization"), SCOPE, ITEM.category, ITEM.price_per_lb, ITEM.max_weight_lbs)


@query(f"""{PLAN_SQL}, t AS (SELECT campus, fiscal_year, CAST({_SIX('optimized_spend')} AS DOUBLE) AS after, CAST({_SIX('baseline_spend')} AS DOUBLE) AS before FROM plan GROUP BY ALL)
SELECT campus, fiscal_year, round(greatest(-(after - before) / nullif(before, 0) * 100, 0), 4) AS max_cut_pct FROM t""")
def largest_cut(spark, d):
    return report.largest_cut(lp.totals(_solved(spark, d), SCOPE), SCOPE).withColumn("max_cut_pct", F.round("max_cut_pct", 4))


@query(f"""{agg.B}, {agg.EXCLUDED_SQL}, s AS (SELECT campus, fiscal_year, round(sum(weight_resolved_pct * baseline_spend) / sum(baseline_spend), 8) AS covered, sum(price_outlier_count) AS outliers FROM base GROUP BY ALL)
SELECT campus, fiscal_year, concat_ws('; ', CASE WHEN covered < 0.95 THEN 'weights cover under 95% of spend' END, CASE WHEN excluded_spend > 0 THEN 'some spend has no category' END,
  CASE WHEN outliers > 0 THEN 'price outliers are left out of weights' END) AS caveats FROM s JOIN excluded USING (campus, fiscal_year)""")
def snapshot_caveats(spark, d):
    return report.caveats(agg.snapshot_totals(spark, d)).select(*SCOPE, "caveats")


@query("""SELECT p_name AS certification_name, p_brand AS abbreviation, p_type AS frameworks, CASE WHEN p_size % 2 = 0 THEN 'raw' END AS qualifier FROM part""")
def certification_glossary(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    return report.glossary(rows.select(F.col("p_name").alias("certification_name"), F.col("p_brand").alias("abbreviation"), F.col("p_type").alias("frameworks"), F.when(F.col("p_size") % 2 == 0, "raw").alias("qualifier")))
