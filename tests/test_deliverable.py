"""Files of planned menus, read back."""

import pytest
from pyspark.sql import functions as F

from provender.operators import deliverable, menu, resolve
from provender.sources import legacy


def planned(spark):
    rows = [("h", "a", "Beef", 4, 3.0, 3.0, 5.0), ("h", "b", "Soy", 6, 1.0, 0.0, 1.0), ("h", "c", "Fish", 5, 2.0, 2.0, 2.0), ("h", "d", "Beef", 3, 2.5, 0.0, 6.0)]
    dishes = spark.createDataFrame(rows, "hall string, ingredient string, category string, baseline_freq int, cost double, sus_cost double, ghg double")
    found = menu.plans(dishes, ["hall"], {"scenario1": ("cost", 0.0), "scenario3": ("ghg", 0.02)})
    assert {r.status for r in found.collect()} == {"optimal"}
    return dishes, menu.contributions(dishes, found.select("ingredient", "scenario", "freq"))


def test_files_of_every_scenario(spark, tmp_path):
    dishes, rows = planned(spark)
    folder = str(tmp_path / "out")
    names = deliverable.export(rows, "Hall 100%", folder)
    assert names == ["category_table", "frequency_chart", "headline_metrics", "ingredient_details", "scenario_summary", "spend_chart"]
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{n}").toPandas()
    plan = {(r.scenario, r.ingredient): r for r in rows.where("scenario_ord > 0").collect()}
    detail = read("ingredient_details")
    assert len(detail) == 8 and set(detail["scenario"]) == {"scenario1", "scenario3"}
    for r in detail.itertuples():
        p = plan[r.scenario, r.ingredient]
        assert (r.freq_optimized, r.delta) == (p.freq, p.freq - p.baseline_freq) and r.optimized_cost == pytest.approx(p.freq * p.cost)
    head = read("headline_metrics").set_index("scenario")
    base = dishes.selectExpr("sum(baseline_freq * cost) c").first().c
    assert head.loc["scenario1", "baseline_cost"] == pytest.approx(base) and head.loc["scenario1", "optimized_cost"] < base and head.loc["scenario3", "optimized_cost"] <= base * 0.98
    chart = read("frequency_chart")
    assert chart.groupby(["scenario", "version"])["meals"].sum().tolist() == [18.0] * 4
    spend = read("spend_chart")
    assert len(spend) == 2 * 3 * 2 * 2
    for s, v in (("scenario1", "optimized_cost"), ("scenario3", "optimized_cost")):
        assert spend[(spend.scenario == s) & (spend.version == "Optimized")]["spend"].sum() == pytest.approx(head.loc[s, v])
    texts = {r.scenario: r.value for r in spark.read.text(f"{folder}/scenario_summary").collect()}
    assert set(texts) == {"scenario1", "scenario3"} and texts["scenario1"].startswith("scenario1 for Hall 100% changes total cost by -")
    assert "largest category increase is" in texts["scenario3"]


def test_printed_shares_and_new_categories(spark):
    rows = spark.createDataFrame([("s", "x", 0.25, 0.5, 100.0), ("s", "y", 0.5, 0.12345, -50.555), ("s", "new", 0.0, 0.1, None), ("s", "same", 0.1, 0.1, 0.0)], "scenario string, category string, baseline_share double, optimized_share double, pct_change_meals double")
    got = {r.category: (r.baseline_share, r.optimized_share, r.change) for r in deliverable.category_table(rows).collect()}
    assert got == {"x": ("25.00%", "50.00%", "+100%"), "y": ("50.00%", "12.35%", "-50.56%"), "new": ("0.00%", "10.00%", None), "same": ("10.00%", "10.00%", "0%")}


def test_log_of_a_repair(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id long, x string, y int")
    after = spark.createDataFrame([(1, "A", 1), (2, "b", 5), (4, "d", 4)], "id long, x string, y int")
    got = sorted(tuple(r) for r in resolve.change_log(before, after, "id", ["x", "y"]).collect())
    assert got == [(1, "changed", "x", "a", "A"), (2, "changed", "y", None, "5"), (3, "removed", None, None, None), (4, "added", None, None, None)]


def test_titles(spark):
    rows = [("rolls 2.5# white", "pk"), ("bagel 6-Pk", "pk"), ("tart 8 oz", "dz"), ("doughnut", "ea"), (None, None)]
    df = spark.createDataFrame(rows, "title string, pack string")
    got = [tuple(r) for r in df.select(legacy.items_in_pack(F.col("pack"), F.col("title")), legacy.told_weight_lb(F.col("title")), legacy.title_group(F.col("title"))).collect()]
    assert got == [(1, 2.5, "roll"), (6, None, "bagel"), (12, 0.5, "unknown"), (1, None, "donut"), (1, None, "unknown")]


def test_menu_sub_categories(spark):
    rows = spark.createDataFrame([(" Beef ",), ("soy",), (None,)], "item string")
    known = spark.createDataFrame([("beef", "red", 2), ("BEEF", "first", 1), (None, "none", 1)], "item string, sub_category string, ord int")
    assert sorted(map(str, (r.sub_category for r in menu.with_subcategory(rows, known).collect()))) == ["None", "None", "first"]
