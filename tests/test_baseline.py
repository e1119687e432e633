"""Medians of counted values against a plain sort; purchases of merged products and the view they come from."""

import random
import statistics

from provender.operators.baseline import exact_median, flag_outliers, merge_purchases
from provender.sources import star


def test_exact_median_over_steps(spark):
    rng = random.Random(7)
    groups = {"one": [1.5], "two": [1.0, 4.0], "ties": [2.0] * 9 + [3.0], "far": [-1e9, 0.0, 1e9, 5.0], "step": [0.5 + i * 1e-7 for i in range(401)], "mixed": [round(rng.gauss(0, 3), 2) for _ in range(1000)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    counts = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").count()
    got = {r.g: r.m for r in exact_median(counts, ["g"], "x", "count", "m").collect()}
    assert got == {g: statistics.median(xs) for g, xs in groups.items()}


def test_outliers_of_a_hot_group_and_missing_numbers(spark):
    rows = [("a", float(p % 7 + 1), 1.0, "reported") for p in range(5000)] + [("a", 1e6, 1.0, "reported"), ("a", None, 1.0, "reported"), ("a", 1.0, None, "reported"), ("a", 1e6, 1.0, "unresolved"), ("a", 1.0, float("nan"), "reported"), ("b", 1e6, 1.0, "reported")]
    df = spark.createDataFrame(rows, "g string, total_price double, total_weight_lbs double, weight_source string")
    out = flag_outliers(df, ["g"])
    assert out.count() == len(rows) and out.columns == [*df.columns, "price_outlier"]
    assert [tuple(r) for r in out.where("price_outlier").collect()] == [("a", 1e6, 1.0, "reported", True)]
    assert flag_outliers(df.limit(0), ["g"]).count() == 0


def _merged(spark):
    """Groups by k: one row as it is, blanks and unknown sources and all; several rows; nothing but blanks."""
    rows = [
        (1, 1, 0.0, 0.0, "guess", "", "", "r"), (2, 1, None, None, None, None, None, None), (3, 3, 1.0, 2.0, "reported", "late", "b", "r2"),
        (3, 1, 2.0, None, "unresolved", "", "a", "r1"), (3, 2, 3.0, 4.0, "computed_tier2", "first", "", "r2"), (3, 4, 4.0, 1.0, "reported", None, "b", None),
        (4, 1, 0.0, None, "reported", "", "", ""), (4, 2, 0.0, None, "reported", None, None, ""),
    ]
    df = spark.createDataFrame(rows, "k long, at long, total_price double, total_weight_lbs double, weight_source string, vendor string, brand string, source_report_id string")
    return merge_purchases(df, ["k"], ["at"])


def test_merged_purchases_of_one_and_of_several_rows(spark):
    assert sorted(tuple(r) for r in _merged(spark).collect()) == [
        (1, 0.0, 0.0, "guess", "", "", "r", 1), (2, None, None, None, None, None, None, 1),
        (3, 10.0, 7.0, "computed_tier2", "first", "a, b", "r1; r2", 4), (4, None, None, "unresolved", None, None, None, 2),
    ]


def test_merged_purchases_hold_few_strings_a_group(spark):
    plan = _merged(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(" not in plan and plan.count("collect_set(") == 2 and "array_sort(" not in plan and "lambda" not in plan


def test_purchase_lines_meet_few_tables(spark):
    """Lines go through a join by order, one by part and one by supplier; customers and nations meet the orders, of which there are fewer."""

    def joins_above(plan, column):
        if plan.children().isEmpty():
            return 0 if f"{column}#" in plan.toString() else None
        below = [joins_above(plan.children().apply(i), column) for i in range(plan.children().size())]
        found = [n for n in below if n is not None]
        return found[0] + (plan.nodeName() == "Join") if found else None

    plan = star.purchases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert joins_above(plan, "l_linenumber") == 3
    assert joins_above(plan, "c_nationkey") == 5
