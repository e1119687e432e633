"""Schemas, legacy sheets, reports."""

import pytest

from provender.operators import menu, report
from provender.sources import legacy, schemas


def test_conform_is_additive_and_idempotent(spark):
    old = spark.createDataFrame([(1, "A", 2, 3, 95.0, "pending")], "candidate_id long, campus string, a long, b long, score double, status string")
    new = schemas.conform(old, "candidates", {"campus_a": "campus", "campus_b": "campus"})
    assert new.schema == schemas.schema("candidates") and new.first().campus_b == "A"
    assert schemas.conform(new, "candidates").collect() == new.collect()


def test_violations_and_snapshots(spark, tmp_path):
    products = schemas.conform(spark.createDataFrame([(1, "Y"), (1, "maybe")], "product_id long, sustainable_yn string"), "products")
    buys = schemas.conform(spark.createDataFrame([(1, 1, "reported"), (2, 9, "guess")], "purchase_id long, product_id long, weight_source string"), "purchases")
    got = {(r.rule, r.value, r.n) for r in schemas.violations({"products": products, "purchases": buys}).collect()}
    assert got == {("products.sustainable_yn", "maybe", 1), ("products key", "1", 2), ("purchases.product_id -> products", "9", 1), ("purchases.weight_source", "guess", 1)}
    path = schemas.snapshot(buys, str(tmp_path), "purchases", "1")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        schemas.snapshot(buys, str(tmp_path), "purchases", "1")


def test_menu_sheets(spark, tmp_path):
    (tmp_path / "meals.csv").write_text("Dining Hall,Ingredient,Category,Expected lb meat portion,Planned portions\nA, beef stew ,Beef,0.5,10\nA,beef stew,,n/a,4\nB,tofu bowl,Plant,0.25,3\n")
    (tmp_path / "ingredient_prices.csv").write_text("ingredient,category,default_sus,conventional_price_lb,sustainable_price_lb\nbeef stew,Beef,No,5,7\ntofu bowl,Plant,Yes,2,3\n")
    (tmp_path / "ghg_equivalents.csv").write_text("Meat type,C_footprint_kg_C_per_kg_food\nBeef,41\nPlant,2\nbeef,99\n")
    meals, prices, ghg = legacy.read_menu(spark, str(tmp_path))
    dishes = menu.metrics(menu.with_prices(menu.ingredient_summary(meals), prices, ghg))
    got = {r.ingredient: (r.baseline_freq, r.portion_lb, r.cost, r.sus_cost, r.ghg, r.short_name) for r in dishes.collect()}
    assert got == {"beef stew": (2, 0.5, 2.5, 0.0, 20.5, "stew"), "tofu bowl": (1, 0.25, 0.75, 0.75, 0.5, "tofu bowl")}
    assert menu.missing_inputs(dishes).count() == 0


def test_search_sheet_and_uploads(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name , Category,AASHE,PGH,X\na,c,1,,1\nb,c,1,bad,0\n")
    wide = legacy.read_search_sheet(spark, str(tmp_path / "s.csv"), ["Name", "Category"])
    assert [tuple(r) for r in wide.collect()] == [("a", "c", 1, 0, 1), ("b", "c", 1, 0, 0)]
    assert [r.Name for r in legacy.search_sheet(wide, standard="AASHE", campus="X").collect()] == ["a"]
    assert legacy.read_upload(spark, str(tmp_path / "s.csv")).count() == 2
    with pytest.raises(ValueError):
        legacy.read_upload(spark, "x.xlsx")


def test_html_page(spark):
    df = spark.createDataFrame([("a<b", 1234.5, None)], "name string, spend double, note string")
    (html,) = report.page("Plan & more", {"Totals": df})
    assert "<h1>Plan &amp; more</h1>" in html and "<td>a&lt;b</td><td>1,234.50</td><td>–</td>" in html
    pages = report.page("x", {"t": spark.range(450), "Totals": df, "none": df.limit(0)})
    assert len(pages) == 3 and [p.count("<tr><td>") for p in pages] == [201, 200, 50] and "<h2>none</h2>" in pages[0]
    out = report.caveats(spark.createDataFrame([(0.5, 1.0, 2), (0.99, 0.0, 0)], "weight_resolved_pct double, excluded_spend double, price_outlier_count int")).collect()
    assert out[0].caveats.count(";") == 2 and out[1].caveats == ""
