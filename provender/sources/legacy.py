"""Inputs of the older tools: menu sheets, prices, emissions, the wide search sheet, uploads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.functions.text import clean, known, plain_number
from provender.sources.csv import read_text_csv


def clean_names(df: DataFrame) -> DataFrame:
    """Headers in small letters with underscores; a name that comes twice gets a number."""
    seen: dict[str, int] = {}
    made = []
    for c in df.columns:
        name = re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", c.lower())).strip("_") or "x"
        seen[name] = seen.get(name, 0) + 1
        made.append(F.col(f"`{c}`").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(*made)


def typed(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Text trimmed, blanks and missing tokens null, the named columns as numbers."""
    return df.select(*((plain_number(known(F.col(c))) if c in numbers else clean(known(F.col(c))) if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes))


def read_menu(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meals, prices, emissions) in the columns that operators/menu.py takes."""
    read = lambda name: clean_names(read_text_csv(spark, f"{folder}/{name}.csv"))
    meals = typed(read("meals"), ["expected_lb_meat_portion", "planned_portions"]).withColumnRenamed("expected_lb_meat_portion", "portion_lb")
    prices = typed(read("ingredient_prices"), ["conventional_price_lb", "sustainable_price_lb"])
    ghg = typed(read("ghg_equivalents"), ["c_footprint_kg_c_per_kg_food"]).withColumnRenamed("c_footprint_kg_c_per_kg_food", "factor")
    return meals, prices, ghg


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded sheet by its ending; only CSV can be read here."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only CSV sheets can be read")
    return read_text_csv(spark, path)


def read_search_sheet(spark: SparkSession, path: str, text: list[str]) -> DataFrame:
    """The wide search sheet: text columns as they are, all others 0 or 1 (missing or bad cells are 0), headers trimmed."""
    raw = read_text_csv(spark, path).drop("ord")
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    return raw.select(*((F.col(f"`{c}`") if c in text else F.coalesce(F.col(f"`{c}`").try_cast("int"), F.lit(0))).alias(c) for c in raw.columns))


def search_sheet(wide: DataFrame, *, category: str | None = None, standard: str | None = None, region: list[str] | None = None, campus: str | None = None, certs: list[str] | None = None) -> DataFrame:
    """The older search: category, one standard or both, any campus of a region, a campus, any of the certifications."""
    any_of = lambda cols: F.greatest(F.lit(0), *(F.col(f"`{c}`") for c in cols)) == 1
    rules: list[Column] = []
    if category:
        rules.append(F.col("Category") == category)
    if standard:
        rules.extend([F.col(s) == 1 for s in (["AASHE", "PGH"] if standard == "both" else [standard])])
    if region:
        rules.append(any_of(region))
    if campus:
        rules.append(F.col(f"`{campus}`") == 1)
    if certs:
        rules.append(any_of(certs))
    out = wide
    for r in rules:
        out = out.where(r)
    return out


def beside(left: DataFrame, right: DataFrame, key: str = "row") -> DataFrame:
    """Two tables side by side by an explicit row number."""
    return left.join(right, key, "left")


# Fixed values of the bakery sheet: items in a pack, and what a title says of its kind, the first that fits.
PACKS = {"dz": 12, "ea": 1}
TITLE_GROUPS = [("pullman", "pullman_loaf"), ("croissant", "croissant"), ("muffin", "muffin"), ("cookie", "cookie"), ("brownie", "brownie"), ("cake", "cake_slice"), ("danish", "danish"), ("scone", "scone"), ("donut|doughnut", "donut"), ("bagel", "bagel"), ('6"', "sandwich_roll_6in"), ('8"', "sandwich_roll_8in"), ("hamburger|burger", "hamburger_bun"), ("hot dog", "hotdog_bun"), ("roll", "roll"), ("bun", "bun")]


def items_in_pack(pack: Column, title: Column) -> Column:
    """A dozen, one, or the six that a pack's title tells of."""
    out = F.when((pack == "pk") & title.contains("6-Pk"), 6)
    for name, n in PACKS.items():
        out = out.when(pack == name, n)
    return out.otherwise(1)


def told_weight_lb(title: Column) -> Column:
    """The pounds that a title in small letters tells: a number before # or else before oz; of several numbers the first."""
    first = F.regexp_extract(title, r"[0-9.]+", 0).try_cast("double")
    return F.when(title.rlike(r"[0-9.]+\s*#"), first).when(title.rlike(r"[0-9.]+\s*oz"), first / 16)


def title_group(title: Column) -> Column:
    out = F.lit("unknown")
    for pattern, group in reversed(TITLE_GROUPS):
        out = F.when(title.rlike(pattern), group).otherwise(out)
    return out


def fill_weights(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """A sheet of titles with the weights of a mapping filled in: rows (title, pack, quantity, ...), mapping (title, weight_group_key,
    assumed_each_weight_lb). A title without a mapping keeps null weights; write the result with sources.csv.write_csv()."""
    items = items_in_pack(F.col("pack"), F.col("title"))
    out = rows.join(mapping, "title", "left").withColumn("items_per_pack", items)
    out = out.withColumn("estimated_total_items", F.col("quantity") * F.col("items_per_pack"))
    return out.withColumn("weight_lbs", F.round(F.col("assumed_each_weight_lb") * F.col("estimated_total_items"), 2))
