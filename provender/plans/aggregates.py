"""Queries of the aggregation layer: raw names, baselines, snapshots, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.functions import text
from provender.operators import baseline
from provender.plans.base import query
from provender.sources.star import PURCHASES_SQL, purchases

R = f"WITH {PURCHASES_SQL}"
SCOPE = ["campus", "fiscal_year"]
ORDER = ["ok", "ln", "product_id", "sk"]


def factors(spark: SparkSession, d: str) -> DataFrame:
    """Emission factors of the view's categories, by rule from their names: ord, food_category, factor; the first category has none."""
    kinds = spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct()
    first = kinds.select(F.length("p_type").alias("ord"), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")).alias("food_category"), (F.length("p_type") / 4.0).alias("factor"))
    again = kinds.select((F.length("p_type") + 1000).alias("ord"), F.col("p_type").alias("food_category"), F.lit(99.0).alias("factor"))
    return first.unionByName(again).where(~F.trim("food_category").startswith("S"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct()
    return kinds.where(F.length("p_type") % 3 != 0).select(F.col("p_type").alias("category"), F.concat(F.lit("group "), (F.length("p_type") % 2).cast("string")).alias("food_group"))


FACTORS_SQL = "factors AS (SELECT DISTINCT p_type AS category, length(p_type) / 4.0::DOUBLE AS factor FROM part WHERE p_type NOT LIKE 'S%')"
GROUPS_SQL = "groups AS (SELECT DISTINCT p_type AS category, 'group ' || (length(p_type) % 2) AS food_group FROM part WHERE length(p_type) % 3 <> 0)"
OUTLIER_SQL = """priced AS (SELECT *, CASE WHEN weight_source <> 'unresolved' AND total_weight_lbs > 0 AND total_price > 0 THEN log10(CAST(total_price AS DOUBLE) / total_weight_lbs) END AS lg FROM purchases WHERE category IS NOT NULL),
mids AS (SELECT campus, fiscal_year, category, median(lg) AS mid, count(lg) AS n FROM priced GROUP BY ALL),
offs AS (SELECT p.*, abs(lg - mid) AS off, n FROM priced p JOIN mids USING (campus, fiscal_year, category)),
mads AS (SELECT campus, fiscal_year, category, median(off) AS mad FROM offs GROUP BY ALL),
flagged AS (SELECT o.*, coalesce(n >= 10 AND mad <> 0 AND off / nullif(mad * 1.4826, 0) > 7.5, false) AS price_outlier FROM offs o JOIN mads USING (campus, fiscal_year, category))"""
BASELINE_SQL = f"""{OUTLIER_SQL}, sums AS (
  SELECT campus, fiscal_year, category, CAST(sum(total_price) AS DOUBLE) AS baseline_spend, coalesce(CAST(sum(total_price) FILTER (sustainable_yn = 'Y') AS DOUBLE), 0) AS baseline_sustainable_spend,
    coalesce(CAST(sum(CAST(total_weight_lbs AS DECIMAL(18,4))) FILTER (trusted AND sustainable_yn = 'Y') AS DOUBLE), 0) AS sustainable_weight_lbs,
    coalesce(CAST(sum(CAST(total_weight_lbs AS DECIMAL(18,4))) FILTER (trusted AND sustainable_yn <> 'Y') AS DOUBLE), 0) AS conventional_weight_lbs,
    coalesce(CAST(sum(total_price) FILTER (trusted) AS DOUBLE), 0) AS t, coalesce(CAST(sum(total_price) FILTER (trusted AND sustainable_yn = 'Y') AS DOUBLE), 0) AS ts,
    coalesce(CAST(sum(total_price) FILTER (trusted AND sustainable_yn <> 'Y') AS DOUBLE), 0) AS tc, count(*) FILTER (price_outlier) AS price_outlier_count, coalesce(CAST(sum(total_price) FILTER (price_outlier) AS DOUBLE), 0) AS price_outlier_spend
  FROM (SELECT *, weight_source <> 'unresolved' AND NOT price_outlier AS trusted FROM flagged) GROUP BY ALL),
base AS (SELECT campus, fiscal_year, s.category, baseline_spend, baseline_sustainable_spend, round(baseline_spend - baseline_sustainable_spend, 2) AS baseline_conventional_spend,
    sustainable_weight_lbs + conventional_weight_lbs AS baseline_weight_lbs, sustainable_weight_lbs, conventional_weight_lbs, coalesce(t / nullif(baseline_spend, 0), 0) AS weight_resolved_pct,
    CASE WHEN sustainable_weight_lbs > 0 THEN ts / sustainable_weight_lbs END AS sustainable_price_per_lb, CASE WHEN conventional_weight_lbs > 0 THEN tc / conventional_weight_lbs END AS conventional_price_per_lb,
    price_outlier_count, price_outlier_spend, factor AS ghg_factor_kg_per_kg, coalesce(food_group, s.category) AS food_group
  FROM sums s LEFT JOIN factors USING (category) LEFT JOIN groups USING (category))"""
B = f"{R}, {FACTORS_SQL}, {GROUPS_SQL}, {BASELINE_SQL}"
EXCLUDED_SQL = "excluded AS (SELECT campus, fiscal_year, coalesce(CAST(sum(total_price) FILTER (category IS NULL) AS DOUBLE), 0) AS excluded_spend FROM purchases GROUP BY ALL)"


def rows(spark, d):
    return purchases(spark, d).withColumn("validated", F.col("sustainable_yn"))


def base(spark, d):
    return baseline.category_baseline(rows(spark, d), SCOPE, factors(spark, d), groups(spark, d))


@query(f"{B} SELECT * FROM base")
def category_baseline(spark, d):
    return base(spark, d)


@query(f"""{B}, {EXCLUDED_SQL}, s AS (SELECT campus, fiscal_year, CAST(sum(CAST(baseline_spend AS DECIMAL(18,2))) AS DOUBLE) AS classified_spend, CAST(sum(CAST(baseline_sustainable_spend AS DECIMAL(18,2))) AS DOUBLE) AS sustainable_spend,
    CAST(sum(CAST(price_outlier_spend AS DECIMAL(18,2))) AS DOUBLE) AS price_outlier_spend, CAST(sum(price_outlier_count) AS BIGINT) AS price_outlier_count, round(sum(baseline_weight_lbs * 0.45359237::DOUBLE * coalesce(ghg_factor_kg_per_kg, 0)), 2) AS total_ghg_kg,
    sum(baseline_weight_lbs) FILTER (ghg_factor_kg_per_kg IS NULL) AS excluded_ghg_weight_lbs, round(sum(weight_resolved_pct * baseline_spend) / sum(baseline_spend), 8) AS weight_resolved_pct FROM base GROUP BY ALL)
  SELECT s.*, excluded_spend, round(classified_spend + excluded_spend, 2) AS total_spend, round(sustainable_spend / round(classified_spend + excluded_spend, 2), 8) AS sustainable_pct FROM s JOIN excluded USING (campus, fiscal_year)""")
def snapshot_totals(spark, d):
    return baseline.snapshot_of(rows(spark, d), SCOPE, factors(spark, d), groups(spark, d))


@query(f"{R}, {EXCLUDED_SQL} SELECT * FROM excluded")
def unclassified_spend(spark, d):
    return baseline.unclassified_spend(rows(spark, d), SCOPE)


@query(f"{R}, {OUTLIER_SQL} SELECT ok, ln, product_id, sk, campus, category FROM flagged WHERE price_outlier")
def price_outliers_mad(spark, d):
    keys = [*SCOPE, "category"]
    return baseline.flag_outliers(rows(spark, d).where("category is not null"), keys).where("price_outlier").select(*ORDER, "campus", "category")


@query(f"{B} SELECT category, round(sum(baseline_weight_lbs * 0.45359237::DOUBLE * coalesce(ghg_factor_kg_per_kg, 0)), 2) AS ghg_kg FROM base GROUP BY category")
def ghg_by_category(spark, d):
    return base(spark, d).groupBy("category").agg(F.round(F.sum(text.ghg_kg(F.col("baseline_weight_lbs"), F.col("ghg_factor_kg_per_kg"))), 2).alias("ghg_kg"))


@query(f"{B} SELECT campus, food_group, CAST(sum(CAST(baseline_spend AS DECIMAL(18,2))) AS DOUBLE) AS spend, count(DISTINCT category) AS n_categories FROM base GROUP BY ALL")
def food_group_rollup(spark, d):
    return base(spark, d).groupBy("campus", "food_group").agg(F.sum(F.col("baseline_spend").cast("decimal(18,2)")).cast("double").alias("spend"), F.countDistinct("category").alias("n_categories"))


RAW_SQL = """numbered AS (SELECT *, row(ok, ln, product_id, sk) AS ord FROM purchases),
yn AS (SELECT campus, raw_name, sustainable_yn FROM (SELECT campus, raw_name, sustainable_yn, row_number() OVER (PARTITION BY campus, raw_name ORDER BY count(*) DESC, sustainable_yn) AS r FROM numbered GROUP BY campus, raw_name, sustainable_yn) WHERE r = 1),
kinds AS (SELECT campus, raw_name, purchase_type FROM (SELECT campus, raw_name, purchase_type, row_number() OVER (PARTITION BY campus, raw_name ORDER BY count(*) DESC, purchase_type) AS r FROM numbered GROUP BY campus, raw_name, purchase_type) WHERE r = 1),
g AS (SELECT campus, raw_name, CAST(sum(total_price) AS DOUBLE) AS total_price, CAST(sum(CAST(total_weight_lbs AS DECIMAL(18,4))) AS DOUBLE) AS total_weight_lbs,
  arg_min(vendor, ord) FILTER (vendor IS NOT NULL) AS vendor, arg_min(brand, ord) FILTER (brand IS NOT NULL) AS brand,
  ['reported', 'computed_tier2', 'reference_table_tier3', 'unresolved'][coalesce(max(CASE weight_source WHEN 'reported' THEN 1 WHEN 'computed_tier2' THEN 2 WHEN 'reference_table_tier3' THEN 3 ELSE 4 END) FILTER (total_weight_lbs IS NOT NULL), 4)] AS weight_source, count(*) AS n_rows FROM numbered GROUP BY campus, raw_name),
raw AS (SELECT g.*, sustainable_yn, purchase_type, nullif(total_price, 0) / nullif(total_weight_lbs, 0) AS unit_price FROM g JOIN yn USING (campus, raw_name) JOIN kinds USING (campus, raw_name))"""


@query(f"{R}, {RAW_SQL} SELECT * FROM raw")
def raw_name_aggregate(spark, d):
    return baseline.by_raw_name(rows(spark, d), ["campus"], ORDER)


@query(f"{R}, {RAW_SQL} SELECT campus, weight_source, count(*) AS n FROM raw GROUP BY ALL")
def weakest_tier(spark, d):
    return baseline.by_raw_name(rows(spark, d), ["campus"], ORDER).groupBy("campus", "weight_source").agg(F.count("*").alias("n"))


@query(f"{R} SELECT campus, weight_source, count(*) AS n FROM purchases GROUP BY ALL")
def weight_source_counts(spark, d):
    return rows(spark, d).groupBy("campus", "weight_source").agg(F.count("*").alias("n"))


@query(f"""{R}, x AS (SELECT product_id // 4 AS keep_id, *, 'R' || (ok % 5) AS report, CASE WHEN ok % 11 = 0 THEN 0 ELSE total_price END AS price FROM purchases)
SELECT keep_id, campus, fiscal_year, CASE WHEN count(*) = 1 THEN CAST(sum(price) AS DOUBLE) ELSE nullif(CAST(sum(price) AS DOUBLE), 0) END AS total_price, CASE WHEN count(*) = 1 THEN CAST(sum(CAST(total_weight_lbs AS DECIMAL(18,4))) AS DOUBLE) ELSE nullif(CAST(sum(CAST(total_weight_lbs AS DECIMAL(18,4))) AS DOUBLE), 0) END AS total_weight_lbs,
  CASE WHEN count(*) = 1 THEN any_value(weight_source) ELSE ['reported', 'computed_tier2', 'reference_table_tier3', 'unresolved'][coalesce(max(CASE weight_source WHEN 'reported' THEN 1 WHEN 'computed_tier2' THEN 2 WHEN 'reference_table_tier3' THEN 3 ELSE 4 END) FILTER (total_weight_lbs IS NOT NULL), 4)] END AS weight_source,
  arg_min(vendor, row(ok, ln, product_id, sk)) FILTER (coalesce(vendor, '') <> '') AS vendor, nullif(array_to_string(list_sort(list(DISTINCT brand) FILTER (brand <> '')), ', '), '') AS brand,
  array_to_string(list_sort(list(DISTINCT report)), '; ') AS source_report_id, count(*) AS n_rows FROM x GROUP BY 1, 2, 3""")
def merge_purchases(spark, d):
    merged = rows(spark, d).withColumn("keep_id", F.expr("product_id div 4")).withColumn("source_report_id", F.concat(F.lit("R"), (F.col("ok") % 5).cast("string")))
    merged = merged.withColumn("total_price", F.when(F.col("ok") % 11 == 0, F.lit(0)).otherwise(F.col("total_price")))
    return baseline.merge_purchases(merged, ["keep_id", *SCOPE], ORDER)
