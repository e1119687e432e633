"""Aggregation of purchases: raw names, category baselines, outliers, snapshots, emissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions.text import ghg_kg
from provender.operators.lineage import checkpointed

# Weight sources from the strongest to the weakest; outlier rule.
TIERS = ["reported", "computed_tier2", "reference_table_tier3", "unresolved"]
OUTLIER_Z, OUTLIER_LEAST_ROWS, MAD_SCALE = 7.5, 10, 1.4826


def tier_rank(source: Column) -> Column:
    out = F.lit(len(TIERS) - 1)
    for i, t in enumerate(TIERS):
        out = F.when(source == t, i).otherwise(out)
    return out


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank + 1)


def mode_by(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest: counts first, so each value costs a row a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def first_known(value: Column, order: Column) -> Column:
    """The first value in order that isn't null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def by_raw_name(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a raw name: null sums stay null, the first known vendor and brand, the weakest tier among rows with weight."""
    at = F.struct(*order)
    grouped = rows.where("raw_name is not null").groupBy(*keys, "raw_name").agg(
        F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double").alias("total_price"),
        F.sum(F.col("total_weight_lbs").cast("decimal(18,4)")).cast("double").alias("total_weight_lbs"),
        first_known(F.col("vendor"), at).alias("vendor"),
        first_known(F.col("brand"), at).alias("brand"),
        tier_name(F.coalesce(F.max(F.when(F.col("total_weight_lbs").isNotNull(), tier_rank(F.col("weight_source")))), F.lit(3))).alias("weight_source"),
        F.count("*").alias("n_rows"),
    )
    yn = mode_by(rows.where("raw_name is not null"), [*keys, "raw_name"], "sustainable_yn", "sustainable_yn")
    kind = mode_by(rows.where("raw_name is not null"), [*keys, "raw_name"], "purchase_type", "purchase_type")
    out = grouped.join(yn, [*keys, "raw_name"], "left").join(kind, [*keys, "raw_name"], "left")
    unit = F.try_divide(F.nullif("total_price", F.lit(0.0)), F.nullif("total_weight_lbs", F.lit(0.0)))
    return out.withColumn("unit_price", unit).withColumn("sustainable_yn", F.coalesce("sustainable_yn", F.lit("NA")))


MEDIAN_STEPS = 1000.0


def exact_median(counts: DataFrame, keys: list[str], value: str, n: str, name: str) -> DataFrame:
    """(keys, name, _all): the median of each group of counted values, the mean of the middle two of an even number, and how many
    there are.

    Values are counted by step of a thousandth first; running sums of a group's steps tell which one or two hold the middle, and
    only their values are put in order. A group is thus spread over tasks while it is counted, and what one task orders is a
    list of steps or the distinct values of two, as a sort that can spill.
    """
    step = F.floor(F.col(value) * MEDIAN_STEPS).alias("_step")
    steps = counts.groupBy(*keys, step).agg(F.sum(n).alias("_n"))
    group, so_far = Window.partitionBy(*keys), (Window.unboundedPreceding, 0)
    steps = steps.withColumn("_upto", F.sum("_n").over(group.orderBy("_step").rowsBetween(*so_far))).withColumn("_all", F.sum("_n").over(group))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    within = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    middle = steps.where(within(low) | within(high)).select(*keys, "_step", (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    near = counts.select(*keys, F.col(value).alias("_v"), step, F.col(n).alias("_m")).join(middle, [*keys, "_step"])
    # no value lies between two middle steps, so ranks run on from the first one's
    ranked = near.withColumn("_at", F.min("_before").over(group.orderBy("_v").rowsBetween(*so_far)) + F.sum("_m").over(group.orderBy("_v").rowsBetween(*so_far)))
    first = lambda r: F.min(F.when(F.col("_at") >= r, F.col("_v")))
    return ranked.groupBy(*keys).agg((first(low) * 0.5 + first(high) * 0.5).alias(name), F.max("_all").alias("_all"))


def _log_price() -> Column:
    """log10 of price per pound of a row whose price can be trusted, else null."""
    price, weight = F.col("total_price").cast("double"), F.col("total_weight_lbs")
    ok = (F.col("weight_source") != "unresolved") & (weight > 0) & ~F.isnan(weight) & (price > 0)
    return F.when(ok, F.log10(price / F.when(weight > 0, weight)))


def _spread(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _mid, _rows, _mad) of counted prices (keys, _log, _n): medians of the logs and of their distances from it."""
    middle = exact_median(counts, keys, "_log", "_n", "_mid").withColumnRenamed("_all", "_rows")
    off = counts.join(middle, keys).select(*keys, "_mid", "_rows", F.abs(F.col("_log") - F.col("_mid")).alias("_off"), "_n")
    return exact_median(off, [*keys, "_mid", "_rows"], "_off", "_n", "_mad").drop("_all")


def _is_outlier() -> Column:
    z = F.abs(F.col("_log") - F.col("_mid")) / F.nullif(F.col("_mad") * MAD_SCALE, F.lit(0.0))
    return F.coalesce((F.col("_rows") >= OUTLIER_LEAST_ROWS) & (z > OUTLIER_Z), F.lit(False))


def flag_outliers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with price_outlier: more than 7.5 scaled MADs of log price per pound away from the group's median; groups of fewer
    than ten priced rows, or without spread, have none.

    Prices are counted by group and value once and written down; both medians come from these counts, and one row a group is
    joined back, so rows are read twice and no task holds a group.
    """
    logged = rows.withColumn("_log", _log_price())
    counts = checkpointed(logged.where("_log is not null").groupBy(*keys, "_log").agg(F.count("*").alias("_n")))
    return logged.join(_spread(counts, keys), keys, "left").withColumn("price_outlier", _is_outlier()).drop("_log", "_mid", "_rows", "_mad")


def _money(condition: Column | None = None) -> Column:
    price = F.col("total_price").cast("decimal(18,2)")
    return F.coalesce(F.sum(price if condition is None else F.when(condition, price)), F.lit(0)).cast("double")


def price_cells(rows: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, category, _log, _sus, _resolved, _n, _price, _weight): rows folded by what the baselines ask of them.

    One pass over the rows, which may be a join of many tables; counts, medians, outliers and sums all follow from these
    cells, written down once. Rows of one price per pound fold on the map side.
    """
    sus = F.coalesce(F.col("validated") == "Y", F.lit(False))
    keys = [*scope, "category", _log_price().alias("_log"), sus.alias("_sus"), (F.col("weight_source") != "unresolved").alias("_resolved")]
    own = rows.select(*keys, F.col("total_price").cast("decimal(18,2)").alias("_p"), F.col("total_weight_lbs").cast("decimal(18,4)").alias("_w"))
    return checkpointed(own.groupBy(*scope, "category", "_log", "_sus", "_resolved").agg(F.count("*").alias("_n"), F.sum("_p").alias("_price"), F.sum("_w").alias("_weight")))


def category_baseline(rows: DataFrame, scope: list[str], factors: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a scope and category. rows: category, total_price, total_weight_lbs, weight_source, validated (Y/N/NA).

    factors: (ord, food_category, factor), the first row of a trimmed name counts; groups: (category, food_group).
    """
    return _baseline_of(price_cells(rows, scope), scope, factors, groups)


def _baseline_of(cells: DataFrame, scope: list[str], factors: DataFrame, groups: DataFrame) -> DataFrame:
    keys = [*scope, "category"]
    own = cells.where("category is not null")
    counts = own.where("_log is not null").groupBy(*keys, "_log").agg(F.sum("_n").alias("_n"))
    flagged = own.join(_spread(counts, keys), keys, "left").withColumn("_out", _is_outlier())
    sus, out = F.col("_sus"), F.col("_out")
    trusted = F.col("_resolved") & ~out
    total = lambda c, when=None: F.coalesce(F.sum(F.col(c) if when is None else F.when(when, F.col(c))), F.lit(0)).cast("double")
    sums = flagged.groupBy(*keys).agg(
        total("_price").alias("baseline_spend"), total("_price", sus).alias("baseline_sustainable_spend"),
        total("_weight", trusted & sus).alias("sustainable_weight_lbs"), total("_weight", trusted & ~sus).alias("conventional_weight_lbs"),
        total("_price", trusted).alias("_trusted"), total("_price", trusted & sus).alias("_sus"), total("_price", trusted & ~sus).alias("_conv"),
        F.sum(F.when(out, F.col("_n")).otherwise(0)).alias("price_outlier_count"), total("_price", out).alias("price_outlier_spend"),
    )
    priced = sums.select(
        *keys, "baseline_spend", "baseline_sustainable_spend", F.round(F.col("baseline_spend") - F.col("baseline_sustainable_spend"), 2).alias("baseline_conventional_spend"),
        (F.col("sustainable_weight_lbs") + F.col("conventional_weight_lbs")).alias("baseline_weight_lbs"), "sustainable_weight_lbs", "conventional_weight_lbs",
        F.coalesce(F.try_divide("_trusted", F.nullif("baseline_spend", F.lit(0.0))), F.lit(0.0)).alias("weight_resolved_pct"),
        F.when(F.col("sustainable_weight_lbs") > 0, F.try_divide("_sus", "sustainable_weight_lbs")).alias("sustainable_price_per_lb"),
        F.when(F.col("conventional_weight_lbs") > 0, F.try_divide("_conv", "conventional_weight_lbs")).alias("conventional_price_per_lb"),
        "price_outlier_count", "price_outlier_spend",
    )
    first = factors.groupBy(F.trim("food_category").alias("category")).agg(F.min_by("factor", "ord").alias("ghg_factor_kg_per_kg"))
    return priced.join(first, "category", "left").join(groups, "category", "left").withColumn("food_group", F.coalesce("food_group", "category"))


def snapshot(baseline: DataFrame, unclassified: DataFrame, scope: list[str]) -> DataFrame:
    """Totals of a scope. unclassified: (scope, excluded_spend)."""
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    sums = baseline.groupBy(*scope).agg(
        dec("baseline_spend").alias("classified_spend"), dec("baseline_sustainable_spend").alias("sustainable_spend"), dec("price_outlier_spend").alias("price_outlier_spend"),
        F.sum("price_outlier_count").alias("price_outlier_count"), F.round(F.sum(ghg_kg(F.col("baseline_weight_lbs"), F.col("ghg_factor_kg_per_kg"))), 2).alias("total_ghg_kg"),
        F.sum(F.when(F.col("ghg_factor_kg_per_kg").isNull(), F.col("baseline_weight_lbs"))).alias("excluded_ghg_weight_lbs"),
        F.round(F.try_divide(F.sum(F.col("weight_resolved_pct") * F.col("baseline_spend")), F.sum("baseline_spend")), 8).alias("weight_resolved_pct"),
    )
    total = F.col("classified_spend") + F.coalesce("excluded_spend", F.lit(0.0))
    out = sums.join(unclassified, scope, "left").withColumn("total_spend", F.round(total, 2))
    return out.withColumn("sustainable_pct", F.round(F.try_divide("sustainable_spend", "total_spend"), 8)).withColumn("excluded_spend", F.coalesce("excluded_spend", F.lit(0.0)))


def snapshot_of(rows: DataFrame, scope: list[str], factors: DataFrame, groups: DataFrame) -> DataFrame:
    """The totals of each scope straight from its purchases, classified and not, in one pass over them."""
    cells = price_cells(rows, scope)
    without = cells.groupBy(*scope).agg(F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("_price"))), F.lit(0)).cast("double").alias("excluded_spend"))
    return snapshot(_baseline_of(cells, scope, factors, groups), without, scope)


def unclassified_spend(rows: DataFrame, scope: list[str]) -> DataFrame:
    return rows.groupBy(*scope).agg(_money(F.col("category").isNull()).alias("excluded_spend"))


def merge_purchases(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Purchases of merged products per key: sums, the weakest tier of rows that have a weight, first vendor, brands joined by ", " and
    source reports by "; ", a zero total as null. A key of one row keeps that row as it is."""
    one = F.col("n_rows") == 1
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lists = [("brand", ", "), *([("source_report_id", "; ")] if "source_report_id" in rows.columns else [])]
    # of strings a group holds little: of one row its source is the least, its brand the only one and its vendor the first, blank or not
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double").alias("_price"),
        F.sum(F.col("total_weight_lbs").cast("decimal(18,4)")).cast("double").alias("_weight"),
        F.min("weight_source").alias("_source"),
        F.max(F.when(F.col("total_weight_lbs").isNotNull(), tier_rank(F.col("weight_source")))).alias("_tier"),
        F.min_by("vendor", F.struct(blank("vendor"), *order)).alias("_vendor"),
        *(F.collect_set(c).alias(f"_{c}") for c, _ in lists),
        F.count("*").alias("n_rows"),
    )
    total = lambda c: F.when(one, F.col(c)).otherwise(F.nullif(c, F.lit(0.0)))
    listed = lambda c, sep: F.nullif(F.array_join(F.sort_array(F.array_remove(c, "")), sep), F.lit(""))
    return sums.select(
        *keys,
        total("_price").alias("total_price"),
        total("_weight").alias("total_weight_lbs"),
        F.when(one, F.col("_source")).otherwise(tier_name(F.coalesce("_tier", F.lit(len(TIERS) - 1)))).alias("weight_source"),
        F.when(one | ~blank("_vendor"), F.col("_vendor")).alias("vendor"),
        *(F.when(one, F.get(f"_{c}", F.lit(0))).otherwise(listed(f"_{c}", sep)).alias(c) for c, sep in lists),
        "n_rows",
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
