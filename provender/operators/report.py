"""Report tables and an HTML page. The tables are a scope's few category rows; only they come to the driver."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    return F.when(x.isNull(), "–").otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "–").otherwise(F.format_string("%.1f%%", x))


def weight_chart(plans: DataFrame, scope: list[str]) -> DataFrame:
    """Bars scaled to the largest, the heaviest first."""
    top = F.max(F.greatest("baseline_weight_lbs", "optimized_weight_lbs")).over(Window.partitionBy(*scope))
    bar = lambda c: F.round(F.try_divide(c, F.nullif(top, F.lit(0.0))) * 100, 1)
    return plans.withColumns({"baseline_bar": bar("baseline_weight_lbs"), "optimized_bar": bar("optimized_weight_lbs")}).select(*scope, "category", "baseline_bar", "optimized_bar").orderBy(*scope, F.desc("baseline_bar"), "category")


def takeaways(movers: DataFrame, scope: list[str], k: int = 5) -> DataFrame:
    """The k largest gains (over a point), the k largest losses, and categories that cost no more when sustainable."""
    up, down = Window.partitionBy(*scope).orderBy(F.desc("delta_pts"), "category"), Window.partitionBy(*scope).orderBy("delta_pts", "category")
    gain = movers.where("delta_pts > 1").withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= k).withColumn("kind", F.lit("gainer"))
    loss = movers.where("delta_pts < -1").withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= k).withColumn("kind", F.lit("loser"))
    free = movers.where("cost_neutral_or_better and delta_pts > 1").withColumn("_r", F.lit(0)).withColumn("kind", F.lit("free win"))
    return gain.unionByName(loss).unionByName(free).select(*scope, "kind", "category", F.round("delta_pts", 4).alias("delta_pts"))


def glossary(certificates: DataFrame) -> DataFrame:
    """The certifications by name."""
    return certificates.select("certification_name", "abbreviation", "frameworks", "qualifier").orderBy("certification_name")


def sustainable_share(plans: DataFrame, scope: list[str]) -> DataFrame:
    """Chart rows: the sustainable share of each category before and after, the largest spend first."""
    return plans.where("in_optimization").select(*scope, "category", "baseline_sustainable_pct", "optimized_sustainable_pct", "baseline_spend").orderBy(*scope, F.desc("baseline_spend"), "category")


def scenario_table(plans: DataFrame, scope: list[str], scenario: str) -> DataFrame:
    """A scenario's table as it is printed: money, shares and change by category, the heaviest first."""
    return plans.orderBy(*scope, F.desc("baseline_weight_lbs"), "category").select(*scope, F.lit(scenario).alias("scenario"), "category", "food_group", money(F.col("baseline_spend")).alias("baseline"), money(F.col("optimized_spend")).alias("optimized"), percent(F.col("baseline_sustainable_pct")).alias("sustainable_before"), percent(F.col("optimized_sustainable_pct")).alias("sustainable_after"), percent(F.col("weight_pct_change")).alias("weight_change"))


def verdict(plans: DataFrame, scope: list[str], category: str, price: float, cap: float | None = None) -> DataFrame:
    """What became of an item that isn't bought yet: whether the plan takes it, how much, which share of its supply, and its
    price against today's. A row for each scope that has the category."""
    taken = F.col("hypothetical_weight_lbs")
    against = lambda c: F.when(F.col(c) > 0, F.round(F.lit(float(price)) / F.col(c), 2))
    share = F.round(taken / F.lit(float(cap)) * 100, 1) if cap else F.lit(None).cast("double")
    return plans.where(F.col("category") == category).select(*scope, "category", F.when(taken > 0, "competitive").otherwise("not competitive").alias("verdict"), F.round(taken, 2).alias("adopted_lbs"), share.alias("share_of_cap_pct"), against("sustainable_price_per_lb").alias("times_sustainable_price"), against("conventional_price_per_lb").alias("times_conventional_price"))


def largest_cut(totals: DataFrame, scope: list[str]) -> DataFrame:
    """The cost reduction that the cheapest plan of each scope reaches, in percent, 0 at least; null if it has none."""
    cut = F.greatest(-F.col("cost_pct_change"), F.lit(0.0))
    return totals.select(*scope, F.when(F.col("status") == "optimal", cut).alias("max_cut_pct"))


def caveats(snapshot: DataFrame) -> DataFrame:
    """What a reader has to know of a snapshot, as a list."""
    said = F.array(
        F.when(F.col("weight_resolved_pct") < 0.95, "weights cover under 95% of spend"),
        F.when(F.col("excluded_spend") > 0, "some spend has no category"),
        F.when(F.col("price_outlier_count") > 0, "price outliers are left out of weights"),
    )
    return snapshot.withColumn("caveats", F.array_join(F.filter(said, lambda x: x.isNotNull()), "; "))


def page(title: str, sections: dict[str, DataFrame], rows_a_page: int = 200) -> list[str]:
    """HTML pages of tables. A table of over ``rows_a_page`` rows goes on on further pages, so no page grows without end;
    rows come to the driver one partition at a time."""
    pages: list[list[str]] = [[]]
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        cell = lambda v: html.escape("–" if v is None else f"{v:,.2f}" if isinstance(v, float) else str(v))
        body, at = [], 0
        for r in df.toLocalIterator():
            if len(body) == rows_a_page:
                _table(pages, at, name, head, body)
                body, at = [], at + 1
            body.append("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>")
        _table(pages, at, name, head, body)
    start = lambda n: f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}{f' ({n + 1})' if n else ''}</h1>"
    return [start(i) + "".join(p) + "</body></html>" for i, p in enumerate(pages)]


def _table(pages: list[list[str]], at: int, name: str, head: str, body: list[str]) -> None:
    while len(pages) <= at:
        pages.append([])
    pages[at].append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{''.join(body)}</table>")
