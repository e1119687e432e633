"""What is handed on about planned menus: headline figures, tables, rows of charts, a text, and files of all of them by scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.operators import menu

# How versions and kinds of spend are called.
VERSIONS = {"baseline": "Baseline", "optimized": "Optimized"}
KINDS = {"sustainable": "Sustainable", "conventional": "Conventional"}


def headline(summary: DataFrame) -> DataFrame:
    """A row a planned scenario: its figures beside the baseline's. summary: menu.scenario_summary()."""
    base = summary.where("scenario = 'baseline'").select(F.col("total_cost").alias("baseline_cost"), F.col("sus_spend").alias("baseline_sus_spend"), (F.col("sus_pct") * 100).alias("baseline_sus_pct"), F.col("total_ghg").alias("baseline_ghg"), F.lit(1).alias("_k"))
    plans = summary.where("scenario <> 'baseline'").withColumn("_k", F.lit(1))
    return plans.join(base, "_k").select(
        "scenario", "baseline_cost", F.col("total_cost").alias("optimized_cost"), "cost_pct_change", "baseline_sus_spend", F.col("sus_spend").alias("optimized_sus_spend"), "sus_spend_pct_change",
        "baseline_sus_pct", (F.col("sus_pct") * 100).alias("optimized_sus_pct"), "baseline_ghg", F.col("total_ghg").alias("optimized_ghg"), "ghg_pct_change",
    )


def _plain(x: Column) -> Column:
    """Two places at most, without zeros behind."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def category_table(frequency: DataFrame) -> DataFrame:
    """Shares of meals as they are printed. frequency: menu.category_frequency(); a category that is new has no change."""
    share = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    change = F.round("pct_change_meals", 2)
    return frequency.select("scenario", "category", share("baseline_share").alias("baseline_share"), share("optimized_share").alias("optimized_share"), F.when(change.isNotNull(), F.concat(F.when(change > 0, "+").otherwise(""), _plain(change), F.lit("%"))).alias("change"))


def details(rows: DataFrame) -> DataFrame:
    """A row a scenario and dish with what it was before, the largest changes of a category first. rows: menu.contributions()."""
    cost = lambda freq: F.col(freq) * F.col("cost")
    out = rows.where("scenario_ord > 0").select(
        "scenario", "category", "ingredient", F.col("baseline_freq").cast("double").alias("freq_baseline"), F.col("freq").alias("freq_optimized"), (F.col("freq") - F.col("baseline_freq")).alias("delta"),
        cost("baseline_freq").alias("baseline_cost"), cost("freq").alias("optimized_cost"), (F.col("baseline_freq") * F.col("sus_cost")).alias("baseline_sustainable_spend"), (F.col("freq") * F.col("sus_cost")).alias("optimized_sustainable_spend"),
        (F.col("baseline_freq") * F.col("ghg")).alias("baseline_ghg"), (F.col("freq") * F.col("ghg")).alias("optimized_ghg"),
    )
    return out.orderBy("scenario", "category", F.desc(F.abs("delta")), "ingredient")


def frequency_chart(frequency: DataFrame) -> DataFrame:
    """(scenario, category, version, meals): bars before and after."""
    long = frequency.select("scenario", "category", F.col("baseline_meals").alias("Baseline"), F.col("optimized_meals").alias("Optimized"))
    return long.unpivot(["scenario", "category"], list(VERSIONS.values()), "version", "meals")


def spend_chart(rows: DataFrame) -> DataFrame:
    """(scenario, category, version, spend_type, spend, label): spend by kind before and after; the label is the sustainable share of
    both kinds together, empty where nothing is spent. rows: menu.contributions()."""
    planned = rows.where("scenario_ord > 0")
    amount = lambda freq, what: F.round(F.sum(F.col(freq) * what), 4)
    conventional = F.col("cost") - F.col("sus_cost")
    sums = planned.groupBy("scenario", "category").agg(*(amount(freq, what).alias(f"{version} {kind}") for version, freq in (("Baseline", "baseline_freq"), ("Optimized", "freq")) for kind, what in (("Sustainable", F.col("sus_cost")), ("Conventional", conventional))))
    cells = []
    for v in VERSIONS.values():
        good, all_ = F.col(f"{v} Sustainable"), F.col(f"{v} Sustainable") + F.col(f"{v} Conventional")
        label = F.when(all_ > 0, F.format_string("%.0f%%", F.round(good / all_ * 100, 6))).otherwise("")
        cells += [F.struct(F.lit(v).alias("version"), F.lit(k).alias("spend_type"), F.col(f"{v} {k}").alias("spend"), label.alias("label")) for k in KINDS.values()]
    return sums.select("scenario", "category", F.explode(F.array(*cells)).alias("c")).select("scenario", "category", "c.*")


def narrative(heads: DataFrame, frequency: DataFrame, name: str) -> DataFrame:
    """(scenario, text): what a scenario changes, and which categories gain and lose the most meals in percent; ties by name."""
    known = F.when(F.col("pct_change_meals").isNotNull(), F.col("pct_change_meals"))
    ends = frequency.groupBy("scenario").agg(F.min_by(F.struct("category", "pct_change_meals"), F.struct(-known, "category")).alias("up"), F.min_by(F.struct("category", "pct_change_meals"), F.struct(known, "category")).alias("down"))
    text = F.format_string(
        f"%s for {name.replace('%', '%%')} changes total cost by %.1f%% relative to baseline, changes sustainable spend by %.1f%%, and changes greenhouse gas equivalents by %.1f%%. Sustainable spend as a share of total spend changes from %.1f%% to %.1f%%. The largest category increase is %s (%.1f%%), while the largest decrease is %s (%.1f%%).",
        "scenario", "cost_pct_change", "sus_spend_pct_change", "ghg_pct_change", "baseline_sus_pct", "optimized_sus_pct", "up.category", "up.pct_change_meals", "down.category", "down.pct_change_meals",
    )
    return heads.join(ends, "scenario").select("scenario", text.alias("text"))


def deliverables(rows: DataFrame, name: str) -> dict[str, DataFrame]:
    """All of them, each with a column ``scenario``. rows: menu.contributions() of the planned scenarios and the baseline."""
    frequency, heads = menu.category_frequency(rows), headline(menu.scenario_summary(rows))
    return {"headline_metrics": heads, "category_table": category_table(frequency), "ingredient_details": details(rows), "frequency_chart": frequency_chart(frequency), "spend_chart": spend_chart(rows), "scenario_summary": narrative(heads, frequency, name)}


def export(rows: DataFrame, name: str, folder: str) -> list[str]:
    """Writes the deliverables as folder/<what>/scenario=<scenario>: tables as CSV with a header, the narrative as text. One write a
    deliverable for all scenarios; rows of a scenario are brought together by the writer, never on the driver."""
    made = deliverables(rows, name)
    for what, df in made.items():
        if what == "scenario_summary":
            df.repartition("scenario").write.mode("overwrite").partitionBy("scenario").text(f"{folder}/{what}")
        else:
            df.repartition("scenario").sortWithinPartitions("scenario", *([c for c in ("category", "ingredient") if c in df.columns])).write.mode("overwrite").partitionBy("scenario").option("header", True).csv(f"{folder}/{what}")
    return sorted(made)
