"""The canonical tables: schemas, constraints as queries, additive migration, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "campuses": "campus string, primary_standard string, campus_type string, abbreviation string",
    "taxonomy": "category_id int, meat_type string, food_category string, factor double, factor_local double, nitrogen_content double, virtual_n_factor double, food_waste double",
    "food_groups": "category string, food_group string",
    "certification_types": "certification_name string, abbreviation string, frameworks string, qualifier string, needs_review int",
    "products": "product_id long, canonical_name string, category string, classification_source string, certs string, sustainable_yn string, certification_flag int, validated string, first_fy int, last_fy int",
    "product_aliases": "alias_id long, raw_name string, campus string, product_id long, match_confidence double, human_confirmed int",
    "purchases": "purchase_id long, campus string, fiscal_year int, product_id long, vendor string, brand string, total_price double, total_weight_lbs double, weight_source string, unit_price double, purchase_type string, n_rows int, source_report_id string",
    "candidates": "candidate_id long, campus_a string, campus_b string, a long, b long, score double, status string",
}
KEYS = {"campuses": "campus", "food_groups": "category", "certification_types": "certification_name", "products": "product_id", "product_aliases": "alias_id", "purchases": "purchase_id", "candidates": "candidate_id"}
# What the enumerated columns may hold.
VALUES = {
    ("campuses", "campus_type"): ["Academic", "Health"],
    ("products", "sustainable_yn"): ["Y", "N", "NA"],
    ("products", "validated"): ["Y", "N", "NA"],
    ("products", "classification_source"): ["campus_category", "keyword_match", "plant_based_override", "unclassified"],
    ("purchases", "weight_source"): ["reported", "computed_tier2", "reference_table_tier3", "unresolved"],
    ("purchases", "purchase_type"): ["service", "purchasing"],
    ("candidates", "status"): ["pending", "approved", "rejected"],
}
REFERENCES = [("product_aliases", "product_id", "products"), ("purchases", "product_id", "products"), ("candidates", "a", "products"), ("candidates", "b", "products"), ("purchases", "campus", "campuses")]


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str, fill: dict[str, object] | None = None) -> DataFrame:
    """The table's columns in order and type; missing ones are added, null or filled with a value or another column's name.
    Doing it twice changes nothing."""
    fill = fill or {}
    made = []
    for f in schema(table):
        if f.name in df.columns:
            value = F.col(f.name)
        elif isinstance(fill.get(f.name), str) and fill[f.name] in df.columns:
            value = F.col(fill[f.name])
        else:
            value = F.lit(fill.get(f.name))
        made.append(value.cast(f.dataType).alias(f.name))
    return df.select(*made)


def bad_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(value, n) outside the enumeration; null is allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, value, n): what breaks a key, an enumeration, a reference, or the order of a candidate's ids."""
    parts = []
    for (t, c), allowed in VALUES.items():
        if t in tables:
            parts.append(bad_values(tables[t], c, allowed).select(F.lit(f"{t}.{c}").alias("rule"), "value", "n"))
    for t, key in KEYS.items():
        if t in tables:
            parts.append(repeated_keys(tables[t], key).select(F.lit(f"{t} key").alias("rule"), "value", "n"))
    for t, c, parent in REFERENCES:
        if t in tables and parent in tables:
            parts.append(orphans(tables[t], c, tables[parent], KEYS[parent]).select(F.lit(f"{t}.{c} -> {parent}").alias("rule"), "value", "n"))
    if "candidates" in tables:
        wrong = tables["candidates"].where("a >= b").groupBy(F.lit("a < b").alias("value")).agg(F.count("*").alias("n"))
        parts.append(wrong.select(F.lit("candidates order").alias("rule"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot(df: DataFrame, root: str, table: str, version: str) -> str:
    """A new version of a table beside the old ones, which stay as its backup."""
    path = f"{root}/{table}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
