"""Ordered weight resolution: first-match dictionaries and cascades with provenance, compiled into one expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.operators import patterns

REPORTED, COMPUTED, TABLE = "reported", "computed_tier2", "reference_table_tier3"


def first_match(name: Column, rows: list[tuple[str, object]]) -> Column:
    """The value of the first (pattern, value) that is found in the name, case aside; null if none. Values may be columns."""
    out = F.lit(None)
    for pattern, value in reversed(rows):
        out = F.when(name.rlike(f"(?i){pattern}"), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def first_match_join(names: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """The same for a dictionary (ord, pattern, value) of any size, over distinct names: (name, value). ord is a number of each row."""
    rows = dictionary.withColumn("_p", F.concat(F.lit("(?i)"), F.col("pattern")))
    pairs = patterns.matches(names.select(name).distinct(), rows, name, "_p")
    return pairs.groupBy(name).agg(F.min_by("value", "ord").alias("value"))


def by_count(name: Column, rows: list[tuple[str, float, str]], count: Column) -> Column:
    """Count-based dictionaries: 'case' rows are a case's weight, 'multiply' rows a piece's, times the count."""
    return first_match(name, [(p, F.lit(float(w)) if f == "case" else F.lit(float(w)) * count) for p, w, f in rows])


def cascade(*rules: tuple[Column, str], otherwise: Column | str = "unresolved") -> Column:
    """struct(weight, source) of the first rule that has a weight. A rule is (weight or null, tier)."""
    tries = [F.when(w.isNotNull(), F.struct(w.cast("double").alias("weight"), F.lit(t).alias("source"))) for w, t in rules]
    last = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.coalesce(*tries, F.struct(F.lit(None).cast("double").alias("weight"), last.alias("source")))
