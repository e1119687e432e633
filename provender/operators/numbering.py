"""Consecutive numbers in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.operators.lineage import checkpointed

_ROW_BITS = 33  # of monotonically_increasing_id(): the partition above, the place in it below


def numbered(df: DataFrame, order: list[Column | str], name: str = "number", first: int = 1) -> DataFrame:
    """df with ``name`` (long): 1, 2, 3, ... in ``order``, which should settle every tie that matters.

    Rows are dealt out by ranges of the order and sorted where they lie. Each keeps its partition and its place there; one count
    a partition comes to the driver and goes back as the partition's first number. The dealt rows are checkpointed, so that a
    lost executor can't number them anew.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())
    starts, so_far = [], first
    for p, n in sizes:
        starts.append((p, so_far))
        so_far += n
    known = spark.createDataFrame(starts, "_part long, _start long")
    out = placed.join(F.broadcast(known), part == F.col("_part"))
    return out.withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_place", "_part", "_start")
