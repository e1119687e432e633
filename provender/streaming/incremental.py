"""Incremental ingestion, an extension: new purchase files update aggregates as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.operators.baseline import TIERS, tier_name, tier_rank


def purchase_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def raw_name_totals(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals of each raw name; sums and the weakest tier merge from part to part, so the state is a row a name."""
    weakest = F.max(F.when(F.col("total_weight_lbs").isNotNull(), tier_rank(F.col("weight_source"))))
    return stream.where("raw_name is not null").groupBy(*keys, "raw_name").agg(
        F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double").alias("total_price"),
        F.sum(F.col("total_weight_lbs").cast("decimal(18,4)")).cast("double").alias("total_weight_lbs"),
        tier_name(F.coalesce(weakest, F.lit(len(TIERS) - 1))).alias("weight_source"),
        F.count("*").alias("n_rows"),
    )


def windowed_spend(stream: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Spend a window and campus; rows later than ``late`` behind the newest are dropped and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), "campus").agg(F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double").alias("spend"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Takes what is there, writes the result as one snapshot, and ends; the next call goes on from the checkpoint."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
