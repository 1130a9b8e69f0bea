"""Progress as keyed latest state, and its schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def latest(updates: DataFrame, key: str, time: str, percentage: str, tie: str) -> DataFrame:
    """The last update of each key: key, at (minutes) and percentage. Partial maxima are taken before the shuffle."""
    last = F.max(F.struct(F.col(time).alias("at"), F.col(tie).alias("tie"), F.col(percentage).alias("percentage")))
    return updates.groupBy(key).agg(last.alias("last")).select(key, F.date_format("last.at", "yyyy-MM-dd HH:mm").alias("at"), F.col("last.percentage").alias("percentage"))


def reset(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """state with an empty time and 0 for the given keys."""
    marked = state.join(keys.select(key).distinct().withColumn("_reset", F.lit(True)), key, "left")
    return marked.withColumn("at", F.when(F.col("_reset"), "").otherwise(F.col("at"))).withColumn("percentage", F.when(F.col("_reset"), F.lit(0.0)).otherwise(F.col("percentage"))).drop("_reset")


def read(state: DataFrame, callers: DataFrame, key: str) -> DataFrame:
    """The percentage of each caller, 0 for unknown ones."""
    return callers.select(key).join(state, key, "left").select(key, F.coalesce("percentage", F.lit(0.0)).alias("percentage"))


def schedule(spark: SparkSession, parts: int) -> DataFrame:
    """step and percentage: one for each part, two fixed ones, ten while results are put together, and the end."""
    first = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.round(30 / (F.lit(parts) - i), 2)) if parts else F.array().cast("array<double>")
    last = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.round(45 + 50 / (F.lit(10) - i), 2))
    every = F.concat(first, F.array(F.lit(37.5), F.lit(45.0)), last, F.array(F.lit(100.0)))
    return spark.range(1).select(F.posexplode(every).alias("step", "percentage"))
