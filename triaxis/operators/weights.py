"""Weights of hours, weekdays, patients and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hour_weights(spark: SparkSession, peaks=(8, 12, 18), peak: float = 2.0, base: float = 1.0) -> DataFrame:
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    extra = [h for h in peaks if not 0 <= h < 24]
    if extra:
        hours = hours.unionByName(spark.createDataFrame([(h,) for h in sorted(set(extra))], "hour int"))
    return hours.withColumn("weight", F.when(F.col("hour").isin(*peaks), F.lit(float(peak))).otherwise(F.lit(float(base))))


def day_weights(spark: SparkSession, weekend: float = 1.5, weekday: float = 1.0) -> DataFrame:
    days = spark.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    return days.withColumn("weight", F.when(F.col("day_of_week") >= 5, F.lit(float(weekend))).otherwise(F.lit(float(weekday))))


def file_weights(files: DataFrame, patients: DataFrame | None = None, hours: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """files with w, the product of the three weights; what a dimension lacks weighs 1."""
    w = F.lit(1e0)
    for table, key in ((patients, "patient_id"), (hours, "hour"), (days, "day_of_week")):
        if table is not None:
            name = f"{key}_weight"
            files = files.join(table.select(key, F.col("weight").alias(name)), key, "left")
            w = w * F.coalesce(name, F.lit(1e0))
    return files.withColumn("w", w).drop("patient_id_weight", "hour_weight", "day_of_week_weight")


def normalized(weighted: DataFrame, by: str = "patient_id") -> DataFrame:
    """Adds share: w over the sum of its group, even shares where that is 0."""
    group = Window.partitionBy(by)
    total = F.sum("w").over(group)
    return weighted.withColumn("share", F.when(total == 0, 1e0 / F.count("*").over(group)).otherwise(F.col("w") / F.nullif(total, F.lit(0e0))))


def patient_probability(weighted: DataFrame) -> DataFrame:
    """patient_id, mean_w, p: the mean (not the sum) of a patient's file weights, over the sum of these means."""
    means = weighted.groupBy("patient_id").agg(F.avg("w").alias("mean_w"))
    both = means.withColumn("total", means.agg(F.sum("mean_w")).scalar())
    checked = F.when(F.col("total") > 0, F.col("mean_w") / F.col("total")).otherwise(F.raise_error(F.lit("all weights are 0")).cast("double"))
    return both.select("patient_id", "mean_w", checked.alias("p"))
