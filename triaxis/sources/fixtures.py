"""The driver's tables seen as recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, file_ts, ts, x, y, z: one row an event; the file of an event is its subject's hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    return events.select(
        F.col("user_id").alias("patient_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("file_ts"),
        "ts",
        F.col("value").alias("x"),
        number.cast("double").alias("y"),
        (F.col("event_id") % 13).cast("double").alias("z"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, idx, value: a long signal per event type, taken as evenly sampled."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("key"), "ts", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v: sequences of fixed length, as doubles."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
