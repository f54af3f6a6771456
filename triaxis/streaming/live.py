"""The window statistics over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import magnitude


def live_statistics(samples: DataFrame, width: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """patient_id, window, n, mean and deviation of the magnitude. On a stream, windows close when the watermark
    passes them; a batch gives the same rows."""
    rows = samples.withColumn("at", F.col("ts").cast("timestamp")).withColumn("m", magnitude(F.col("x"), F.col("y"), F.col("z")))
    if samples.isStreaming:
        rows = rows.withWatermark("at", late)
    stats = rows.groupBy("patient_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.avg("m").alias("mean_magnitude"), F.stddev_pop("m").alias("std_magnitude"))
    return stats.select("patient_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "mean_magnitude", "std_magnitude")
