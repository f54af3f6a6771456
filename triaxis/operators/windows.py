"""Statistics over windows of the time of day, for all days together or per re-anchored day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import label, seconds_of_day
from ..functions.signal import axis_mean, magnitude, resampled_length

#: A file this many microseconds or more after the anchor opens a new day.
DAY = 86_400_000_000


def day_buckets(files: DataFrame) -> DataFrame:
    """patient_id, file_ts, day (from 1): the first file anchors day 1; a file 24 h or more after the anchor opens
    the next day and is its anchor. A fold over the few files of a patient."""
    times = files.groupBy("patient_id").agg(F.array_sort(F.collect_set(F.unix_micros(F.col("file_ts").cast("timestamp")))).alias("at"))
    begin = F.struct(F.lit(0).alias("day"), F.lit(None).cast("bigint").alias("anchor"), F.expr("cast(array() as array<struct<at:bigint,day:int>>)").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        opens = acc["anchor"].isNull() | (t - acc["anchor"] >= DAY)
        day = acc["day"] + opens.cast("int")
        return F.struct(day.alias("day"), F.when(opens, t).otherwise(acc["anchor"]).alias("anchor"), F.concat(acc["out"], F.array(F.struct(t.alias("at"), day.alias("day")))).alias("out"))

    folded = times.select("patient_id", F.explode(F.aggregate("at", begin, step, lambda acc: acc["out"])).alias("b"))
    return folded.select("patient_id", F.timestamp_micros("b.at").cast("timestamp_ntz").alias("file_ts"), F.col("b.day").alias("day"))


def statistics(samples: DataFrame, window_hours: float = 2.0, per_day: bool = False, by: tuple[str, ...] = ("patient_id",), skip_nulls: bool = False, ratio: float = 1.0) -> DataFrame:
    """by, [day], window_start, window_end, means and population deviations of x, y, z and the magnitude. Windows
    [s, s + width) from midnight on; the last may pass 24 h. A null axis makes the window's figures NaN unless
    skip_nulls. per_day: samples have a day. ratio over 1: each file is resampled first."""
    if ratio > 1:
        samples = resample_files(samples, ratio, keep=tuple(c for c in (*by, *(["day"] if per_day else [])) if c not in ("patient_id", "file_ts")))
    width = window_hours * 3600.0
    nan = lambda c: c if skip_nulls else F.coalesce(c, F.lit(float("nan")))
    keys = [*by, *(["day"] if per_day else [])]
    x, y, z = (nan(F.col(c).cast("double")) for c in "xyz")
    rows = samples.select(*keys, F.floor(seconds_of_day(F.col("ts")) / width).alias("w"), x.alias("x"), y.alias("y"), z.alias("z")).withColumn("m", magnitude(F.col("x"), F.col("y"), F.col("z")))
    aggregates = [f(c).alias(f"{n}_{a}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for c, a in zip("xyz", "xyz")]
    grouped = rows.groupBy(*keys, "w").agg(*aggregates, F.avg("m").alias("mean_magnitude"), F.stddev_pop("m").alias("std_magnitude"))
    start = F.col("w") * F.lit(width)
    names = ["mean_x", "mean_y", "mean_z", "std_x", "std_y", "std_z", "mean_magnitude", "std_magnitude"]
    return grouped.select(*by, label(start).alias("window_start"), label(start + width).alias("window_end"), *(["day"] if per_day else []), *names)


def summary(stats: DataFrame, by: str = "patient_id") -> DataFrame:
    """Windows, first start, last end, the least and greatest mean and deviation of the magnitude, and, where stats have
    days, the first and last day."""
    days = [F.min("day").alias("min_day"), F.max("day").alias("max_day")] if "day" in stats.columns else []
    return stats.groupBy(by).agg(
        F.count("*").alias("n_windows"),
        F.min("window_start").alias("first_start"),
        F.max("window_end").alias("last_end"),
        *[f(f"{c}_magnitude").alias(f"{n}_{c}_magnitude") for c in ("mean", "std") for n, f in (("min", F.min), ("max", F.max))],
        *days,
    )


def resample_files(samples: DataFrame, ratio: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each file's rows at even steps, linear between neighbours: every source row gives the one target that falls
    between it and the next, so a file takes one window and no join. Rows go by row_idx where it is known, else by time.
    keep: further columns, each the same in all of a file."""
    file = ["patient_id", *(c for c in ("file_path", "file_ts") if c in samples.columns), *keep]
    group = Window.partitionBy(*file)
    order = group.orderBy("row_idx" if "row_idx" in samples.columns else "ts")
    rows = samples.select(*file, "ts", "x", "y", "z", (F.row_number().over(order).cast("bigint") - 1).alias("i"), F.count("*").over(group).alias("n"), *[F.lead(c).over(order).alias(f"{c}2") for c in ("ts", "x", "y", "z")])
    rows = rows.withColumn("t", resampled_length(F.col("n"), ratio))
    i, n, t = F.col("i"), F.col("n"), F.col("t")
    j = F.when(i == n - 1, t - 1).when(t == 1, F.when(i == 0, 0).cast("bigint")).otherwise(F.ceil(i * (t - 1) / F.nullif(n - 1, F.lit(0).cast("bigint"))))
    j = F.when((t == 1) & (i > 0), F.lit(None).cast("bigint")).otherwise(j)
    rows = rows.withColumn("j", j).where(F.col("j").isNotNull() & ((i == n - 1) | (t == 1) | (F.col("j") * (n - 1) < (i + 1) * (t - 1))))
    at = F.when(t > 1, F.col("j") * (n - 1) / F.nullif(t - 1, F.lit(0).cast("bigint"))).otherwise(0e0) - i
    mid = lambda c: F.col(c) + at * (F.coalesce(F.col(f"{c}2"), F.col(c)) - F.col(c))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    ts = F.floor(micros("ts") + at * (F.coalesce(micros("ts2"), micros("ts")) - micros("ts")))
    return rows.select(*file, "j", F.timestamp_micros(ts).cast("timestamp_ntz").alias("ts"), *[mid(c).alias(c) for c in "xyz"])


def day_series(samples: DataFrame) -> DataFrame:
    """Rows of each day with their place, the axis mean, and the labels of about 12 ticks a day."""
    group = Window.partitionBy("patient_id", "day")
    place = F.row_number().over(group.orderBy("ts")) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(group) / 12))
    rows = samples.withColumn("pos", place).withColumn("step", step)
    tick = F.when(F.col("pos") % F.col("step") == 0, label(seconds_of_day(F.col("ts"))))
    return rows.select("patient_id", "day", "pos", "ts", "x", "y", "z", axis_mean(F.col("x"), F.col("y"), F.col("z")).alias("axis_mean"), tick.alias("tick"))
