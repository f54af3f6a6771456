"""Spectra of signals: numpy kernels per signal, and the same as joins with a table of sines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..workers import send

#: Longest frame whose table of sines (half its square in rows) goes to all workers.
WIDE = 1024
LONG = "key string, frame int, time_s double, bin int, freq_hz double, psd double"


def per_signal(signals: DataFrame, kernel: Callable[[np.ndarray], tuple]) -> DataFrame:
    """kernel over the values of each key in the order of idx; a row a frame and frequency. A signal must fit one
    task, as a recording file does."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        f, t, s = kernel(rows.sort_values("idx", kind="stable")["value"].to_numpy(np.float64))
        frame, bins = np.tile(np.arange(len(t)), len(f)), np.repeat(np.arange(len(f)), len(t))
        return pd.DataFrame({"key": str(rows["key"].iloc[0]), "frame": frame, "time_s": t[frame], "bin": bins, "freq_hz": f[bins], "psd": s.ravel()})

    send(signals.sparkSession)
    own = signals.select(F.col("key").cast("string").alias("key"), "idx", "value").where(F.col("value").isNotNull())
    return own.groupBy("key").applyInPandas(run, LONG)


def stft(signals: DataFrame, fs: float, window_sec: float, step_sec: float, **options) -> DataFrame:
    return per_signal(signals, lambda x: kernels.stft(x, fs, window_sec, step_sec, **options))


def stft_average(signals: DataFrame, fs: float, count: int, window_sec: float, step_sec: float, **options) -> DataFrame:
    return per_signal(signals, lambda x: kernels.stft_average(x, fs, count, window_sec, step_sec, **options))


def welch(signals: DataFrame, fs: float, frame_sec: float, frame_step_sec: float, window_sec: float, step_sec: float, **options) -> DataFrame:
    return per_signal(signals, lambda x: kernels.welch(x, fs, frame_sec, frame_step_sec, window_sec, step_sec, **options))


def spectrogram(signals: DataFrame, fs: float = 100, size: int = 256, overlap: int = 128) -> DataFrame:
    return per_signal(signals, lambda x: kernels.spectrogram(x, fs, size, overlap))


def frames(signals: DataFrame, size: int, step: int) -> DataFrame:
    """key, frame, k (place in the frame), value: each sample in every frame that covers it. Whole frames only."""
    group = Window.partitionBy("key")
    rows = signals.withColumn("n", F.count("*").over(group))
    last = F.floor((F.col("n") - size) / step)
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("idx") - (size - 1)) / step))
    high = F.least(last, F.floor(F.col("idx") / step))
    some = rows.where(f"n >= {size}").where(low <= high).withColumn("frame", F.explode(F.sequence(low, high)))
    return some.select("key", "frame", (F.col("idx") - F.col("frame") * step).alias("k"), "value")


def framed_power(cut: DataFrame, size: int, fs: float, win: str = "hann", linear: bool = True) -> DataFrame:
    """key, frame, bin, freq_hz, psd of framed signals: lines of least squares off, then products with a table of
    sines, which is as large as a frame is long squared and so is bounded by `size`."""
    spark = cut.sparkSession
    if linear:
        fit = cut.groupBy("key", "frame").agg(F.regr_slope("value", F.col("k").cast("double")).alias("b"), F.regr_intercept("value", F.col("k").cast("double")).alias("a"))
        cut = cut.join(fit, ["key", "frame"]).withColumn("value", F.col("value") - F.col("a") - F.col("b") * F.col("k"))
    w = kernels.window(win, size)
    basis = basis_table(spark, size, w)
    scale = F.when((F.col("bin") == 0) | (F.col("bin") * 2 == size), 1e0).otherwise(2e0) / float(fs * (w**2).sum())
    basis = F.broadcast(basis) if size <= WIDE else basis
    power = cut.join(basis, "k").groupBy("key", "frame", "bin").agg(F.sum(F.col("value") * F.col("c")).alias("re"), F.sum(F.col("value") * F.col("s")).alias("im"))
    return power.select("key", "frame", "bin", (F.col("bin") * float(fs) / size).alias("freq_hz"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * scale).alias("psd"))


def basis_table(spark: SparkSession, size: int, weights: np.ndarray) -> DataFrame:
    k, b = np.meshgrid(np.arange(size), np.arange(size // 2 + 1))
    angle = 2 * np.pi * k * b / size
    rows = pd.DataFrame({"k": k.ravel(), "bin": b.ravel(), "c": (np.cos(angle) * weights).ravel(), "s": (np.sin(angle) * weights).ravel()})
    return spark.createDataFrame(rows, "k long, bin int, c double, s double")


def average_frames(power: DataFrame, count: int) -> DataFrame:
    """psd averaged over each frame and the count - 1 before it; frames with fewer before are left out."""
    order = Window.partitionBy("key", "bin").orderBy("frame").rowsBetween(-(count - 1), 0)
    return power.withColumn("psd", F.avg("psd").over(order)).where(F.col("frame") >= count - 1)


def band_power(power: DataFrame, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """key, frame, band, power: Simpson's rule over the frequencies in (low, high]; 0 where there are none."""
    bands = bands or kernels.BANDS
    table = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, (a, b) in bands.items()])
    inside = power.withColumn("b", F.explode(F.filter(table, lambda x: (F.col("freq_hz") > x["low"]) & (F.col("freq_hz") <= x["high"])))).withColumn("band", F.col("b.band"))
    row = F.array_sort(F.collect_list(F.struct("freq_hz", "psd")))
    lists = inside.groupBy("key", "frame", "band").agg(row.alias("r"))
    n = F.size("r")
    h = (F.get(F.col("r.freq_hz"), n - 1) - F.get(F.col("r.freq_hz"), F.lit(0))) / F.nullif(n - 1, F.lit(0))
    odd = n - F.when(n % 2 == 0, 1).otherwise(0)
    basic = lambda i: F.when((i == 0) | (i == odd - 1), 1e0).when(i < odd, F.when(i % 2 == 1, 4e0).otherwise(2e0)).otherwise(0e0) / 3e0
    extra = lambda i: F.when(n % 2 == 0, F.when(i == n - 1, 5e0).when(i == n - 2, 8e0).when(i == n - 3, -1e0).otherwise(0e0) / 12e0).otherwise(0e0)
    weight = lambda i: F.when(n == 2, 0.5e0).otherwise(basic(i) + extra(i))
    area = F.aggregate(F.transform("r", lambda r, i: r["psd"] * weight(i) * h), F.lit(0e0), lambda a, v: a + v)
    known = lists.select("key", "frame", "band", F.when(n > 1, area).otherwise(0e0).alias("power"))
    every = power.select("key", "frame").distinct().withColumn("band", F.explode(F.array(*[F.lit(n) for n in bands])))
    return every.join(known, ["key", "frame", "band"], "left").select("key", "frame", "band", F.coalesce("power", F.lit(0e0)).alias("power"))


def decibels(psd):
    return 10e0 * F.log10(psd + 1e-10)


def mean_spectrum(power: DataFrame) -> DataFrame:
    return power.groupBy("key", "bin", "freq_hz").agg(F.avg("psd").alias("mean_psd"))


def hourly_bands(samples: DataFrame, fs: float = 80, limit: int = 24, frame=(8.0, 2.0), segment=(4.0, 2.0), least_sec: float = 10.0, bands: dict | None = None) -> DataFrame:
    """patient_id, file_ts, hour_label, offset_s, band, power: mean band power of the magnitude of a patient's first
    `limit` files; files under least_sec are left out, but count in offset_s (an hour a file)."""
    from ..functions.clock import label, seconds_of_day
    from ..functions.signal import magnitude
    from .sequences import numbered

    files = samples.groupBy("patient_id", "file_ts").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("patient_id").orderBy("file_ts")) - 1
    first = files.withColumn("offset_s", place * 3600).where((F.col("offset_s") < 3600 * limit) & (F.col("n") >= fs * least_sec)).drop("n")
    key = F.to_json(F.struct(F.col("patient_id").cast("string").alias("p"), F.unix_micros(F.col("file_ts").cast("timestamp")).alias("t"), "offset_s"))
    rows = numbered(samples).join(first, ["patient_id", "file_ts"])
    power = welch(rows.select(key.alias("key"), F.col("row_idx").alias("idx"), magnitude(F.col("x"), F.col("y"), F.col("z")).alias("value")), fs, *frame, *segment)
    mean = band_power(power, bands).groupBy("key", "band").agg(F.avg("power").alias("power"))
    told = mean.withColumn("k", F.from_json("key", "p string, t bigint, offset_s int"))
    ts = F.timestamp_micros("k.t").cast("timestamp_ntz")
    return told.select(F.col("k.p").alias("patient_id"), ts.alias("file_ts"), label(seconds_of_day(ts)).alias("hour_label"), F.col("k.offset_s").alias("offset_s"), "band", "power")


def hourly_summary(hourly: DataFrame) -> DataFrame:
    """patient_id, band: mean, most, least, and which kept file (from 1) is the first with the most and the least."""
    place = F.dense_rank().over(Window.partitionBy("patient_id").orderBy("file_ts"))
    return hourly.withColumn("at", place).groupBy("patient_id", "band").agg(F.avg("power").alias("mean_power"), F.max("power").alias("max_power"), F.min("power").alias("min_power"), F.max_by("at", F.struct("power", -F.col("at"))).alias("peak_at"), F.min_by("at", F.struct("power", "at")).alias("low_at"))


def every_kth(rows: DataFrame, most: int, by: str, order: str) -> DataFrame:
    """Rows at even strides, about `most` for each group."""
    group = Window.partitionBy(by)
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(group) / most))
    return rows.withColumn("pos", F.row_number().over(group.orderBy(order)) - 1).withColumn("stride", stride).where(F.col("pos") % F.col("stride") == 0).drop("stride")
