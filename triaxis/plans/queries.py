"""The catalogue: each query applies one operator to whole tables of the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, kernels, signal
from ..operators import augment, sampling, sequences, spectral, weights, windows
from ..sources import fixtures
from ..streaming import live

#: Parameters shared with the SQL of the same names.
SEED, N_DRAWS, N_ONCE, LENGTH, RATIO, FILE_RATIO, BATCH = 7, 500, 40, 16, 2.0, 2.0, 32
FS, SIZE, STEP, AVERAGED, WELCH_FRAME, WELCH_STEP = 32.0, 32, 16, 3, 64, 32
BANDS = {"low": (0.0, 3.0), "middle": (3.0, 9.0), "high": (9.0, 16.0), "none": (40.0, 50.0)}
TAPS, CUT = 9, (2.0, 8.0)


def files(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.samples(spark, d)
    rows = s.groupBy("patient_id", "file_ts").agg(F.count("*").alias("n_rows"))
    return rows.withColumns({"hour": F.hour("file_ts"), "day_of_week": clock.weekday(F.col("file_ts"))})


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return weights.file_weights(files(spark, d), None, weights.hour_weights(spark), weights.day_weights(spark))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    return sequences.timeline(fixtures.samples(spark, d))


def all_draws(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draws(spark, weighted(spark, d), N_DRAWS, SEED)


def padded(spark: SparkSession, d: str) -> DataFrame:
    return sequences.extract(all_draws(spark, d), timeline(spark, d), LENGTH)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def signals(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d)
    return rows.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("ts")).cast("bigint") - 1).alias("idx"), "value")


def axes(spark: SparkSession, d: str) -> DataFrame:
    """Sequences with three axes: an embedding, and it shifted and turned round."""
    v = fixtures.vectors(spark, d)
    return v.select("vec_id", F.col("v").alias("x"), F.transform("v", lambda a: a * 2e0 + 1e0).alias("y"), F.reverse("v").alias("z"), (F.col("vec_id") % 10).alias("batch_id"))


def axes_long(df: DataFrame) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(F.arrays_zip("x", "y", "z")).alias("pos", "s"))
    return rounded(rows.select("vec_id", "pos", "s.x", "s.y", "s.z"), "x", "y", "z")


def file_catalog(spark, d):
    return files(spark, d)


def hour_weights(spark, d):
    return weights.hour_weights(spark)


def day_weights(spark, d):
    return weights.day_weights(spark)


def file_weights(spark, d):
    return weighted(spark, d).select("patient_id", "file_ts", "w")


def normalized_weights(spark, d):
    return rounded(weights.normalized(weighted(spark, d)).select("patient_id", "file_ts", "share"), "share")


def patient_probability(spark, d):
    return rounded(weights.patient_probability(weighted(spark, d)), "mean_w", "p")


def weighted_draws(spark, d):
    return all_draws(spark, d)


def draws_without_replacement(spark, d):
    p = weights.patient_probability(weighted(spark, d))
    return sampling.draw_patients_once(p, N_ONCE, SEED)


def file_offsets_cumulative(spark, d):
    return sampling.file_starts(files(spark, d)).select("patient_id", "file_ts", "n_rows", "cum_len")


def offset_asof_file(spark, d):
    found = sequences.offset_file(all_draws(spark, d), sampling.file_starts(files(spark, d)))
    return found.select("draw_id", "patient_id", "start_offset", "found_ts", "row_idx")


def extract_sequence_padded(spark, d):
    return rounded(sequences.long_form(padded(spark, d), "draw_id"), "x", "y", "z")


def extract_sequence_downsampled(spark, d):
    some = sequences.extract(all_draws(spark, d), timeline(spark, d), LENGTH, RATIO)
    return rounded(sequences.long_form(some, "draw_id").drop("ts"), "x", "y", "z")


def extract_file_sequence(spark, d):
    """Within single files, filled with 0."""
    path = lambda ts: F.concat_ws("|", F.col("patient_id").cast("string"), F.date_format(ts, "yyyy-MM-dd HH"))
    rows = fixtures.samples(spark, d).withColumn("file_path", path("file_ts"))
    rows = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("file_path").orderBy("ts")).cast("bigint") - 1)
    asked = offset_asof_file(spark, d).select("draw_id", "patient_id", path("found_ts").alias("file_path"), F.col("row_idx").alias("start_offset"))
    return rounded(sequences.long_form(sequences.extract_from_file(asked, rows, 4), "draw_id"), "x", "y", "z")


def live_statistics(spark, d):
    """The statistics that the stream gives, over the whole table."""
    return rounded(live.live_statistics(fixtures.samples(spark, d)), "mean_magnitude", "std_magnitude")


def batch_collate(spark, d):
    b = sequences.batches(padded(spark, d), BATCH, N_DRAWS)
    return b.select("batch_id", F.posexplode("draw_ids").alias("slot", "draw_id"), "patient_ids").select("batch_id", "slot", "draw_id", F.get("patient_ids", F.col("slot")).alias("patient_id"))


def batch_loss(spark, d):
    return rounded(sequences.batch_loss(padded(spark, d), BATCH, N_DRAWS), "loss")


def epoch_loss(spark, d):
    return rounded(sequences.epoch_loss(sequences.batch_loss(padded(spark, d), BATCH, N_DRAWS)), "loss")


STATS = ("mean_x", "mean_y", "mean_z", "std_x", "std_y", "std_z", "mean_magnitude", "std_magnitude")


def window_stats_combined(spark, d):
    return rounded(windows.statistics(fixtures.samples(spark, d), 2.0), *STATS)


def with_days(spark, d):
    s = fixtures.samples(spark, d)
    return s.join(windows.day_buckets(files(spark, d)), ["patient_id", "file_ts"])


def window_stats_per_day(spark, d):
    return rounded(windows.statistics(with_days(spark, d), 5.0, per_day=True), *STATS)


def window_stats_resampled(spark, d):
    return rounded(windows.statistics(fixtures.samples(spark, d), 2.0, ratio=FILE_RATIO), *STATS)


def window_days_summary(spark, d):
    s = windows.summary(windows.statistics(with_days(spark, d), 5.0, per_day=True))
    days = {c: F.col(c).cast("bigint") for c in ("min_day", "max_day")}
    return rounded(s.withColumns(days), "min_mean_magnitude", "max_mean_magnitude", "min_std_magnitude", "max_std_magnitude")


def window_stats_summary(spark, d):
    s = windows.summary(windows.statistics(fixtures.samples(spark, d), 2.0))
    return rounded(s, "min_mean_magnitude", "max_mean_magnitude", "min_std_magnitude", "max_std_magnitude")


def day_buckets(spark, d):
    return windows.day_buckets(files(spark, d)).withColumn("day", F.col("day").cast("bigint"))


def time_of_day(spark, d):
    s = clock.seconds_of_day(F.col("ts"))
    return fixtures.samples(spark, d).select("patient_id", "ts", F.round(s, 6).alias("tod"), clock.label(s).alias("label"))


def magnitude(spark, d):
    return rounded(fixtures.samples(spark, d).select("patient_id", "ts", signal.magnitude(F.col("x"), F.col("y"), F.col("z")).alias("m")), "m")


def axis_mean(spark, d):
    return rounded(fixtures.samples(spark, d).select("patient_id", "ts", signal.axis_mean(F.col("x"), F.col("y"), F.col("z")).alias("axis_mean")), "axis_mean")


def day_tick_labels(spark, d):
    rows = windows.day_series(with_days(spark, d))
    return rows.where(F.col("tick").isNotNull()).select("patient_id", F.col("day").cast("bigint").alias("day"), "pos", "tick")


def resample_file(spark, d):
    return rounded(windows.resample_files(fixtures.samples(spark, d), FILE_RATIO).select("patient_id", "file_ts", "j", "x", "y", "z"), "x", "y", "z")


def resample_sequence(spark, d):
    v = fixtures.vectors(spark, d).select("vec_id", F.posexplode(signal.resample(F.col("v"), F.lit(20).cast("bigint"))).alias("j", "value"))
    return rounded(v, "value")


def distinct_patients(spark, d):
    return all_draws(spark, d).select("patient_id").distinct()


def patient_share(spark, d):
    n = all_draws(spark, d).groupBy("patient_id").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("percent", 100e0 * F.col("n") / n.agg(F.sum("n")).scalar()), "percent")


def hour_histogram(spark, d):
    n = all_draws(spark, d).groupBy(F.hour("file_ts").alias("hour")).agg(F.count("*").alias("n"))
    return rounded(n.withColumn("percent", 100e0 * F.col("n") / n.agg(F.sum("n")).scalar()), "percent")


def sequence_duration(spark, d):
    p = padded(spark, d)
    first, last = F.element_at("ts", 1), F.element_at("ts", -1)
    return p.select("draw_id", "patient_id", first.alias("first_us"), last.alias("last_us"), F.round((last - first) / 1e6, 6).alias("seconds"))


def framed(spark, d):
    return spectral.framed_power(spectral.frames(signals(spark, d), SIZE, STEP), SIZE, FS)


def dft_power(spark, d):
    v = fixtures.vectors(spark, d).select(F.col("vec_id").alias("key"), F.lit(0).cast("bigint").alias("frame"), F.posexplode("v").alias("k", "value"))
    power = spectral.framed_power(v, 64, 64.0, "boxcar", linear=False)
    return rounded(power.select(F.col("key").alias("vec_id"), "bin", F.col("psd").alias("power")), "power")


def stft_frames(spark, d):
    return rounded(framed(spark, d).drop("freq_hz"), "psd")


def stft_average(spark, d):
    return rounded(spectral.average_frames(framed(spark, d), AVERAGED).drop("freq_hz"), "psd")


def welch_psd(spark, d):
    """Frames of several segments, the mean power of the segments of each."""
    inner = framed(spark, d)
    per, hop = (WELCH_FRAME - SIZE) // STEP, WELCH_STEP // STEP
    last = F.max("frame").over(Window.partitionBy("key"))
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("frame") - per) / hop))
    high = F.least(F.floor(F.col("frame") / hop), F.floor((last - per) / hop))
    spread = inner.withColumn("outer", F.when(low <= high, F.sequence(low, high))).where(F.col("outer").isNotNull()).withColumn("outer", F.explode("outer"))
    return rounded(spread.groupBy("key", F.col("outer").alias("frame"), "bin").agg(F.avg("psd").alias("psd")), "psd")


def band_power(spark, d):
    return rounded(spectral.band_power(framed(spark, d), BANDS), "power")


def spectrum_db(spark, d):
    mean = spectral.mean_spectrum(framed(spark, d))
    return rounded(mean.select("key", "bin", spectral.decibels(F.col("mean_psd")).alias("db")), "db")


def stft_kernel(spark, d):
    """The numpy form of stft_frames, with times and frequencies."""
    power = spectral.stft(signals(spark, d), FS, SIZE / FS, STEP / FS, pad=False, detrend=False)
    return rounded(power.select("key", F.col("frame").cast("bigint").alias("frame"), "time_s", "bin", "freq_hz", "psd"), "time_s", "freq_hz", "psd")


def welch_kernel(spark, d):
    power = spectral.welch(signals(spark, d), FS, WELCH_FRAME / FS, WELCH_STEP / FS, SIZE / FS, STEP / FS, pad=False, detrend=False)
    return rounded(power.select("key", F.col("frame").cast("bigint").alias("frame"), "bin", "psd"), "psd")


def stft_detrended(spark, d):
    """With the smooth baseline taken off and zeros at both ends."""
    return spectral.stft(signals(spark, d), 4.0, 8.0, 2.0)


def spectrogram_plain(spark, d):
    power = spectral.spectrogram(signals(spark, d), 100.0)
    return rounded(power.select("key", F.col("frame").cast("bigint").alias("frame"), "time_s", "bin", "freq_hz", "psd"), "time_s", "freq_hz", "psd")


def hourly_band(spark, d):
    """Subject's days stand in for files here, so that they hold enough samples."""
    s = fixtures.samples(spark, d).withColumn("file_ts", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    return spectral.hourly_bands(s, fs=2.0, frame=(8.0, 4.0), segment=(4.0, 2.0), bands={"low": (0.0, 0.4), "high": (0.4, 1.0)})


def hourly_band_power(spark, d):
    return hourly_band(spark, d)


def hourly_band_summary(spark, d):
    return spectral.hourly_summary(hourly_band(spark, d))


def stride_decimation(spark, d):
    return spectral.every_kth(signals(spark, d), 100, "key", "idx").select("key", "idx", "value")


def aug_invert(spark, d):
    return axes_long(augment.invert(axes(spark, d)))


def aug_reverse(spark, d):
    return axes_long(augment.reverse_time(axes(spark, d)))


def aug_scale(spark, d):
    return axes_long(augment.scale(axes(spark, d), "vec_id", seed=SEED))


def aug_noise(spark, d):
    return axes_long(augment.noise(axes(spark, d), "vec_id", 0.1, 0.01, SEED))


def aug_rotate(spark, d):
    return axes_long(augment.rotate(axes(spark, d), "vec_id", seed=SEED))


def aug_scramble(spark, d):
    return axes_long(augment.scramble(axes(spark, d), "vec_id", 5, SEED))


def aug_channel_shuffle(spark, d):
    return axes_long(augment.shuffle_channels(axes(spark, d), "batch_id", SEED))


def aug_pipeline(spark, d):
    return axes_long(augment.pipeline(axes(spark, d), [augment.reverse_time, augment.invert]))


def bandpass_fir(spark, d):
    v = fixtures.vectors(spark, d)
    out = v.select("vec_id", F.posexplode(augment.bandpass_array(F.col("v"), 64.0, *CUT, TAPS)).alias("pos", "value"))
    return rounded(out, "value")


def bandpass_long(spark, d):
    """The whole filter; its delay is the same for all."""
    out = augment.bandpass(axes(spark, d))
    return axes_long(out).join(out.select("vec_id", "delay"), "vec_id")


def time_warp(spark, d):
    return augment.time_warp(axes(spark, d), "vec_id", seed=SEED).select("vec_id", "x", "y", "z")


NOT_QUERIES = {"files", "weighted", "timeline", "all_draws", "padded", "rounded", "signals", "axes", "axes_long", "with_days", "framed", "hourly_band", "queries", "taps"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__}
    return {n: f for n, f in own.items() if n not in NOT_QUERIES}


def taps() -> list[float]:
    return kernels.bandpass_taps(64.0, *CUT, TAPS).tolist()
