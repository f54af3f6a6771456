"""Sequences of fixed length cut from patients' timelines across files, and batches of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import PAD, pad_left, resample
from ..functions.uniform import uniform

#: Rows of a timeline that share a block; draws meet samples by block.
BLOCK = 4096
#: Asked blocks that are sent to the samples; more are shuffled with them.
FEW = 100_000


def numbered(samples: DataFrame) -> DataFrame:
    """samples with row_idx: the place within their file, in the order of time unless it is known."""
    if "row_idx" in samples.columns:
        return samples
    order = Window.partitionBy("patient_id", "file_ts").orderBy("ts")
    return samples.withColumn("row_idx", F.row_number().over(order).cast("bigint") - 1)


def timeline(samples: DataFrame) -> DataFrame:
    """samples with global_idx: the place among all rows of the patient, files in the order of their time. Only a
    patient's files are put in order and summed; rows are numbered within their file."""
    rows = numbered(samples)
    files = rows.groupBy("patient_id", "file_ts").agg(F.count("*").alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.partitionBy("patient_id").orderBy("file_ts").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("patient_id", "file_ts", before.cast("bigint").alias("cum_len"))
    return rows.join(starts, ["patient_id", "file_ts"]).withColumn("global_idx", F.col("cum_len") + F.col("row_idx")).select(*samples.columns, "global_idx")


def random_starts(files: DataFrame, length: int, ratio: float = 1.0, seed: int = 0, epoch: int = 0) -> DataFrame:
    """start_offset for each row of files (with n_rows): evenly among the starts that leave int(length * ratio) rows, 0 if
    there are none; for extract_from_file."""
    places = F.greatest(F.lit(0), F.col("n_rows") - int(length * ratio)) + 1
    return files.withColumn("start_offset", F.floor(uniform(seed, "start", F.lit(epoch), F.col("patient_id"), F.col("file_path")) * places).cast("bigint"))


def offset_file(draws: DataFrame, files: DataFrame) -> DataFrame:
    """As-of join: the last file that begins at or before each offset. Intervals of the few files of a patient."""
    after = F.lead("cum_len").over(Window.partitionBy("patient_id").orderBy("cum_len", "file_ts"))
    laid = files.withColumn("next", F.coalesce(after, F.lit((1 << 63) - 1))).select("patient_id", F.col("file_ts").alias("found_ts"), "cum_len", "next")
    met = draws.join(laid, "patient_id").where((F.col("start_offset") >= F.col("cum_len")) & (F.col("start_offset") < F.col("next")))
    return met.select(*draws.columns, "found_ts", (F.col("start_offset") - F.col("cum_len")).alias("row_idx"))


def extract(draws: DataFrame, samples: DataFrame, length: int, ratio: float = 1.0, block: int = BLOCK, fill: float = PAD, stretch: bool = False) -> DataFrame:
    """draws with ts (microseconds), x, y, z (arrays of `length`) and n_valid. int(length * ratio) rows are read from
    start_offset on; missing ones are filled on the left (stretch: not when resampling), the time with the
    first one read, and a ratio over 1 resamples to `length`. Samples need global_idx."""
    raw = int(length * ratio)
    first = F.floor(F.col("start_offset") / block)
    last = F.floor((F.col("start_offset") + raw - 1) / block)
    asked = draws.withColumn("block", F.explode(F.sequence(first, last)))
    if asked.select("patient_id", "block").limit(FEW + 1).count() <= FEW:  # few blocks: samples stay where they are
        asked = F.broadcast(asked)
    keyed = samples.withColumn("block", F.floor(F.col("global_idx") / block)).select("patient_id", "block", "global_idx", "ts", "x", "y", "z")
    inside = (F.col("global_idx") >= F.col("start_offset")) & (F.col("global_idx") < F.col("start_offset") + raw)
    met = asked.join(keyed, ["patient_id", "block"]).where(inside)
    row = F.struct("global_idx", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "x", "y", "z")
    got = met.groupBy("draw_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    all_draws = draws.join(got, "draw_id", "left").withColumn("rows", F.coalesce("rows", F.expr("cast(array() as array<struct<global_idx:bigint,t:bigint,x:double,y:double,z:double>>)")))
    n = F.size("rows")
    out = {"n_valid": n}
    for name in ("t", "x", "y", "z"):
        values = F.transform("rows", (lambda c: lambda r: r[c].cast("double" if c != "t" else "bigint"))(name))
        gap = F.get(values, F.lit(0)) if name == "t" else F.lit(float(fill))
        if ratio > 1:
            whole = values if stretch else pad_left(values, raw, gap)
            new = resample(whole, F.when(F.size(whole) > 0, F.lit(length).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
            out["ts" if name == "t" else name] = F.transform(new, lambda v: F.floor(v)) if name == "t" else new
        else:
            out["ts" if name == "t" else name] = pad_left(values, length, gap)
    return all_draws.withColumns(out).drop("rows")


def extract_from_file(draws: DataFrame, samples: DataFrame, length: int, ratio: float = 1.0) -> DataFrame:
    """The same within single files (start_offset counts rows of file_path): filled with 0, and a short stretch
    is drawn out to `length` when resampling."""
    own = samples.withColumn("patient_id", F.col("file_path")).withColumn("global_idx", F.col("row_idx"))
    asked = draws.withColumn("patient_key", F.col("patient_id")).withColumn("patient_id", F.col("file_path"))
    return extract(asked, own, length, ratio, fill=0.0, stretch=True).withColumn("patient_id", F.col("patient_key")).drop("patient_key")


def long_form(sequences: DataFrame, *keep: str) -> DataFrame:
    """One row a sample: keep, pos, ts, x, y, z."""
    return sequences.select(*keep, F.posexplode(F.arrays_zip("ts", "x", "y", "z")).alias("pos", "s")).select(*keep, "pos", "s.ts", "s.x", "s.y", "s.z")


def batch_of(draw_id: Column, size: int) -> Column:
    return F.floor(draw_id / size)


def batches(sequences: DataFrame, size: int, total: int) -> DataFrame:
    """batch_id and its sequences in the order drawn; a last batch that is not full is dropped."""
    kept = sequences.withColumn("batch_id", batch_of(F.col("draw_id"), size)).where(F.col("batch_id") < total // size)
    row = F.struct("draw_id", "patient_id", "ts", F.array("x", "y", "z").alias("accel"))
    grouped = kept.groupBy("batch_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.select("batch_id", F.col("rows.draw_id").alias("draw_ids"), F.col("rows.patient_id").alias("patient_ids"), F.col("rows.ts").alias("ts"), F.col("rows.accel").alias("accel"))


def model_input(sequences: DataFrame, length: int) -> DataFrame:
    """What a model takes: patient as a number (null if it is none), patient_id_str, ts, and accel as three rows of 32-bit
    numbers. A sequence without any row read is all zeros, in its times too."""
    none = F.col("n_valid") == 0
    axis = lambda c: F.when(none, F.array_repeat(F.lit(0e0), length)).otherwise(F.col(c)).cast("array<float>")
    times = F.when(none, F.array_repeat(F.lit(0).cast("bigint"), length)).otherwise(F.col("ts"))
    return sequences.select("draw_id", F.col("patient_id").cast("string").try_cast("bigint").alias("patient_id"), F.col("patient_id").cast("string").alias("patient_id_str"), times.alias("ts"), F.array(*map(axis, "xyz")).alias("accel"))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """The mean of the batches' losses."""
    return losses.agg(F.count("*").alias("n_batches"), F.avg("loss").alias("loss"))


def batch_loss(sequences: DataFrame, size: int, total: int) -> DataFrame:
    """batch_id, loss: the mean square over all values of a batch."""
    square = lambda c: F.aggregate(c, F.lit(0e0), lambda a, v: a + v * v)
    kept = sequences.withColumn("batch_id", batch_of(F.col("draw_id"), size)).where(F.col("batch_id") < total // size)
    part = kept.select("batch_id", (square("x") + square("y") + square("z")).alias("s"), (F.size("x") + F.size("y") + F.size("z")).alias("n"))
    return part.groupBy("batch_id").agg((F.sum("s") / F.sum("n")).alias("loss"))
