"""Deterministic weighted draws of (patient, offset), for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.uniform import uniform
from .weights import patient_probability

#: Slots of the unit interval by which draws meet the patients' stretches.
SLOTS = 1024


def stretches(probability: DataFrame, by: str = "patient_id") -> DataFrame:
    """Adds lo and hi: each row's stretch of the unit interval. Rows are laid out by the first byte of the md5 of
    their key, so sums run within 256 groups and over their totals."""
    cell = F.substring(F.md5(F.col(by).cast("string").cast("binary")), 1, 2)
    rows = probability.withColumn("cell", cell)
    inner = Window.partitionBy("cell").orderBy(by)
    within = rows.withColumn("upto", F.sum("p").over(inner))
    cells = rows.groupBy("cell").agg(F.sum("p").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0e0))
    placed = within.join(cells.select("cell", before.alias("before")), "cell")
    return placed.select(by, "p", (F.col("before") + F.col("upto") - F.col("p")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi"))


def draw_patients(spark: SparkSession, probability: DataFrame, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """draw_id, patient_id: n draws with replacement; a draw and its stretch meet by slot."""
    draws = spark.range(n).select(F.col("id").alias("draw_id"), uniform(seed, "patient", F.lit(epoch), F.col("id")).alias("u"))
    laid = stretches(probability)
    slots = laid.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") * SLOTS), F.least(F.floor(F.col("hi") * SLOTS), F.lit(SLOTS)))))
    met = draws.withColumn("slot", F.floor(F.col("u") * SLOTS)).join(slots, "slot").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.select("draw_id", "patient_id")


def draw_patients_once(probability: DataFrame, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """rank, patient_id: up to n different patients, one after the other by what weight is left."""
    u = F.greatest(uniform(seed, "once", F.lit(epoch), F.col("patient_id")), F.lit(2.0**-33))
    keyed = probability.where("p > 0").withColumn("key", -F.ln(u) / F.col("p"))
    top = keyed.orderBy("key", "patient_id").limit(n)
    return top.select((F.row_number().over(Window.orderBy("key", "patient_id")) - 1).alias("rank"), "patient_id")


def file_starts(files: DataFrame) -> DataFrame:
    """files with cum_len, the rows of the patient's files before."""
    before = Window.partitionBy("patient_id").orderBy("file_ts").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("cum_len", F.coalesce(F.sum("n_rows").over(before), F.lit(0).cast("bigint")))


def draws(spark: SparkSession, weighted: DataFrame, n: int, seed: int = 0, epoch: int = 0, replace: bool = True) -> DataFrame:
    """draw_id, patient_id, file_ts, start_offset. weighted: files with n_rows and w. The file is drawn by weight
    (evenly, if all are 0), the offset evenly over its rows. Patients without rows are left out."""
    group = Window.partitionBy("patient_id")
    full = weighted.withColumn("rows", F.sum("n_rows").over(group)).where("rows > 0").drop("rows")
    p = patient_probability(full)
    if replace:
        chosen = draw_patients(spark, p, n, seed, epoch)
    else:
        chosen = draw_patients_once(p, n, seed, epoch).select(F.col("rank").cast("bigint").alias("draw_id"), "patient_id")
    total = F.sum("w").over(group)
    share = F.when(total > 0, F.col("w") / F.nullif(total, F.lit(0e0))).otherwise(1e0 / F.count("*").over(group))
    shared = file_starts(full).withColumn("share", share)
    upto = shared.withColumn("hi", F.sum("share").over(group.orderBy("file_ts"))).withColumn("last", F.row_number().over(group.orderBy(F.desc("file_ts"))) == 1)
    laid = upto.select("patient_id", "file_ts", "n_rows", "cum_len", (F.col("hi") - F.col("share")).alias("lo"), F.when(F.col("last"), 2e0).otherwise(F.col("hi")).alias("hi"))
    u = chosen.withColumn("uf", uniform(seed, "file", F.lit(epoch), F.col("draw_id"))).withColumn("uo", uniform(seed, "offset", F.lit(epoch), F.col("draw_id")))
    met = u.join(laid, "patient_id").where((F.col("uf") >= F.col("lo")) & (F.col("uf") < F.col("hi")))
    return met.select("draw_id", "patient_id", "file_ts", (F.col("cum_len") + F.floor(F.col("uo") * F.col("n_rows"))).alias("start_offset"))
