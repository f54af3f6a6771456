"""Recording trees: `<dir>/<patient>/<name>` with CSV or Parquet files of HEADER_TIMESTAMP, X, Y, Z, and what they are
converted to: `<dir>/patient_id=<patient>/recording=<name>/`, which `read` takes as well.

A file goes by its path as Spark writes it (`_metadata.file_path`) in every table, so that tables join by it.

    python -m triaxis.sources.recordings --single-file IN.csv OUT_DIR
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import resample_files

#: Fixed value: the names that count as recordings (date and time parts in groups 1 to 7).
NAME = r"^[\w-]+\.[\w-]+\.(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{3})-P\d{4}\.sensor\.(csv|parquet)$"
RAW = T.StructType([T.StructField("HEADER_TIMESTAMP", T.StringType()), *[T.StructField(a, T.DoubleType()) for a in "XYZ"]])
CONVERTED = T.StructType([*RAW, T.StructField("patient_id", T.StringType()), T.StructField("recording", T.StringType())])
FILES = "patient_id string, file_path string, file_ts timestamp_ntz, hour int, day_of_week int, file_size bigint"


def catalog(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row a recording file. A missing folder gives no rows; other files and files of no bytes are left out."""
    try:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.sensor.*").option("recursiveFileLookup", "true").load(data_dir)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FILES)
    path = F.col("_metadata.file_path")
    named = listed.select(path.alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("patient_id"), F.col("length").alias("file_size")).where(F.col("name").rlike(NAME))
    return named.withColumn("file_ts", file_time(F.col("name"))).select("patient_id", "file_path", "file_ts", F.hour("file_ts").alias("hour"), F.weekday("file_ts").alias("day_of_week"), "file_size")


def file_time(name: Column) -> Column:
    """The time that a recording's name says; null for other names."""
    piece = [F.regexp_extract(name, NAME, i) for i in range(1, 8)]
    written = F.concat(piece[0], F.lit("-"), piece[1], F.lit("-"), piece[2], F.lit(" "), piece[3], F.lit(":"), piece[4], F.lit(":"), piece[5], F.lit("."), piece[6])
    return F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz")


def patients(spark: SparkSession, data_dir: str) -> DataFrame:
    """patient_id of every sub-folder, whatever it holds. A missing folder gives no rows."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(data_dir)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = store.listStatus(top) if store.exists(top) else []
    names = [x.getPath().getName() for x in listed if x.isDirectory()]
    return spark.createDataFrame([(n.removeprefix("patient_id="),) for n in names], "patient_id string")


def size_mb(size=None):
    return (F.col("file_size") if size is None else size) / F.lit(1048576.0)


def read(spark: SparkSession, data_dir: str, form: str = "csv", single: bool = False) -> DataFrame:
    """patient_id, file_path, file_ts (from the name), row_idx (physical order), ts, x, y, z; a timestamp or number that
    cannot be read is null. form: csv, parquet (recordings as files of that kind) or converted (what `convert` wrote).
    single: x, y and z as 32-bit numbers."""
    reader = spark.read.schema(RAW).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.sensor.{form}")
    if form == "csv":
        # a file is one split, so that the order within it is its physical order
        rows = reader.option("header", "true").option("mode", "PERMISSIVE").option("multiLine", "true").csv(data_dir)
        rows = rows.select("*", F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("at"))
        order = Window.partitionBy("file_path").orderBy("at")
        rows = rows.withColumn("row_idx", F.row_number().over(order).cast("bigint") - 1)
    elif form == "converted":
        rows = spark.read.schema(CONVERTED).parquet(data_dir).withColumns({"file_path": F.concat_ws("/", "patient_id", "recording"), "row_idx": F.col("_metadata.row_index")})
    else:
        rows = reader.parquet(data_dir).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_idx"))
    ts = F.try_to_timestamp("HEADER_TIMESTAMP", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    parts = F.split("file_path", "/")
    axes = [F.col(a).cast("float" if single else "double").alias(a.lower()) for a in "XYZ"]
    return rows.select(F.element_at(parts, -2).alias("patient_id"), "file_path", file_time(F.element_at(parts, -1)).alias("file_ts"), "row_idx", ts.alias("ts"), *axes)


def validity(samples: DataFrame) -> DataFrame:
    """One row a file: n_rows, n_bad (rows whose time or an axis cannot be read), valid (there is none)."""
    bad = F.col("ts").isNull() | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    counted = samples.groupBy("patient_id", "file_path").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"))
    return counted.withColumn("valid", F.col("n_bad") == 0)


def load(samples: DataFrame, start: int = 0, end: int | None = None, ratio: float = 1.0) -> DataFrame:
    """The rows from start to before end of every file, then resampled by the ratio. Numbers under 0 count from a file's
    end; a file with a row that cannot be read gives no rows."""
    known = samples.join(validity(samples).where("valid").select("patient_id", "file_path", "n_rows"), ["patient_id", "file_path"])
    at = lambda i: F.lit(i) if i >= 0 else F.greatest(F.lit(0), F.col("n_rows") + i)
    some = known.where(F.col("row_idx") >= at(start))
    some = some if end is None else some.where(F.col("row_idx") < at(end))
    some = some.drop("n_rows")
    return resample_files(some, ratio) if ratio > 1 else some


def rows_between(samples: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """The rows from start to before end of every file; a range of row_idx that Parquet can skip by."""
    out = samples.where(F.col("row_idx") >= start)
    return out if end is None else out.where(F.col("row_idx") < end)


def row_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("patient_id", "file_path").agg(F.count("*").alias("n_rows"))


def convert(spark: SparkSession, source: str, target: str) -> None:
    """CSV recordings to snappy Parquet, same columns, timestamps as text; one distributed job. A folder becomes a tree
    by patient and recording, which read(form="converted") gives back; a single file becomes one folder."""
    reader = spark.read.schema(RAW).option("header", "true").option("multiLine", "true")
    if source.endswith(".csv"):
        reader.csv(source).write.mode("overwrite").option("compression", "snappy").parquet(target)
        return
    # a file is one split, so its rows stay in order in one part
    rows = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sensor.csv").csv(source)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = rows.select("*", F.element_at(parts, -2).alias("patient_id"), F.element_at(parts, -1).alias("recording"), F.monotonically_increasing_id().alias("at")).where(F.col("recording").rlike(NAME))
    sorted_ = named.sortWithinPartitions("patient_id", "recording", "at").drop("at")
    sorted_.write.mode("overwrite").option("compression", "snappy").partitionBy("patient_id", "recording").parquet(target)


def split_work(files: DataFrame, workers: int) -> DataFrame:
    """Adds worker: contiguous ranges of the files by patient and path, sizes one apart at most. Files are numbered
    within their patient; only the patients' counts are summed in one place."""
    at = F.row_number().over(Window.partitionBy("patient_id").orderBy("file_path")) - 1
    counts = files.groupBy("patient_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("patient_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("patient_id", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place, size = F.col("before") + at, F.floor(F.col("total") / workers)
    more = F.col("total") % workers  # workers with one file more
    worker = F.when(F.col("place") < more * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(more + F.floor((F.col("place") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return files.join(starts, "patient_id").withColumn("place", place).withColumn("worker", worker.cast("int")).select(*files.columns, "worker")


def limited(split: DataFrame, most: int = 5, megabytes: float = 5000.0) -> DataFrame:
    """What each worker takes before it stops: `most` files, or the first that brings it to so many megabytes."""
    order = Window.partitionBy("worker").orderBy("file_path")
    before = F.coalesce(F.sum("file_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = split.withColumns({"turn": F.row_number().over(order), "before": before})
    return turn.where((F.col("turn") <= most) & (size_mb(F.col("before")) < megabytes)).drop("turn", "before")


def work_totals(split: DataFrame) -> DataFrame:
    return split.groupBy("worker").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("bytes"))


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] != "--single-file":
        return 0
    spark = SparkSession.builder.appName("convert").getOrCreate()
    began = time.time()
    try:
        convert(spark, args[1], args[2])
    except Exception as e:  # the exit code says so
        print(f"not converted: {e}", file=sys.stderr)
        return 1
    print(f"{time.time() - began:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
