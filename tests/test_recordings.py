import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from triaxis.functions import kernels, signal
from triaxis.loader import Loader
from triaxis.operators import augment, sampling, sequences, spectral, weights, windows
from triaxis.sources import recordings
from triaxis.streaming import live

NAME = "GT3XPLUS-AccelerationCalibrated-2x5x0.NEO1G22051089.{}-000-P0000.sensor.csv"


@pytest.fixture
def tree(tmp_path):
    """Two patients, three hours each with 5, 3 and 4 rows; a stray file; a patient without recordings."""
    for p in ("11", "12"):
        (tmp_path / p).mkdir()
        for h, n in enumerate((5, 3, 4)):
            at = dt.datetime(2000, 1, 4, 16 + h, 30)
            rows = [f"{at + dt.timedelta(seconds=i):%Y-%m-%d %H:%M:%S}.{'125' if i % 2 else '500000'},{i + 10 * h},{2 * i},{-i}" for i in range(n)]
            (tmp_path / p / NAME.format(f"{at:%Y-%m-%d-%H-%M-%S}")).write_text("HEADER_TIMESTAMP,X,Y,Z\n" + "\n".join(rows) + "\n")
    (tmp_path / "11" / "notes.sensor.txt").write_text("x")
    (tmp_path / "13").mkdir()
    (tmp_path / "13" / "notes.txt").write_text("x")
    (tmp_path / "14 a").mkdir()
    return str(tmp_path)


def loaded(spark, tree):
    samples = recordings.read(spark, tree)
    files = recordings.catalog(spark, tree).join(recordings.row_counts(samples), ["patient_id", "file_path"])
    return files, sequences.timeline(samples)


def test_catalog(spark, tree):
    rows = recordings.catalog(spark, tree).orderBy("patient_id", "file_ts").collect()
    assert len(rows) == 6 and rows[0].hour == 16 and rows[0].day_of_week == 1
    assert rows[0].file_ts == dt.datetime(2000, 1, 4, 16, 30)
    assert recordings.catalog(spark, tree + "/nowhere").isEmpty()
    assert {r.patient_id for r in recordings.patients(spark, tree).collect()} == {"11", "12", "13", "14 a"} and recordings.patients(spark, tree + "/nowhere").isEmpty()


def test_read_and_convert(spark, tree, tmp_path):
    got = recordings.read(spark, tree).where("patient_id = '11'").orderBy("file_path", "row_idx").collect()
    assert [r.row_idx for r in got] == [0, 1, 2, 3, 4, 0, 1, 2, 0, 1, 2, 3] and got[1].ts.microsecond == 125000
    assert recordings.rows_between(recordings.read(spark, tree), 2, 4).count() == 2 * (2 + 1 + 2)
    recordings.convert(spark, tree, str(tmp_path / "out"))
    assert spark.read.schema(recordings.RAW).parquet(str(tmp_path / "out")).dtypes[0] == ("HEADER_TIMESTAMP", "string")
    name = lambda df: sorted((r.patient_id, r.file_path.rsplit("/", 1)[1], r.file_ts, r.row_idx, r.ts, r.x, r.y, r.z) for r in df.collect())
    assert name(recordings.read(spark, str(tmp_path / "out"), "converted")) == name(recordings.read(spark, tree)) and len(got) == 12
    assert {r.patient_id for r in recordings.patients(spark, str(tmp_path / "out")).collect()} == {"11", "12"}
    one = next((tmp_path / "11").glob("*.csv"))
    assert recordings.main(["--single-file", str(one), str(tmp_path / "one.parquet")]) == 0 and recordings.main([]) == 0
    assert spark.read.parquet(str(tmp_path / "one.parquet")).columns == ["HEADER_TIMESTAMP", "X", "Y", "Z"]
    assert recordings.main(["--single-file", str(tmp_path / "none.csv"), str(tmp_path / "two.parquet")]) == 1


def test_files_join_by_path_and_bad_files_are_told(spark, tree, tmp_path):
    files, line = loaded(spark, tree)
    assert files.count() == 6 and [r.n_rows for r in files.orderBy("patient_id", "file_ts").collect()] == [5, 3, 4] * 2
    assert [(r.patient_id, r.global_idx) for r in line.orderBy("patient_id", "global_idx").collect()] == [(p, i) for p in ("11", "12") for i in range(12)]
    bad = tmp_path / "12" / NAME.format("2000-01-05-16-30-00")
    bad.write_text("HEADER_TIMESTAMP,X,Y,Z\n2000-01-05 16:30:00.000,1,2,3\nnever,1,2,3\n")
    samples = recordings.read(spark, tree)
    assert sorted((r.n_rows, r.n_bad, r.valid) for r in recordings.validity(samples).where("patient_id = '12'").collect()) == [(2, 1, False), (3, 0, True), (4, 0, True), (5, 0, True)]
    got = recordings.load(samples.where("patient_id = '12'"), -3)
    assert sorted((r.file_ts.hour, r.row_idx) for r in got.collect()) == [(16, 2), (16, 3), (16, 4), (17, 0), (17, 1), (17, 2), (18, 1), (18, 2), (18, 3)]
    half = recordings.load(recordings.read(spark, tree, single=True).where("patient_id = '11'"), 0, 4, ratio=2.0)
    assert [r.x for r in half.where("hour(file_ts) = 16").orderBy("j").collect()] == [0.0, 3.0]
    assert dict(recordings.read(spark, tree, single=True).dtypes)["x"] == "float"


def test_work_is_split_and_limited(spark, tree):
    for n in (1, 4, 5, 9):
        sizes = [r["count"] for r in recordings.split_work(recordings.catalog(spark, tree), n).groupBy("worker").count().orderBy("worker").collect()]
        assert sizes == [6 // n + (w < 6 % n) for w in range(min(n, 6))]
    split = recordings.split_work(recordings.catalog(spark, tree), 2)
    totals = {r.worker: (r.n_files, r.bytes) for r in recordings.work_totals(split).collect()}
    assert {w: n for w, (n, _) in totals.items()} == {0: 3, 1: 3}
    assert recordings.limited(split, most=2).groupBy("worker").count().collect() == [(0, 2), (1, 2)]
    small = min(r.file_size for r in split.collect()) / 1048576
    assert recordings.limited(split, megabytes=small).count() == 2  # the first file reaches it
    assert split.select(recordings.size_mb().alias("mb")).agg(F.sum("mb")).first()[0] == pytest.approx(sum(b for _, b in totals.values()) / 1048576)


def test_random_starts_and_model_input(spark, tree):
    files, line = loaded(spark, tree)
    starts = recordings.row_counts(recordings.read(spark, tree))
    got = sequences.random_starts(starts, 3, seed=4).collect()
    assert all(0 <= r.start_offset <= max(0, r.n_rows - 3) for r in got) and len({r.start_offset for r in got}) > 1
    assert {r.start_offset for r in sequences.random_starts(starts, 9).collect()} == {0}
    asked = sequences.random_starts(starts, 3, seed=4).withColumn("draw_id", F.monotonically_increasing_id())
    for r in sequences.extract_from_file(asked, recordings.read(spark, tree), 3).collect():
        assert r.n_valid == 3 and r.y == [2.0 * (r.start_offset + i) for i in range(3)]
    stretched = sequences.extract_from_file(asked.withColumn("start_offset", F.lit(1)), recordings.read(spark, tree), 4, ratio=2.0)
    assert {len(r.x) for r in stretched.collect()} == {4} and min(r.y[0] for r in stretched.collect()) == 2.0
    draws = spark.createDataFrame([(0, "11", 99), (1, "11", 0)], "draw_id long, patient_id string, start_offset long")
    rows = {r.draw_id: r for r in sequences.model_input(sequences.extract(draws, line, 4), 4).collect()}
    assert rows[0].accel == [[0.0] * 4] * 3 and rows[0].ts == [0] * 4 and rows[0].patient_id == 11 and rows[1].accel[1] == [0.0, 2.0, 4.0, 6.0]
    assert sequences.model_input(sequences.extract(draws.withColumn("patient_id", F.lit("p-1")), line, 4), 4).first().patient_id is None


def test_many_asked_blocks_are_shuffled(spark, tree, monkeypatch):
    _, line = loaded(spark, tree)
    asked = spark.createDataFrame([(i, "11", i) for i in range(12)], "draw_id long, patient_id string, start_offset long")
    few = sorted(sequences.extract(asked, line, 4, block=2).collect())
    monkeypatch.setattr(sequences, "FEW", 3)
    assert sorted(sequences.extract(asked, line, 4, block=2).collect()) == few


def test_epoch_loss(spark):
    r = sequences.epoch_loss(spark.createDataFrame([(0, 1.0), (1, 3.0)], "batch_id long, loss double")).first()
    assert (r.n_batches, r.loss) == (2, 2.0)


def test_window_statistics_of_resampled_files(spark, tree):
    samples = recordings.read(spark, tree).withColumn("day", F.lit(1))
    stats = windows.statistics(samples, 1.0, per_day=True, ratio=2.0)
    got = {(r.patient_id, r.window_start): r.mean_x for r in stats.collect()}
    assert got[("11", "16:00")] == 2.0 and got[("11", "17:00")] == 10.0 and got[("11", "18:00")] == 21.5
    s = windows.summary(stats).where("patient_id = '11'").first()
    assert (s.n_windows, s.min_day, s.max_day) == (3, 1, 1)
    assert windows.statistics(samples.limit(0)).isEmpty()


def test_time_warps_depend_on_seed_and_key(spark):
    df = spark.createDataFrame([(k, [float(i * i) for i in range(20)]) for k in ("3", "-3", "3")], "id string, x array<double>").withColumns({"y": F.col("x"), "z": F.col("x")})
    a, b, c = (r.x for r in augment.time_warp(df, "id", seed=1).collect())
    assert a == c and a != b


def test_unreadable_fields_are_null(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / NAME.format("2000-01-04-16-30-00")).write_text("HEADER_TIMESTAMP,X,Y,Z\nnever,1,,3\n")
    row = recordings.read(spark, str(tmp_path)).first()
    assert row.ts is None and row.x == 1.0 and row.y is None


def test_draws_are_the_same_on_any_partitioning(spark, tree):
    files, _ = loaded(spark, tree)
    w = weights.file_weights(files)
    one = sampling.draws(spark, w, 200, 5).collect()
    two = sampling.draws(spark, w.repartition(7), 200, 5).collect()
    assert sorted(one) == sorted(two) and len(one) == 200
    share = sum(r.patient_id == "11" for r in one) / 200
    assert 0.35 < share < 0.65
    once = sampling.draws(spark, w, 10, 5, replace=False).collect()
    assert sorted(r.patient_id for r in once) == ["11", "12"]


def test_zero_weights_raise(spark, tree):
    files, _ = loaded(spark, tree)
    with pytest.raises(Exception, match="all weights are 0"):
        weights.patient_probability(files.withColumn("w", F.lit(0e0))).collect()
    shares = weights.normalized(files.withColumn("w", F.lit(0e0))).select("share").distinct().collect()
    assert [r.share for r in shares] == [pytest.approx(1 / 3)]


def test_sequences_cross_files_and_fill_on_the_left(spark, tree):
    _, line = loaded(spark, tree)
    asked = spark.createDataFrame([(0, "11", 3), (1, "11", 10), (2, "11", 99)], "draw_id long, patient_id string, start_offset long")
    got = {r.draw_id: r for r in sequences.extract(asked, line, 4, block=2).collect()}
    assert got[0].x == [3.0, 4.0, 10.0, 11.0] and got[0].n_valid == 4
    assert got[1].x == [signal.PAD, signal.PAD, 22.0, 23.0] and got[1].ts[0] == got[1].ts[2]
    assert got[2].x == [signal.PAD] * 4 and got[2].n_valid == 0
    half = sequences.extract(asked, line, 2, ratio=2.0).where("draw_id = 0").first()
    assert half.x == [3.0, 11.0]


def test_loader(spark, tree):
    files, line = loaded(spark, tree)
    loader = Loader(spark, files, line, length=3, batch_size=4, n_samples=10, seed=1)
    assert len(loader) == 2 and len(list(loader)) == 2
    first = loader.get_batch(0)
    assert len(first.accel) == 4 and len(first.accel[0]) == 3 and loader.get_batch(2) is None
    before = sorted(loader.draws().collect())
    loader.update_weights(patients=spark.createDataFrame([("11", 0.0)], "patient_id string, weight double"))
    assert {r.patient_id for r in loader.draws().collect()} == {"12"} and before
    assert loader.patient_metadata().count() == 2
    assert loader.cache_stats() == {"cached": False, "size": 0, "bytes": 0, "keys": []}
    loader.cache_lengths()
    held = loader.cache_stats(2)
    assert held["cached"] and held["size"] == 6 and len(held["keys"]) == 2 and held["bytes"] > 0 and len(loader.draws().collect()) == 10
    loader.clear_cache()
    assert not loader.cache_stats()["cached"]
    with pytest.raises(ValueError):
        Loader(spark, files.limit(0), line)


def test_days_are_anchored_again(spark):
    at = [dt.datetime(2000, 1, 1, 10), dt.datetime(2000, 1, 2, 9, 59), dt.datetime(2000, 1, 2, 10), dt.datetime(2000, 1, 5), dt.datetime(2000, 1, 5, 23, 59), dt.datetime(2000, 1, 6)]
    files = spark.createDataFrame([("a", t) for t in at], "patient_id string, file_ts timestamp_ntz")
    got = [r.day for r in windows.day_buckets(files).orderBy("file_ts").collect()]
    assert got == [1, 1, 2, 3, 3, 4]


def test_window_statistics(spark):
    rows = [("a", dt.datetime(2000, 1, 1, 23, 0), 3.0, 4.0, 0.0), ("a", dt.datetime(2000, 1, 2, 23, 0), 3.0, 4.0, None)]
    s = spark.createDataFrame(rows, "patient_id string, ts timestamp_ntz, x double, y double, z double")
    r = windows.statistics(s, 5.0).first()
    assert (r.window_start, r.window_end, r.mean_x, r.std_x) == ("20:00", "25:00", 3.0, 0.0) and r.mean_z != r.mean_z
    r = windows.statistics(s, 5.0, skip_nulls=True).first()
    assert r.mean_z == 0.0 and r.mean_magnitude == 5.0


def test_resampling_of_files(spark):
    rows = [("a", dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1, 0, 0, i), float(i * i), 0.0, 0.0) for i in range(7)] + [("b", dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1), 5.0, 0.0, 0.0)]
    s = spark.createDataFrame(rows, "patient_id string, file_ts timestamp_ntz, ts timestamp_ntz, x double, y double, z double")
    for ratio, want in ((2.0, [0.0, 9.0, 36.0]), (3.7, [0.0])):
        got = windows.resample_files(s, ratio).where("patient_id = 'a'").orderBy("j").collect()
        assert [r.x for r in got] == want
    assert windows.resample_files(s, 2.0).where("patient_id = 'b'").count() == 1  # shorter than the ratio: unchanged


def test_augmentation_steps_must_be_callable(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0], [5.0, 6.0])], "id long, x array<double>, y array<double>, z array<double>")
    assert augment.pipeline(df, [augment.invert, augment.reverse_time]).first().x == [-2.0, -1.0]
    with pytest.raises(ValueError):
        augment.pipeline(df, ["no"])


def test_stream_matches_batch(spark, tmp_path):
    rows = [("a", dt.datetime(2000, 1, 1, h, m), 1.0 * h, 2.0, 3.0) for h in range(6) for m in (0, 30)]
    s = spark.createDataFrame(rows, "patient_id string, ts timestamp_ntz, x double, y double, z double")
    s.write.parquet(str(tmp_path / "in"))
    stream = live.live_statistics(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("live").collect()) == sorted(live.live_statistics(s).collect())


def test_hourly_bands(spark):
    """Files of one second, and ids with any sign in them, are kept apart; left-out files count in the offset."""
    r = np.random.default_rng(2)
    at = [dt.datetime(2000, 1, 1, 8), dt.datetime(2000, 1, 1, 8, 0, 0, 500_000), dt.datetime(2000, 1, 1, 10), dt.datetime(2000, 1, 1, 11)]
    signals = {(p, t): r.standard_normal((n, 3)) for p in ("a|b", "a") for t, n in zip(at, (80, 90, 10, 85))}
    rows = [(p, t, t + dt.timedelta(seconds=i / 2), *map(float, v)) for (p, t), x in signals.items() for i, v in enumerate(x)]
    s = spark.createDataFrame(rows, "patient_id string, file_ts timestamp_ntz, ts timestamp_ntz, x double, y double, z double")
    bands = {"low": (0.0, 0.4), "high": (0.4, 1.0)}
    got = {(h.patient_id, h.file_ts, h.band): h for h in spectral.hourly_bands(s.repartition(5), fs=2.0, frame=(8.0, 4.0), segment=(4.0, 2.0), bands=bands).collect()}
    kept = [(key, x) for key, x in signals.items() if len(x) >= 20]
    assert len(got) == 2 * len(kept)
    for (p, t), x in kept:
        f, _, power = kernels.welch(np.sqrt((x * x).sum(axis=1)), 2.0, 8.0, 4.0, 4.0, 2.0)
        for band, values in kernels.band_power(power, f, bands).items():
            h = got[p, t, band]
            assert h.power == pytest.approx(values.mean()) and h.offset_s == 3600 * at.index(t) and h.hour_label == f"{t:%H:%M}"
    top = {(x.patient_id, x.band): x for x in spectral.hourly_summary(spectral.hourly_bands(s, fs=2.0, limit=2, frame=(8.0, 4.0), segment=(4.0, 2.0), bands=bands)).collect()}
    for band in bands:
        first = [got["a", t, band].power for t in at[:2]]
        assert (top["a", band].peak_at, top["a", band].low_at) == (1 + np.argmax(first), 1 + np.argmin(first)) and top["a", band].mean_power == pytest.approx(np.mean(first))


def test_stream_drops_late_rows(spark, tmp_path):
    kind = "patient_id string, ts timestamp_ntz, x double, y double, z double"
    add = lambda *hours: spark.createDataFrame([("a", dt.datetime(2000, 1, 1, h, 10), float(h), 0.0, 0.0) for h in hours], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(0, 4)
    stream = live.live_statistics(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("late").start()
    for more in ((), (1, 3), (12,), (13,)):  # the first hour closed before its second row came; hour 3 is in time
        if more:
            add(*more)
        q.processAllAvailable()
    q.stop()
    got = {(r.window_start.hour, r.n) for r in spark.table("late").collect()}
    assert got == {(0, 1), (2, 1), (4, 1)}
