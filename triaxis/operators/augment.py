"""Augmentation of sequences with arrays x, y, z and a key; random numbers depend on seed and key alone."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.uniform import normal, uniform
from ..workers import send

AXES = ("x", "y", "z")


def invert(df: DataFrame) -> DataFrame:
    return df.withColumns({a: F.transform(a, lambda v: -v) for a in AXES})


def reverse_time(df: DataFrame) -> DataFrame:
    """Samples last to first; timestamps stay."""
    return df.withColumns({a: F.reverse(a) for a in AXES})


def scale(df: DataFrame, key: str, low: float = 0.8, high: float = 1.2, seed: int = 0) -> DataFrame:
    """One factor for each sequence and axis."""
    def by(a: str) -> Column:
        factor = low + (high - low) * uniform(seed, f"scale-{a}", F.col(key))
        return F.transform(a, lambda v: v * factor)

    return df.withColumns({a: by(a) for a in AXES})


def noise(df: DataFrame, key: str, mean: float = 0.0, std: float = 0.01, seed: int = 0) -> DataFrame:
    return df.withColumns({a: F.transform(a, (lambda c: lambda v, i: v + mean + std * normal(seed, f"noise-{c}", F.col(key), i))(a)) for a in AXES})


def rotate(df: DataFrame, key: str, max_degrees: float = 30.0, seed: int = 0) -> DataFrame:
    """Three angles a sequence, turned about x, then y, then z (fixed axes)."""
    angle = lambda a: F.radians((2 * uniform(seed, f"angle-{a}", F.col(key)) - 1) * max_degrees)
    trig = {f"__{f}{a}": (F.cos if f == "c" else F.sin)(angle(a)) for a in AXES for f in "cs"}
    df = df.withColumns(trig)
    cx, sx, cy, sy, cz, sz = (F.col(f"__{f}{a}") for a in AXES for f in "cs")
    rows = ((cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx), (sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx), (-sy, cy * sx, cy * cx))
    zipped = F.arrays_zip(*AXES)
    turned = {a: F.transform(zipped, (lambda r: lambda v: r[0] * v["x"] + r[1] * v["y"] + r[2] * v["z"])(r)) for a, r in zip(AXES, rows)}
    return df.withColumns(turned).drop(*trig)


def scramble(df: DataFrame, key: str, parts: int = 4, seed: int = 0) -> DataFrame:
    """Cuts each sequence in `parts` (the last takes what is left over) and joins them in another order, the same for
    all axes."""
    order = F.array_sort(F.array(*[F.struct(uniform(seed, f"part-{i}", F.col(key)).alias("u"), F.lit(i).alias("i")) for i in range(parts)]))
    size = F.floor(F.size("x") / parts).cast("int")

    def mixed(a: str) -> Column:
        cut = lambda p: F.slice(a, p["i"] * size + 1, F.when(p["i"] == parts - 1, F.size(a) - (parts - 1) * size).otherwise(size))
        return F.flatten(F.transform(order, cut))

    return df.withColumns({a: mixed(a) for a in AXES})


def shuffle_channels(df: DataFrame, batch: str, seed: int = 0) -> DataFrame:
    """One order of the axes for each batch."""
    order = F.array_sort(F.array(*[F.struct(uniform(seed, f"channel-{a}", F.col(batch)).alias("u"), F.lit(i).alias("i")) for i, a in enumerate(AXES)]))
    axes = F.array(*AXES)
    return df.withColumns({a: F.get(axes, F.get(order, F.lit(i))["i"]) for i, a in enumerate(AXES)})


def pipeline(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps one after the other."""
    for step in steps:
        if not callable(step):
            raise ValueError(f"not callable: {step!r}")
        df = df.transform(step)
    return df


def by_kernel(df: DataFrame, kernel: Callable[[np.ndarray, object], np.ndarray], key: str | None = None) -> DataFrame:
    """Replaces x, y, z by what the kernel makes of the matrix of all three, Arrow batch by batch."""
    send(df.sparkSession)
    names = df.columns
    kinds = {a: T.ArrayType(T.DoubleType()) for a in AXES}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [names.index(a) for a in AXES]
            columns = [b.column(i).to_pylist() for i in at]
            keys = b.column(names.index(key)).to_pylist() if key else [None] * b.num_rows
            made = [kernel(np.array(xyz, np.float64), k).tolist() for *xyz, k in zip(*columns, keys)]
            out = list(b.columns)
            for i, j in enumerate(at):
                out[j] = pa.array([m[i] for m in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, schema)


def time_warp(df: DataFrame, key: str, factor: float = 0.1, points: int = 5, seed: int = 0) -> DataFrame:
    def warp(axes: np.ndarray, k: object) -> np.ndarray:
        rng = np.random.default_rng(list(hashlib.md5(f"{seed}:warp:{k}".encode()).digest()))
        return kernels.time_warp(axes, rng.standard_normal(points), factor)

    return by_kernel(df, warp, key)


def bandpass(df: DataFrame, fs: float = 80, low: float = 0.5, high: float = 10, taps: int = 513) -> DataFrame:
    """Band-pass filtered axes and delay, half the taps in samples."""
    h = kernels.bandpass_taps(fs, low, high, taps)
    return by_kernel(df, lambda axes, _: np.array([kernels.fir(a, h) for a in axes])).withColumn("delay", F.lit(0.5 * taps))


def bandpass_array(values: Column, fs: float, low: float, high: float, taps: int) -> Column:
    """The same for few taps as an array expression."""
    h = kernels.bandpass_taps(fs, low, high, taps).tolist()
    weights = F.array(*[F.lit(float(v)) for v in h])
    part = lambda i: F.reverse(F.slice(values, F.greatest(i - (taps - 2), F.lit(1)), F.least(i + 1, F.lit(taps))))
    total = lambda a: F.aggregate(a, F.lit(0e0), lambda s, v: s + v)
    return F.transform(values, lambda _, i: total(F.zip_with(part(i), F.slice(weights, 1, F.least(i + 1, F.lit(taps))), lambda v, w: v * w)))


