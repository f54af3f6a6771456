"""Array functions: magnitude, linear resampling, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: each axis of a padded sample, so that its magnitude is about 1 g.
PAD = 0.57735


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def axis_mean(x: Column, y: Column, z: Column) -> Column:
    return (x + y + z) / 3e0


def resampled_length(n: Column, ratio: float) -> Column:
    """Samples left of n after resampling by a ratio over 1; all of them if none would be left."""
    t = F.floor(n / F.lit(float(ratio))).cast("bigint")
    return F.when(t > 0, t).otherwise(n) if ratio > 1 else n


def resample(values: Column, length: Column) -> Column:
    """`length` values at even steps from the first value to the last, linear between neighbours."""
    n = F.size(values)
    step = (n - 1).cast("double") / F.nullif(length - 1, F.lit(0).cast("bigint"))
    at = lambda j: F.coalesce(j * step, F.lit(0e0))
    low = lambda j: F.least(F.floor(at(j)).cast("int"), n - 1)

    def value(j: Column) -> Column:
        i = low(j)
        a = F.get(values, i).cast("double")
        b = F.get(values, F.least(i + 1, n - 1)).cast("double")
        return a + (at(j) - i) * (b - a)

    grid = F.sequence(F.lit(0).cast("bigint"), F.greatest(length - 1, F.lit(0).cast("bigint")))
    return F.when((n > 0) & (length > 0), F.transform(grid, value)).otherwise(F.array().cast("array<double>"))


def pad_left(values: Column, length: int, fill: Column) -> Column:
    """The last `length` values, after as many fills as are missing."""
    n = F.size(values)
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(length) - n, F.lit(0))), F.slice(values, F.greatest(n - length, F.lit(0)) + 1, F.lit(length)))
