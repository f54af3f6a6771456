"""Uniform numbers that depend on a seed, a stream and a key alone, so they are the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *key: Column) -> Column:
    """In [0, 1): the first 32 bits of the md5 of seed:stream:key..."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, stream: str, *key: Column) -> Column:
    """Standard normal by Box-Muller; a uniform of 0 counts as 2 ** -33."""
    u = F.greatest(uniform(seed, stream + "-r", *key), F.lit(2.0**-33))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(seed, stream + "-a", *key))
