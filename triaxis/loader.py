"""A loader over one lazy plan: files, weights, draws, sequences, batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import sampling, sequences, weights


@dataclass
class Loader:
    """files: patient_id, file_ts, hour, day_of_week, n_rows. samples: patient_id, global_idx, ts, x, y, z. Weights
    are tables of a key and weight; without one a dimension is uniform. Draws depend on seed and epoch alone."""

    spark: SparkSession
    files: DataFrame
    samples: DataFrame
    length: int = 1000
    ratio: float = 1.0
    batch_size: int = 32
    n_samples: int = 10_000
    seed: int = 0
    epoch: int = 0
    replace: bool = True
    tables: dict[str, DataFrame | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.files.isEmpty():
            raise ValueError("no recordings")

    def update_weights(self, patients: DataFrame | None = None, hours: DataFrame | None = None, days: DataFrame | None = None) -> None:
        """New weights for the next draws; None makes a dimension uniform."""
        self.tables = {"patients": patients, "hours": hours, "days": days}
        self.epoch += 1

    def draws(self) -> DataFrame:
        weighted = weights.file_weights(self.files, **self.tables)
        return sampling.draws(self.spark, weighted, self.n_samples, self.seed, self.epoch, self.replace)

    def sequences(self) -> DataFrame:
        return sequences.extract(self.draws(), self.samples, self.length, self.ratio)

    def batches(self) -> DataFrame:
        return sequences.batches(self.sequences(), self.batch_size, self.n_samples)

    def get_batch(self, i: int = 0) -> Row | None:
        """The i-th batch, or None past the last."""
        return self.batches().where(F.col("batch_id") == i).first()

    def __iter__(self) -> Iterator[Row]:
        return self.batches().orderBy("batch_id").toLocalIterator(prefetchPartitions=True)

    def __len__(self) -> int:
        return self.n_samples // self.batch_size

    def cache_lengths(self) -> None:
        """Keeps the table of files with their lengths for all draws to come."""
        self.files = self.files.persist()

    def clear_cache(self) -> None:
        self.files = self.files.unpersist()

    def cache_stats(self, first: int = 10) -> dict:
        """Whether the files are kept, how many there are, about how many bytes they take, and the first paths or times."""
        key = "file_path" if "file_path" in self.files.columns else "file_ts"
        held = self.files.is_cached
        size = self.files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() if held else 0
        n = self.files.count() if held else 0
        return {"cached": held, "size": n, "bytes": int(str(size)), "keys": [r[0] for r in self.files.select(key).orderBy("patient_id", key).limit(first).collect()] if held else []}

    def patient_metadata(self, known: DataFrame | None = None) -> DataFrame:
        """A row a patient; what is not known is null."""
        ids = self.files.select("patient_id").distinct()
        if known is not None:
            return ids.join(known, "patient_id", "left")
        return ids.withColumns({c: F.lit(None).cast("string") for c in ("age", "sex", "height", "weight", "diagnosis")})
