"""Exact top-k search by inner product over integer vectors.

A query is a sparse row: its non-zero components are terms, and a term's postings are the weights of all
candidates in that dimension. Each worker takes a block of candidates, adds weight times postings into a
dense array of scores term after term, picks the k best of the block by partition selection, and keeps the
best k of all its blocks; the lists of the workers are merged per query. Ties go to the smaller id.

Queries are handed to the workers in blocks of at most `QUERY_BYTES`, each with a pass over the candidates,
so any number of queries works. Vectors that are null or hold null or non-finite components take no part,
neither as query nor as candidate. Dimensions that a vector lacks have weight 0. A candidate with the
query's own id is not its answer. Repeated candidate rows are answers each; query rows that share an id are one
query, with the least of their vectors. Blocks whose scores may leave 64 bits are counted in integers of any size;
only an answer whose score leaves 64 bits raises an error. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once, ready

#: Bytes of the queries handed out at once, candidates scored at once.
QUERY_BYTES = 16 << 20
QUERIES_AT_ONCE, BLOCK_ROWS = 64, 4096
#: The fixed factor from components to integers.
SCALE = 1024


def usable(vector: str) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, good)


def scaled(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of the floors of vectors, filled up with zeros; integers of any size where 64 bits may not do."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = np.floor(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
    if np.abs(values).max(initial=0) < 2.0**62:
        values = values.astype(np.int64)
    else:
        values = np.array([int(v) for v in values.tolist()], object)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    wide = dims if dims is not None else int(size.max(initial=0))
    if len(size) and (size == wide).all():
        return values.reshape(len(size), wide)
    out = np.zeros((len(size), wide), values.dtype)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(values)) - np.repeat(offsets[:-1], size)
    fits = at < wide
    out[row[fits], at[fits]] = values[fits]
    return out


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.largest = int(np.abs(queries).max(initial=0))
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        wide = self.largest * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) >= 1 << 62
        kind = object if wide else np.int64
        postings, queries = np.ascontiguousarray(vectors.T).astype(kind), self.queries.astype(kind)
        by_id = np.argsort(ids, kind="stable")
        own = [np.searchsorted(ids[by_id], self.query_ids, side) for side in ("left", "right")]
        for q in range(0, len(self.query_ids), QUERIES_AT_ONCE):
            rows = queries[q : q + QUERIES_AT_ONCE]
            scores = np.zeros((len(rows), len(ids)), kind)
            for term in np.flatnonzero(rows.any(axis=0)):
                some = np.flatnonzero(rows[:, term])
                scores[some] += rows[some, term][:, None] * postings[term][None, :]
            for i in range(len(rows)):
                rest = np.delete(np.arange(len(ids)), by_id[own[0][q + i] : own[1][q + i]]) if own[0][q + i] < own[1][q + i] else np.arange(len(ids))
                score = scores[i][rest]
                if len(rest) > self.k and not wide:
                    at = np.flatnonzero(score >= np.partition(score, len(rest) - self.k)[len(rest) - self.k])
                    rest, score = rest[at], score[at]
                all_ids = np.concatenate([self.ids[q + i], ids[rest]])
                all_scores = np.concatenate([self.scores[q + i], score])
                top = np.lexsort((all_ids, -all_scores))[: self.k]
                self.ids[q + i], self.scores[q + i] = all_ids[top], all_scores[top]

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, candidate and score of all."""
        every = np.concatenate(self.scores)
        if every.dtype == object and any(abs(x) >= 1 << 63 for x in every.tolist()):
            raise OverflowError("an answer's score is beyond 64 bits")
        return np.repeat(self.query_ids, [len(x) for x in self.ids]), np.concatenate(self.ids), every.astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), key and score of the k best candidates of every query."""
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.where(usable(vector)).select(F.col(key).alias("id"), scaled(vector, scale).alias("v"), is_query.alias("asks"))
    asking = rows.where("asks and id is not null").groupBy("id").agg(F.min("v").alias("v"))
    size = asking.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    dims = size["d"] or 0
    passes = max(1, -(-size["n"] * 8 * max(dims, 1) // query_bytes))
    found = None
    for p in range(passes):
        block = (asking if passes == 1 else asking.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)).toArrow()
        ids = block["id"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        shared = spark.sparkContext.broadcast((ids, matrix(block["v"].combine_chunks(), dims) if len(ids) else np.zeros((0, dims), np.int64)))
        token = uuid.uuid4().hex

        def score(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            best = Best(*once("queries", token, lambda: shared.value), k)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    best.add(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(part.column(1), dims))
            if any(map(len, best.ids)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.answers()], names=["query_id", "id", "score"])

        one = rows.where(F.col("id").isNotNull()).select("id", "v").mapInArrow(score, "query_id long, id long, score long")
        found = one if found is None else found.unionByName(one)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
