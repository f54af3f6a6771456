"""Toxicity by the nearest labelled examples.

Terms are a word and its first 4 and 6 bytes (A-Z lower-cased; words are digits, letters and all that is not
ASCII). From a bounded sample of labelled texts, at most `EXAMPLES` of each label and of at most
`EXAMPLE_BYTES` bytes, all terms are kept. The examples become TF-IDF vectors of
unit length, with the document frequencies of all texts; each term also weighs x / (x + `HALF_CHI2` + 2 ln of the
number of terms), where x is 1 + chi-squared of its presence and the label among the examples, so none weighs 0.
They stand in an inverted index: rare terms as lists, the others in blocks of `BLOCK` examples with the largest
weight of each block. A block is scored only for texts whose upper bound there reaches their `NEAREST`-th best
score so far, which gives the exact nearest examples by cosine. They vote with weight similarity ** 2 times the
inverse of their label's sampling rate, against a prior of weight `PRIOR`; the score is the share of votes for
the label, and the nearest ids are its evidence. Ties go to the example that comes first.

Labelled rows are drawn in the order of a hash of their key. One that shares half of the `SKETCH` least hashes of
three words with an example kept before under the same label is a near copy and left out, and drawing goes on
until the label has `EXAMPLES` examples or no rows are left.

A text without any term of an example (null and empty texts among them) has no evidence and one constant score:
the share of the label among the examples of which no term has a chi-squared over that sum, and one more at the base share. Without labelled rows every score is 0. All texts are scored whole. Repeated rows keep their
rows; extra columns keep their names, but one named like an added column gets underscores at its end. Keys are of any
type. An empty table gives no rows. Labels that are null teach nothing.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, apart, chunks, once, ready, text_buffer, word_hashes, word_spans
from .decontam import IS_WORD
from .jaccard import shingle_sets

EXAMPLES, EXAMPLE_BYTES = 1500, 16_384
#: A term weighs half where 1 + chi-squared is this plus 2 ln of the number of terms.
HALF_CHI2 = 4.0
#: Terms in at least one of FREQUENT examples are scored by blocks, the others by postings.
FREQUENT, BLOCKS_AT_ONCE, CELLS = 16, 8, 1 << 21
#: Counts that are summed together.
COUNTS = 8192
#: Places of the labelled rows in the order of drawing.
TOP = 1 << 52
NEAREST, BLOCK, PRIOR, EVIDENCE, SKETCH = 20, 64, 0.5, 3, 16


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, and the text of each."""
    data = LOWER[data]
    lo, hi, doc = word_spans(data, off, IS_WORD)
    four = np.minimum(lo + 4, hi)
    six = np.minimum(lo + 6, hi)
    return np.concatenate([word_hashes(data, lo, hi), word_hashes(data, lo, four) ^ np.uint64(4), word_hashes(data, lo, six) ^ np.uint64(6)]), np.concatenate([doc, doc, doc])


def sketches(data: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """The `SKETCH` least hashes of three words of every text; texts without words are alike."""
    hashes, size = shingle_sets(data, off, 3)
    cut = np.concatenate([[0], np.cumsum(size)])
    return [hashes[lo : min(lo + SKETCH, hi)].tolist() or [0] for lo, hi in zip(cut[:-1], cut[1:])]


class Seen:
    """Sketches kept so far."""

    def __init__(self) -> None:
        self.holders: dict[int, list[int]] = {}
        self.size = 0

    def near(self, least: list[int]) -> bool:
        """Whether one of them shares half of this sketch."""
        met = Counter(h for x in least for h in self.holders.get(x, ()))
        return max(met.values(), default=0) * 2 >= len(least)

    def add(self, least: list[int]) -> None:
        for x in least:
            self.holders.setdefault(x, []).append(self.size)
        self.size += 1


def entries(text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells (text, term) that occur, in order, and how often; terms are below n."""
    cell = np.sort(text * n + term)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    return cell[first] // max(n, 1), cell[first] % max(n, 1), np.diff(np.append(first, len(cell)))


class Lookup:
    """Places of hashes among sorted ones, by their leading bits."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        bits = min(24, max(1, len(terms).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(terms, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the places of those."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = len(self.terms) - 1
        at = np.minimum(self.first[hashes >> self.shift], last)
        less = np.flatnonzero(self.terms[at] < hashes)
        while len(less):
            at[less] += 1
            less = less[at[less] <= last]
            less = less[self.terms[at[less]] < hashes[less]]
        at = np.minimum(at, last)
        known = np.flatnonzero(self.terms[at] == hashes)
        return known, at[known]


class Index:
    """Labelled examples as unit TF-IDF vectors: postings of rare terms, blocks with maxima of frequent ones."""

    def __init__(self, ids: list, texts: list[str], labels: np.ndarray, rate: dict[int, float], held: Callable[[np.ndarray], tuple[int, np.ndarray]] | None = None, kind: T.DataType | None = None) -> None:
        self.kind = kind or T.LongType()  # of ids
        data, off = text_buffer(pa.array(texts, pa.large_string()))
        hashes, doc = terms(data, off)
        n = len(texts)
        self.terms, back = np.unique(hashes, return_inverse=True)
        row, col, tf = entries(doc, back, len(self.terms))
        weight = np.array([1 / rate[int(x)] for x in labels])
        df = np.bincount(col, minlength=len(self.terms)).astype(np.float64)
        yes = np.bincount(col, labels[row], len(self.terms))
        total, positive = float(n), float(labels.sum())
        no, miss = df - yes, positive - yes
        with np.errstate(divide="ignore", invalid="ignore"):
            chi2 = total * (yes * (total - positive - no) - no * miss) ** 2 / (df * (total - df) * positive * (total - positive))
        chi2 = np.nan_to_num(chi2, posinf=0.0)
        half = HALF_CHI2 + 2 * np.log(max(1, len(self.terms)))
        among, having = held(self.terms) if held else (n, df)
        self.lookup = Lookup(self.terms)
        self.idf = (np.log((1 + among) / (1 + having)) + 1) * (1 + chi2) / (1 + chi2 + half)
        value = (1 + np.log(tf)) * self.idf[col]
        value /= np.sqrt(np.bincount(row, value * value, n))[row]
        some = np.bincount(row, minlength=n) > 0
        blank = np.bincount(row, chi2[col] >= half, n) == 0  # holds no term that tells the labels apart
        base = float((weight * labels).sum() / weight.sum()) if n else 0.0
        self.base = base
        self.blank = float(((weight * labels)[blank].sum() + base) / (weight[blank].sum() + 1)) if n else 0.0
        keep = np.flatnonzero(some)
        if len(keep):  # like with like, for tight bounds
            most = np.zeros(n, np.int64)
            by_value = np.lexsort((value, row))
            most[row[by_value]] = col[by_value]
            keep = keep[np.lexsort((most[keep], labels[keep]))]
        self.ids = [ids[i] for i in keep]
        self.labels, self.weight = labels[keep].astype(np.float64), weight[keep]
        place = np.zeros(n, np.int64)
        place[keep] = np.arange(len(keep))
        self.blocks = -(-len(keep) // BLOCK)
        frequent = df >= max(1.0, n / FREQUENT)
        self.dense = np.where(frequent, np.cumsum(frequent) - 1, -1)
        full = frequent[col]
        self.weights = np.zeros((self.blocks, int(frequent.sum()), BLOCK))
        at = place[row[full]]
        self.weights[at // BLOCK, self.dense[col[full]], at % BLOCK] = value[full]
        self.most = self.weights.max(axis=2).T if self.blocks else np.zeros((0, 0))
        rare = np.flatnonzero(~full)
        rare = rare[np.lexsort((place[row[rare]], col[rare]))]
        self.size = np.bincount(col[rare], minlength=len(self.terms))
        self.start = np.cumsum(self.size) - self.size
        self.posted, self.value = place[row[rare]].astype(np.int32), value[rare]

    @property
    def matrix(self) -> np.ndarray:
        """All weights, term by example (for small indexes)."""
        out = np.zeros((len(self.terms), self.blocks * BLOCK))
        out[self.dense >= 0] = self.weights.transpose(1, 0, 2).reshape(-1, out.shape[1])
        out[np.repeat(np.arange(len(self.size)), self.size), self.posted] = self.value
        return out

    def sparse(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (text, term, weight) of the unit vectors of texts, text by text."""
        hit, at = self.lookup.find(hashes)
        row, col, tf = entries(doc[hit], at, len(self.terms))
        value = (1 + np.log(tf)) * self.idf[col]
        norm = np.sqrt(np.bincount(row, value * value, n))
        return row, col, value / norm[row]

    def nearest(self, col: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples with a similarity over 0, and their similarities."""
        return next(self.search(np.zeros(len(col), np.int64), col, value, 1))

    def search(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each of n texts; entries stand text by text."""
        cut = np.searchsorted(row, np.arange(n + 1))
        met = np.concatenate([[0], np.cumsum(np.bincount(row, self.size[col], n).astype(np.int64) + self.blocks * BLOCK)])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(met, met[lo] + CELLS, "right")) - 1)
            own = slice(cut[lo], cut[hi])
            yield from self.search_few(row[own] - lo, col[own], value[own], hi - lo)
            lo = hi

    def search_few(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wide = self.blocks * BLOCK
        often = self.dense[col] >= 0
        count = self.size[col]
        at = np.repeat(self.start[col] - np.cumsum(count) + count, count) + np.arange(count.sum())
        score = np.bincount(np.repeat(row * wide, count) + self.posted[at], np.repeat(value, count) * self.value[at], n * wide).reshape(n, self.blocks, BLOCK)
        asked = np.zeros((n, self.most.shape[0]))
        asked[row[often], self.dense[col[often]]] = value[often]
        bound = score.max(axis=2, initial=0.0) + asked @ self.most
        seen = np.full((n, self.blocks, BLOCK), -1.0)
        least = np.zeros(n)
        order = np.argsort(-bound.sum(axis=0), kind="stable")
        i, step = 0, BLOCKS_AT_ONCE
        while i < self.blocks:
            for b in order[i : i + step]:
                need = np.flatnonzero((bound[:, b] >= least - 1e-12) & (bound[:, b] > 0))
                seen[need, b] = score[need, b] + (asked if len(need) == n else asked[need]) @ self.weights[b]
            i, step = i + step, step * 2
            if wide > NEAREST:
                least = np.maximum(0.0, np.partition(seen.reshape(n, wide), wide - NEAREST, axis=1)[:, wide - NEAREST])
        for got, low in zip(seen.reshape(n, wide), least):
            at = np.flatnonzero((got > 0) & (got >= low))
            at = at[np.lexsort((at, -got[at]))[:NEAREST]]
            yield at, got[at]

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list]]:
        n = len(off) - 1
        hashes, doc = terms(data, off)
        row, col, value = self.sparse(hashes, doc, n)
        out, why = np.full(n, self.blank), [[] for _ in range(n)]
        told = np.bincount(row, minlength=n) > 0
        for i, (at, near) in enumerate(self.search(row, col, value, n)):
            if told[i]:
                vote = near * near * self.weight[at]
                out[i] = ((vote * self.labels[at]).sum() + PRIOR * self.base) / (vote.sum() + PRIOR)
                why[i] = [self.ids[a] for a in at[:EVIDENCE]]
        return np.clip(out, 0.0, 1.0), why


def document_counts(docs: DataFrame, terms_: np.ndarray, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of texts, and how many of all texts hold each term."""
    spark = docs.sparkSession
    ready(spark)
    shared, token = spark.sparkContext.broadcast(terms_), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = once("toxicity terms", token, lambda: Lookup(shared.value))
        held = np.zeros(len(lookup.terms) + 1, np.int64)
        for part, data, off in chunks(batches, "whole"):
            hashes, doc = terms(data, off)
            hit, at = lookup.find(hashes)
            held[:-1] += np.bincount(entries(doc[hit], at, len(lookup.terms))[1], minlength=len(lookup.terms))
            held[-1] += part.num_rows
        if held[-1]:
            cut = range(0, len(held), COUNTS)
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.int32()), pa.array([held[c : c + COUNTS].tobytes() for c in cut], pa.binary())], names=["part", "held"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["held"].to_pylist())
        return pa.table({"part": table["part"][:1], "held": pa.array([total.tobytes()], pa.binary())})

    parts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("whole")).mapInArrow(count, "part int, held binary")
    got = sorted(parts.groupBy("part").applyInArrow(add, "part int, held binary").collect())
    held = np.frombuffer(b"".join(r["held"] for r in got), np.int64) if got else np.zeros(len(terms_) + 1, np.int64)
    return int(held[-1]), held[:-1]


def unlike(rows: DataFrame, seen: dict[int, Seen]) -> DataFrame:
    """The rows (texts t with labels y) that are no near copy of an example kept for their label."""
    spark = rows.sparkSession
    ready(spark)
    shared, token = spark.sparkContext.broadcast(seen), uuid.uuid4().hex

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = once("toxicity seen", token, lambda: shared.value)
        for part, data, off in chunks(batches, "t"):
            labels = part.column(part.schema.get_field_index("y")).to_pylist()
            yield part.filter(pa.array([not seen[v].near(least) for v, least in zip(labels, sketches(data, off))], pa.bool_()))

    return rows.mapInArrow(sift, rows.schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Index | None:
    """An index over the bounded sample of the labelled texts."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if not counts:
        return None
    own = own.withColumn("p", F.pmod(F.xxhash64("k", F.lit(11)), F.lit(TOP)))
    fit = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= EXAMPLE_BYTES)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows: list[tuple] = []
    seen = {v: Seen() for v in sorted(counts)}
    start, width = dict.fromkeys(seen, 0), {v: math.ceil(1.3 * EXAMPLES / counts[v] * TOP) for v in seen}
    while asks := [v for v in seen if seen[v].size < EXAMPLES and start[v] < TOP]:
        few = own.where(" or ".join(f"(y = {v} and p >= {start[v]} and p < {start[v] + width[v]})" for v in asks))
        if rows:
            got = unlike(fit.join(few, "k"), seen).toArrow()
        else:
            got = fit.join(F.broadcast(few) if not any(start.values()) else few, "k").toArrow()  # the first `few` has a bounded number of rows
        drawn = sorted(zip(got["p"].to_pylist(), got["k"].to_pylist(), got["t"].to_pylist(), got["y"].to_pylist()))
        before = {v: seen[v].size for v in asks}
        for (_, k, t, v), least in zip(drawn, sketches(*text_buffer(pa.array([r[2] for r in drawn], pa.large_string())))):
            if seen[v].size < EXAMPLES and not seen[v].near(least):
                seen[v].add(least)
                rows.append((k, t, v))
        for v in asks:  # the more seldom a text was new, the more rows are read next
            start[v] += width[v]
            width[v] *= min(64, max(1, math.ceil(1.3 * (EXAMPLES - seen[v].size) / max(1, seen[v].size - before[v]))))
    if not rows:
        return None
    rows.sort(key=lambda r: r[2])
    y = np.array([r[2] for r in rows])
    rate = {v: max(1, int((y == v).sum())) / c for v, c in counts.items()}
    return Index([r[0] for r in rows], [r[1] for r in rows], y, rate, lambda found: document_counts(docs, found, text), docs.schema[key].dataType)


def score(docs: DataFrame, index: Index | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds score and evidence (ids of the nearest examples); `text` stays unless told otherwise."""
    spark = docs.sparkSession
    ready(spark)
    shared, token = spark.sparkContext.broadcast(index), uuid.uuid4().hex
    own, together = apart(docs, text)
    evidence = T.ArrayType(index.kind if index else T.LongType())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = once("toxicity", token, lambda: shared.value)
        for part, data, off in chunks(batches, "whole"):
            value, why = index.score(data, off) if index else (np.zeros(part.num_rows), [[]] * part.num_rows)
            whole = part.column(1) if keep_text else pa.nulls(part.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), whole, pa.array(value), pa.array(why, to_arrow_type(evidence))], names=["kept", "whole", "score", "evidence"])

    schema = T.StructType([*own.schema, T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    return together(own.mapInArrow(rate, schema), keep_text, score=F.col("score"), evidence=F.col("evidence"))
