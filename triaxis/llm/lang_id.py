"""Language identification by prediction by partial matching over bytes.

Per language a tree of byte contexts up to `ORDER` is counted on a bounded sample of labelled texts and then
frozen. The code length of a text is the sum, over its bytes, of minus the binary logarithm of the symbol's
probability in the longest context known, with escapes (method C: d / (n + d) for d distinct of n symbols)
to the next shorter context where the symbol is new, down to 1 / 256. The language of least length wins;
ties go to the name that sorts first. Every text is scored whole.

The sample: at most `SAMPLE_DOCS` distinct labelled texts of at most `SAMPLE_BYTES` bytes for each language, chosen
by a hash of the text; its rate comes from the number of distinct texts, so copies take no part in it. All else covers
every row, every context of the sample and every language: each language has a table of its own contexts, `LANGS`
languages make a model that goes to the workers at once, and further models take passes of their own.

Null text, or text without a letter: `und`, score 0. Empty table: empty result. Repeated rows and ties keep their rows;
extra columns keep their names, but one named like an added column gets underscores at its end. Where nothing is
learned, all texts are `und`.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, chunks, materialize, once, ready

ORDER = 3
SAMPLE_DOCS, SAMPLE_BYTES = 300, 16_384
#: Languages of a model.
LANGS = 64
UNKNOWN = "und"


def sample(labelled: DataFrame, text: str, lang: str) -> dict[str, list[bytes]]:
    """The bounded sample, by language."""
    fit = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    fit = fit.withColumn("h", F.xxhash64("t", F.lit(7)))
    counts = fit.select("l", "h").distinct().groupBy("l").count().collect()
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1e6, math.ceil(3e6 * SAMPLE_DOCS / r["count"])))])
    spread = F.pmod(F.col("h"), F.lit(1_000_000))
    few = fit.where(spread < F.coalesce(share[F.col("l")], F.lit(0.0))).dropDuplicates(["l", "t"])
    by_lang = few.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("h", "t"))).alias("x"))
    rows = by_lang.select("l", F.slice("x", 1, SAMPLE_DOCS)["t"].alias("x")).collect()
    return {r["l"]: [t.encode() for t in r["x"]] for r in sorted(rows, key=lambda r: r["l"])}


class Model:
    """Frozen code lengths: for each language a row for every context that its sample knows, a column for every symbol
    of it and one for all others."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER) -> None:
        self.langs, self.order = sorted(texts), order
        seen = np.unique(np.concatenate([np.frombuffer(b"".join(t), np.uint8) for t in texts.values()] or [np.zeros(0, np.uint8)]))
        self.size = a = len(seen) + 1  # the last symbol: bytes that the sample lacks
        self.code = np.full(256, a - 1, np.int32)
        self.code[seen] = np.arange(len(seen))
        coded = {lang: [self.code[np.frombuffer(t, np.uint8)].astype(np.int64) for t in texts[lang]] for lang in self.langs}
        follow = [[np.unique(np.concatenate([np.zeros(0, np.int64), *[self.context(t, k) * a + t[k:] for t in coded[lang] if len(t) > k]]), return_counts=True) for k in range(order + 1)] for lang in self.langs]
        every = [np.unique(np.concatenate([np.zeros(1 if k == 0 else 0, np.int64), *[f[k][0] // a for f in follow]])) for k in range(order + 1)]
        # the contexts of all languages, short ones first; a context that none knows stands for its longest known end
        self.row_of, self.first = [], np.cumsum([0, *map(len, every)])
        for k, contexts in enumerate(every):
            at = self.row_of[k - 1][np.arange(a**k) % a ** (k - 1)] if k else np.zeros(1, np.int32)
            at[contexts] = self.first[k] + np.arange(len(contexts))
            self.row_of.append(at.astype(np.int32))
        self.tables = [self.table(f, every) for f in follow]

    def table(self, follow: list[tuple[np.ndarray, np.ndarray]], every: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one language: its row for each context of all languages, times its columns; its column for each symbol;
        and the bits, row by row."""
        a = self.size
        own = np.unique(follow[0][0] % a)
        column = np.full(a, len(own), np.int32)
        column[own] = np.arange(len(own))
        rows, row = [np.full((1, len(own) + 1), 8.0, np.float32)], np.zeros(self.first[-1], np.int32)  # 1 / 256 each
        total = 1
        for k, (symbols, c) in enumerate(follow):
            contexts, at = np.unique(symbols // a, return_inverse=True)
            shorter = row[self.row_of[k - 1][contexts % a ** (k - 1)]] if k else np.zeros(len(contexts), np.int32)
            longest = self.row_of[k - 1][every[k] % a ** (k - 1)] if k else np.zeros(0, np.int64)
            bits = np.concatenate(rows)[shorter] if len(contexts) else np.zeros((0, len(own) + 1), np.float32)
            n, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
            if len(contexts):
                bits = bits - np.log2(kinds / (n + kinds))[:, None].astype(np.float32)
                bits[at, column[symbols % a]] = -np.log2(c / (n[at] + kinds[at]))
            rows.append(bits)
            here = row[longest] if k else np.zeros(len(every[0]), np.int32)  # unknown to this language: its longest known end
            here[np.searchsorted(every[k], contexts)] = total + np.arange(len(contexts))
            row[self.first[k] : self.first[k + 1]] = here
            total += len(contexts)
        return row * np.int64(len(own) + 1), column, np.concatenate(rows).ravel()

    def context(self, t: np.ndarray, k: int) -> np.ndarray:
        """The k symbols before each symbol from the k-th on, as one number."""
        out = np.zeros(len(t) - k, np.int64)
        for i in range(k):
            out = out * self.size + t[i : len(t) - k + i]
        return out

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of every text under every language."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(data):
            return out
        t = self.code[data].astype(np.int64)
        row = np.zeros(len(t), np.int64)
        k = self.order
        if len(t) > k:
            row[k:] = self.row_of[k][self.context(t, k)]
        for j in range(k):  # the first symbols of a text have shorter contexts
            at = off[:-1] + j
            at = at[at < off[1:]]
            ctx = np.zeros(len(at), np.int64)
            for i in range(j):
                ctx = ctx * self.size + t[at - j + i]
            row[at] = self.row_of[j][ctx]
        full = off[1:] > off[:-1]
        for j, (place, column, bits) in enumerate(self.tables):
            out[full, j] = np.add.reduceat(bits[place[row] + column[t]], off[:-1][full], dtype=np.float64)
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[Model]:
    """Models of `LANGS` languages each, in the order of their names."""
    texts = sample(labelled, text, lang)
    names = sorted(texts)
    return [Model({n: texts[n] for n in names[i : i + LANGS]}) for i in range(0, len(names), LANGS)]


LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True


def predict(docs: DataFrame, models: list[Model], text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred, score (the posterior of that language, all equally likely before) and bits (the
    code length under it); `text` stays unless told otherwise."""
    spark = docs.sparkSession
    ready(spark)
    own, together = apart(docs, text)
    told = [T.StructField("lang", T.StringType()), T.StructField("all", T.DoubleType()), T.StructField("least", T.DoubleType())]
    found = own.withColumns({"lang": F.lit(None).cast("string"), "all": F.lit(0.0), "least": F.lit(float("inf"))})
    for turn, model in enumerate(models):
        shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex

        def guess(batches: Iterator[pa.RecordBatch], shared=shared, token=token, drop=not keep_text and turn == len(models) - 1) -> Iterator[pa.RecordBatch]:
            model = once("lang_id", token, lambda: shared.value)
            for part, data, off in chunks(batches, "whole"):
                n = part.num_rows
                letters = np.concatenate([[0], np.cumsum(LETTERS[data])])
                readable = letters[off[1:]] > letters[off[:-1]]
                for i in np.flatnonzero(~readable & (off[1:] > off[:-1])):
                    readable[i] = any(map(str.isalpha, part.column(1)[int(i)].as_py()))
                names, every, low = part.column(2).to_pylist(), part.column(3).to_numpy(), part.column(4).to_numpy()
                bits = model.lengths(data, off)
                best = bits.argmin(axis=1)
                new = bits[np.arange(n), best]
                least = np.minimum(low, new)
                # the sum of 2 ** -bits over all languages so far, times 2 ** least
                every = every * np.exp2(np.maximum(least - np.where(np.isinf(low), least, low), -1000.0)) + np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                names = [(model.langs[b] if x < y else name) if ok else None for b, x, y, name, ok in zip(best, new, low, names, readable)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(n, pa.string()) if drop else part.column(1), pa.array(names, pa.string()), pa.array(every), pa.array(least)], names=["kept", "whole", "lang", "all", "least"])

        if turn:
            found = materialize(found)
        found = found.mapInArrow(guess, T.StructType([own.schema["kept"], own.schema["whole"], *told]))
    known = F.col("lang").isNotNull()
    score, bits = F.when(known, 1 / F.col("all")).otherwise(0.0), F.when(known, F.col("least")).otherwise(0.0)
    return together(found, keep_text, lang_pred=F.coalesce("lang", F.lit(UNKNOWN)), score=score, bits=bits)


def readable(lang_pred: Column) -> Column:
    return lang_pred != UNKNOWN
