"""Benchmark decontamination with suffix arrays over the training texts.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Every worker turns a piece of
its partition (a shard of whole texts) into word numbers and sorts the suffixes that could match: those
that start a long enough run of words known to the benchmark. Every suffix of every item is then looked up
in each shard by binary search of its first `WINDOW` words (of the whole item, if it is shorter), once for suffixes
that begin alike; what is found makes the words it covers hits. Finds that follow one another in text and item are one
verbatim match, of which the longest of each item and text is reported with its places.

The benchmark goes to the workers as a broadcast of at most `BLOCK_BYTES` of text; a larger one is split into
blocks by a hash of its items, and each block takes a pass of its own that adds to the result of the one before.

Null or empty text: no words, nothing hit. An item without words matches nothing. An empty benchmark or an
empty table gives zero hits or no rows. Repeated rows each have their result. Extra columns keep their names, but one
named like an added column gets underscores at its end.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, apart, chunks, materialize, once, ready, text_buffer, word_hashes, word_spans

WINDOW = 13
BLOCK_BYTES = 32 << 20
#: Pairs of finds and item places looked at together.
PAIRS = 1 << 22
#: Word bytes are digits, letters and all that is not ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_WORD[65:91] = True


class Benchmark:
    """The different windows of the items as sequences of word numbers, and where each stands."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        data, off = text_buffer(pa.array(texts, pa.string()))
        data = LOWER[data]
        lo, hi, item = word_spans(data, off, IS_WORD)
        hashes = word_hashes(data, lo, hi)
        self.words = np.unique(hashes)  # a word's number: its place here, from 1
        number = np.searchsorted(self.words, hashes) + 1
        self.ids, self.window = ids, window
        #: length: windows; first place of each, number of places; item and word of every place
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        first = np.searchsorted(item, np.arange(len(ids)))
        n = np.searchsorted(item, np.arange(len(ids)), "right") - first
        length = np.minimum(window, n)
        for size in np.unique(length[n > 0]).tolist():
            own = np.flatnonzero(length == size)
            many = n[own] - size + 1
            who = np.repeat(own, many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            every, back = np.unique(number[(first[who] + at)[:, None] + np.arange(size)], axis=0, return_inverse=True)
            order = np.argsort(back, kind="stable")
            times = np.bincount(back, minlength=len(every))
            self.windows[size] = (every, np.cumsum(times) - times, times, who[order], at[order])
        self.short_first = np.unique(np.concatenate([np.zeros(0, np.int64), *[w[0][:, 0] for k, w in self.windows.items() if k < window]]))
        self.least = min(self.windows, default=0)


class Shard:
    """The suffix array of a shard: suffixes by their first `depth` words; words unknown to the benchmark end them."""

    def __init__(self, number: np.ndarray, at: np.ndarray, depth: int) -> None:
        padded = np.concatenate([number, np.zeros(depth, number.dtype)])
        keys = np.zeros((len(at), depth), np.int32)
        alive = np.ones(len(at), bool)
        for d in range(depth):
            w = padded[at + d]
            alive &= w > 0
            keys[:, d] = np.where(alive, w, 0)
        order = np.lexsort(keys.T[::-1])
        self.at, self.keys = at[order], keys[order]

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place in the array of the suffixes that begin with each window."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.at), np.int64)
        for d in range(windows.shape[1]):  # each word narrows the range: two binary searches over all windows at once
            column, want = self.keys[:, d], windows[:, d]
            lo, hi = self.bound(column, want, lo, hi, False), self.bound(column, want, lo, hi, True)
        return lo, hi

    @staticmethod
    def bound(column: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            value = column[np.minimum(mid, len(column) - 1)] if len(column) else np.zeros(len(mid), np.int32)
            right = open_ & ((value <= want) if after else (value < want))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


Found = dict[int, tuple[int, int, int]]


def match(bench: Benchmark, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Found]]:
    """Of the texts of one shard: words, the text of each word, whether it is hit; and for each text the items found in it,
    with the longest match: its words, its first word in the text and in the item."""
    n = len(off) - 1
    data = LOWER[data]
    lo, hi, doc = word_spans(data, off, IS_WORD)
    count = np.bincount(doc, minlength=n)
    found: list[Found] = [{} for _ in range(n)]
    hit = np.zeros(len(lo) + 1, np.int64)
    if not len(lo) or not bench.windows:
        return count, doc, hit[:-1] > 0, found
    hashes = word_hashes(data, lo, hi)
    place = np.minimum(np.searchsorted(bench.words, hashes), len(bench.words) - 1)
    number = np.where(bench.words[place] == hashes, place + 1, 0)
    # a run of known words ends at an unknown word or at the end of a text
    index = np.arange(len(number))
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    stop = np.where(number == 0, index, np.where(last, index + 1, len(number)))
    run = np.minimum.accumulate(stop[::-1])[::-1] - index
    maybe = run >= bench.window
    if bench.least < bench.window:
        maybe |= (run >= bench.least) & np.isin(number, bench.short_first)
    at = np.flatnonzero(maybe)
    if not len(at):
        return count, doc, hit[:-1] > 0, found
    shard = Shard(np.concatenate([number, [0]]), at, max(bench.windows))
    length, first_word = run[shard.at], np.cumsum(count) - count
    for size, (windows, place, times, item, item_at) in bench.windows.items():
        first, end = shard.find(windows)
        some = np.flatnonzero(first < end)
        reps = end[some] - first[some]
        where = np.repeat(first[some] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        inside = length[where] >= size
        start, which = shard.at[where[inside]], np.repeat(some, reps)[inside]
        if not len(start):
            continue
        hit[:-1] += np.bincount(start, minlength=len(lo))
        hit += -np.bincount(start + size, minlength=len(lo) + 1)
        order = np.argsort(start)
        start, which = start[order], which[order]
        open_: dict[tuple[int, int], int] = {}
        before, cut = -2, np.cumsum(times[which])
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] - times[which[a]] + PAIRS, "right")))
            many = times[which[a:b]]
            s = np.repeat(start[a:b], many)
            pick = np.repeat(place[which[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            who, lag = item[pick], s - item_at[pick]
            order = np.lexsort((s, lag, who))
            s, who, lag = s[order], who[order], lag[order]
            edge = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (lag[1:] != lag[:-1]) | (who[1:] != who[:-1])]))
            ends = s[np.append(edge[1:], len(s)) - 1]
            s, who, lag = s[edge], who[edge], lag[edge]
            for i in np.flatnonzero(s == before + 1).tolist():  # matches that began among the finds looked at before
                s[i] = open_.get((int(who[i]), int(lag[i])), s[i])
            before = int(start[b - 1])
            open_ = {(int(who[i]), int(lag[i])): int(s[i]) for i in np.flatnonzero(ends == before)} if b < len(start) else {}
            d, words = doc[s], ends - s + size
            order = np.lexsort((s - lag, s, -words, who, d))
            d, who, words, s, lag = d[order], who[order], words[order], s[order], lag[order]
            best = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (who[1:] != who[:-1])]))
            for x, i, w, f, g in zip(d[best].tolist(), who[best].tolist(), words[best].tolist(), (s - first_word[d])[best].tolist(), (s - lag)[best].tolist()):
                better(found[x], i, (w, f, g))
            a = b
    return count, doc, np.cumsum(hit[:-1]) > 0, found


def better(found: dict, item, match_: tuple[int, int, int]) -> None:
    """Keeps the longer match of an item; ties to the first."""
    have = found.get(item)
    if have is None or (-match_[0], *match_[1:]) < (-have[0], *have[1:]):
        found[item] = match_


def united(a: list[int], b: list[int]) -> list[int]:
    """Two lists of stretches (first, last + 1, ...) as one."""
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[list[str], list[str | None], bool]]:
    """The items in blocks of about block_bytes, and whether a block is the last."""
    own = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        rows = (own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).toArrow()
        yield rows["i"].to_pylist(), rows["t"].to_pylist(), k == n - 1


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """Adds n_words, hits (array of the first word and the word after each hit stretch), items (sorted, distinct) and
    longest (of each of these items the longest verbatim match: item, at, item_at and words, counted in words); `text` stays unless told otherwise."""
    spark = docs.sparkSession
    ready(spark)
    longest = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), *[T.StructField(f, T.LongType()) for f in ("at", "item_at", "words")]]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("longest", longest)]
    own, together = apart(docs, text)
    found = own.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    schema = found.schema
    for turn, (ids, texts, last) in enumerate(blocks(benchmark, item, item_text, block_bytes)):
        shared, token = spark.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], shared=shared, token=token, drop=last and not keep_text) -> Iterator[pa.RecordBatch]:
            bench = once("benchmark", token, lambda: Benchmark(*shared.value, window=window))
            for part, data, off in chunks(batches, "whole"):
                count, doc, hit, matched = match(bench, data, off)
                edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                first_word = np.concatenate([[0], np.cumsum(count)])
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                hits: list[list[int]] = [[] for _ in range(part.num_rows)]
                for a, b in zip(starts.tolist(), ends.tolist()):
                    while a < b:  # a stretch may go on over the end of a text
                        d = int(doc[a])
                        c = min(b, int(first_word[d + 1]))
                        hits[d] += [a - int(first_word[d]), c - int(first_word[d])]
                        a = c
                named = []
                for x, hits_before, before in zip(range(part.num_rows), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    best = {m["item"]: (m["words"], m["at"], m["item_at"]) for m in before or []}
                    for i, m in matched[x].items():
                        better(best, bench.ids[i], m)
                    named.append([{"item": i, "at": at, "item_at": item_at, "words": words} for i, (words, at, item_at) in sorted(best.items())])
                    if hits_before:
                        hits[x] = united(hits_before, hits[x])
                columns = [part.column(0), pa.nulls(part.num_rows, pa.string()) if drop else part.column(1), pa.array(count.astype(np.int64)), pa.array(hits, pa.list_(pa.int64())), pa.array(named, part.schema.field(4).type)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        if turn:
            found = materialize(found)
        found = found.mapInArrow(find, schema)
    return together(found, keep_text, n_words=F.col("n_words"), hits=F.col("hits"), items=F.col("longest.item"), longest=F.col("longest"))


def n_hit(hits: str = "hits"):
    """Words hit, of the ends of the hit stretches."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def contaminated(hit, words):
    """A twentieth of the words at least are hit."""
    return (hit > 0) & (20 * hit >= words)


def brute(texts: list[str | None], items: dict[int, str | None], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """The same by plain search, for tests: words, hits and items of each text."""
    import re

    def words(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, b in items.items():
            v = words(b)
            k = min(window, len(v))
            for j in range(len(v) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[j : j + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
