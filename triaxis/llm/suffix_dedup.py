"""Suffix-array dedup with prefix-free parsing, over a distributed corpus.

Every text is parsed at triggers: the trigger of a stretch of `SPAN` bytes is the first place in it whose
rolling hash of `K` bytes is least. It depends on the stretch alone, so equal stretches are parsed alike. A
phrase is what lies before a trigger from the first stretch that has it. All suffixes that start in a
phrase differ only in how much of the phrase is left; what follows is the suffix of the parse from the
trigger on, as far as the stretches reach. So corpus order follows from two small orders: that of the
dictionary (suffixes of phrases, sorted from their ends) and that of the parse (what follows a trigger).

1. Triggers whose K bytes stand once in the corpus can have no repeat before them and are dropped.
2. The phrases left are gathered per trigger, equal ones (with equal sequels) once with their count. A trigger
   with many different phrases is split into blocks.
3. Each shard sorts its dictionary and its parse, with the longest common prefixes of neighbours. Two
   suffixes agree over SPAN bytes if their phrase ends and sequels fall into the same runs of both orders.
   Suffixes that stay single in one block of a split trigger are compared across blocks by 128-bit hashes of
   their SPAN bytes.
4. Repeated starts go back to all places of their phrase, are united to byte runs and cut out.

Texts are put into packs once; the packs are a table of their own, which all later steps read, so that they mean the same
packs by a pack's number however the input is read again. A trigger's rows are read in order, so a task holds
one trigger or block at a time; a long text is parsed in pieces of `PIECE` bytes that overlap by a stretch.

Null text: empty, nothing removed. Texts under SPAN bytes keep everything. Repeated rows are texts of
their own, so they remove each other. Keys may be null or repeated. An empty table gives no rows. Matches never
cross texts. Extra columns keep their names, but one named like an added column gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import INVERSE, byte_values, chunks, clear, forget, materialize, mix, powers, prefix_sums, ready, trim

SPAN, K = 200, 64
#: Different phrases of one trigger in a block; phrases sorted together; phrases that a task holds to count equal ones.
BLOCK, SORTED, HELD = 1024, 8192, 65_536
#: Bytes of text packed together, and parsed at once.
PACKED, PIECE = 1 << 20, 4 << 20
#: A second hash, for whole phrases: with the trigger's own it makes 128 bits.
OWN_VALUES, OWN_BASE = byte_values(2), np.uint64(0xC2B2AE3D27D4EB4F)
OWN_INVERSE = np.uint64(pow(int(OWN_BASE), -1, 1 << 64))


def sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i : i + width] for each i; what lies beyond the end is `fill`."""
    n = len(x)
    rows = -(-(n + width) // width)
    padded = np.full(rows * width, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    left = op.accumulate(grid, axis=1).ravel()
    right = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[width - 1 : width - 1 + n])


#: Low bits that hold a place where hashes and places are compared together.
PLACE = np.uint64((1 << 30) - 1)


def pieces(data: np.ndarray, off: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Where each piece begins, its bytes and offsets; every stretch starts in one piece and lies in it."""
    for lo in range(0, max(len(data), 1), PIECE):
        part = data[lo : lo + PIECE + span - 1]
        yield lo, part, np.concatenate([[0], np.clip(off[1:] - lo, 0, len(part))])


def triggers(data: np.ndarray, off: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each phrase: its trigger's place and hash, the first and last start of a stretch whose trigger it
    is, and the text's number."""
    n, width = len(data), span - k + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, none
    sums = prefix_sums(data)
    grams = mix((sums[k:] - sums[:-k]) * powers(INVERSE, n - k + 1))
    least = sliding((grams & ~PLACE) | np.arange(n - k + 1, dtype=np.uint64), width, np.minimum, 2**64 - 1)
    start = np.flatnonzero(np.arange(n) + span <= np.repeat(off[1:], np.diff(off)))
    if not len(start):
        return none, none, none, none, none
    at = (least[start] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, first, last = at[new], start[new], start[np.append(new[1:], len(start)) - 1]
    return at, grams[at].view(np.int64), first, last, np.searchsorted(off, first, "right") - 1


class Order:
    """Rows of bytes in lexicographic order: where each row stands, and the common prefix with the row before."""

    def __init__(self, rows: np.ndarray, size: np.ndarray) -> None:
        wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
        wide[:, : rows.shape[1]] = rows
        order = np.lexsort([size, *wide.view(">u8").T[::-1]])
        rows, size = rows[order], size[order]
        self.place = np.empty(len(rows), np.int64)
        self.place[order] = np.arange(len(rows))
        self.common = np.zeros(len(rows), np.int64)
        same = rows[1:] == rows[:-1]
        run = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
        self.common[1:] = np.minimum(run, np.minimum(size[1:], size[:-1]))

    def runs(self, depth: int) -> np.ndarray:
        """For each row, where the run of rows that agree on `depth` bytes begins."""
        return np.maximum.accumulate(np.where(self.common < depth, np.arange(len(self.common)), 0))[self.place]


def byte_rows(parts: list[bytes], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    out = np.zeros((len(parts), width), np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, np.repeat(size, size) - 1 - at if backwards else at] = flat
    return out, size


def repeated(heads: list[bytes], sequels: list[bytes], times: np.ndarray, span: int = SPAN, width: int = SPAN - K + 1) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase and start offset: whether the suffix is repeated, and the number of its class (-1: no whole stretch)."""
    n = len(heads)
    rows, head_size = byte_rows(heads, width, True)
    dictionary = Order(rows, head_size)
    rows, sequel_size = byte_rows(sequels, span, False)
    parse = Order(rows, sequel_size)
    again, number = np.zeros((n, width + 1), bool), np.full((n, width + 1), -1, np.int64)
    total = 0
    for left in range(int(head_size.max(initial=0)) + 1):  # bytes of the phrase before its trigger
        here = np.flatnonzero((head_size >= left) & (left + sequel_size >= span))
        if not len(here):
            continue
        both = dictionary.runs(left)[here] * n + parse.runs(span - left)[here]
        kinds, back = np.unique(both, return_inverse=True)
        count = np.bincount(back, times[here])
        again[here, head_size[here] - left] = count[back] > 1
        number[here, head_size[here] - left] = total + back
        total += len(kinds)
    return again, number


def flat_spans(flags: np.ndarray) -> list[list[int]]:
    """Of each row, the runs of true as first, last + 1, ..."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, at = np.nonzero(edge)
    cut = np.searchsorted(row, np.arange(len(flags) + 1))
    return [at[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]


def packed(docs: DataFrame, text: str) -> DataFrame:
    """A table of packs: pack (its number), kept (rows without their texts; none: the text is null), offsets, texts."""
    others = [c for c in docs.columns if c != text]
    own = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text).isNull().alias("none")).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("whole"))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, number = zstandard.ZstdCompressor(level=6).compress, TaskContext.get().partitionId() << 32
        for part, data, off in chunks(batches, "whole", PACKED):
            kept = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number]), kept, pa.array([off.tolist()], pa.list_(pa.int64())), pa.array([press(data.tobytes())], pa.binary())], names=["pack", "kept", "offsets", "texts"])
            number += 1

    kind = T.StructType([T.StructField("pack", T.LongType()), T.StructField("kept", T.ArrayType(own.schema["kept"].dataType)), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])
    return materialize(own.mapInArrow(press, kind))


def find_runs(packs: DataFrame, span: int, block: int) -> DataFrame:
    """The repeated runs of each pack that has some: pack, runs (first byte, byte after, ...; they may overlap)."""
    k = min(K, max(1, span // 3))
    width = span - k + 1

    def phrases(data: np.ndarray, off: np.ndarray, named: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        for lo, data, off in pieces(data, off, span):
            at, gram, first, last, _ = triggers(data, off, span, k)
            if not named:
                yield (gram,)
                continue
            sums = prefix_sums(data, OWN_VALUES, OWN_BASE)
            cut = mix((sums[last + span] - sums[first]) * powers(OWN_INVERSE, len(sums))[first] + (at - first).astype(np.uint64)) if len(at) else first
            yield at + lo, gram, first + lo, last + lo, cut.view(np.int64)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes, np.ndarray]]:
        forget()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch, i, unpack(batch["texts"][i].as_py()), np.array(batch["offsets"][i].as_py(), np.int64)
        trim()

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, raw, off in texts(batches):
            for (gram,) in phrases(np.frombuffer(raw, np.uint8), off, named=False):
                yield pa.RecordBatch.from_arrays([pa.array(gram)], names=["gram"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, raw, off in texts(batches):
            for _, gram, first, _, phrase in phrases(np.frombuffer(raw, np.uint8), off):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), batch["pack"][i].as_py())), pa.array(first.astype(np.int32)), pa.array(gram), pa.array(phrase)], names=["pack", "first", "gram", "phrase"])

    # tables of their own, so that a hot trigger or phrase is dealt out anew when it is joined
    shared = materialize(packs.select("offsets", "texts").mapInArrow(spot, "gram long").groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"))
    found = packs.select("pack", "offsets", "texts").mapInArrow(parse, "pack long, first int, gram long, phrase long")
    wanted = materialize(found.join(shared, "gram"))
    firsts = wanted.groupBy("pack").agg(F.collect_set("first").alias("firsts"))
    heavy = materialize(wanted.select("gram", "phrase").distinct().groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > block))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}

        def out() -> pa.RecordBatch:
            gram, phrase = zip(*seen)
            head, cut, times = zip(*seen.values())
            return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(phrase, pa.int64()), pa.array(head, pa.int32()), pa.array(cut, pa.binary()), pa.array(times, pa.int64())], names=["gram", "phrase", "head", "cut", "times"])

        for batch, i, raw, off in texts(batches):
            asked = batch["firsts"][i].values.to_numpy()
            for at, gram, first, last, phrase in phrases(np.frombuffer(raw, np.uint8), off):
                pick = np.flatnonzero(np.isin(first, asked))
                for j in pick.tolist():
                    x = seen.get(name := (int(gram[j]), int(phrase[j])))
                    if x:
                        x[2] += 1
                    else:
                        seen[name] = [int(at[j] - first[j]), raw[first[j] : last[j] + span], 1]
                    if len(seen) > HELD:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    near = packs.select("pack", "offsets", "texts").join(firsts, "pack").select("offsets", "texts", "firsts")
    entries = near.mapInArrow(counted, "gram long, phrase long, head int, cut binary, times long")
    split = entries.join(heavy, "gram", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("phrase"), F.ceil(F.col("c") / block).cast("long")), F.lit(-1).cast("long")))
    dealt = split.select("gram", "part", "phrase", "head", "cut", "times").repartition("gram", "part").sortWithinPartitions("gram", "part", "phrase")

    def changes(table: pa.Table, *columns: str) -> np.ndarray:
        """Rows that differ from the row before in one of the columns."""
        x = [table[c].to_numpy() for c in columns]
        return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in x], axis=0)]))

    def merged(held: list[pa.Table]) -> pa.Table:
        """Equal phrases once."""
        table = pa.concat_tables(held).combine_chunks()
        first = changes(table, "gram", "part", "phrase")
        times = np.add.reduceat(table["times"].to_numpy(), first)
        return table.take(pa.array(first)).set_column(table.schema.get_field_index("times"), "times", pa.array(times))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SORTED):
                held.append(pa.Table.from_batches([batch.slice(at, SORTED)]))
                if sum(t.num_rows for t in held) >= SORTED:
                    table = merged(held)
                    last = int(changes(table, "gram", "part")[-1])  # the last trigger may go on
                    if last:
                        yield from whole(table.slice(0, last))
                    held = [table.slice(last)]
        if held:
            yield from whole(merged(held))
        trim()

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, part, phrase, times = (table[c].to_numpy() for c in ("gram", "part", "phrase", "times"))
        fresh = changes(table, "gram", "part")
        ends = np.append(fresh[1:], len(gram))
        lo = 0
        while lo < len(fresh):  # whole triggers together, blocks of split triggers alone
            hi = lo + 1
            if part[fresh[lo]] < 0:
                while hi < len(fresh) and part[fresh[hi]] < 0 and ends[hi] - fresh[lo] <= SORTED:
                    hi += 1
            a, b = int(fresh[lo]), int(ends[hi - 1])
            some = table.slice(a, b - a)
            yield from solved(gram[a:b], phrase[a:b], some["head"].to_pylist(), some["cut"].to_pylist(), times[a:b], part[a] >= 0)
            lo = hi

    def solved(gram: np.ndarray, phrase: np.ndarray, head: list[int], cuts: list[bytes], times: np.ndarray, open_: bool) -> Iterator[pa.RecordBatch]:
        again, number = repeated([c[:h] for c, h in zip(cuts, head)], [c[h:] for c, h in zip(cuts, head)], times, span, width)
        some = np.flatnonzero(again.any(axis=1))
        yield batch(gram[some], phrase[some], flat_spans(again[some]))
        if open_:
            row, at = np.nonzero(number >= 0)
            _, pick = np.unique(number[row, at], return_index=True)  # one of each class
            row, at = row[pick], at[pick]
            classes = [xxhash.xxh3_128_digest(cuts[r][a : a + span]) for r, a in zip(row.tolist(), at.tolist())]
            yield batch(gram[row], phrase[row], [[a, a + 1] for a in at.tolist()], classes, ~again[row, at])

    def batch(gram, phrase, spans, stretch=None, single=None) -> pa.RecordBatch:
        n = len(gram)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(phrase), pa.array(spans, pa.list_(pa.int32())), pa.array(stretch or [None] * n, pa.binary()), pa.array(np.zeros(n, bool) if single is None else single)], names=["gram", "phrase", "spans", "stretch", "single"])

    known = materialize(dealt.mapInArrow(sort, "gram long, phrase long, spans array<int>, stretch binary, single boolean"))
    across = known.where(F.col("stretch").isNotNull())
    twice = across.groupBy("stretch").agg(F.count("*").alias("c")).where("c > 1").select("stretch")
    more = across.where("single").join(twice, "stretch").select("gram", "phrase", "spans")
    starts = known.where(F.col("stretch").isNull()).select("gram", "phrase", "spans").unionByName(more)
    starts = materialize(starts.groupBy("gram", "phrase").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    moved = F.transform("spans", lambda x, i: x + F.col("first") + F.when(i % 2 == 1, span - 1).otherwise(0))
    return wanted.join(starts, ["gram", "phrase"]).select("pack", moved.alias("runs")).groupBy("pack").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup(docs: DataFrame, text: str = "text", span: int = SPAN, block: int = BLOCK, as_text: bool = False) -> DataFrame:
    """Adds removed (first byte, byte after, ... of each maximal run cut out), kept_bytes (binary: what remains)
    and n_bytes; `text` is left out. as_text: kept_text in place of kept_bytes (null for a null text), without the
    rests of characters that a cut splits."""
    ready(docs.sparkSession)
    remains = T.StructField("kept_text", T.StringType()) if as_text else T.StructField("kept_bytes", T.BinaryType())
    own = [T.StructField("removed", T.ArrayType(T.IntegerType())), remains, T.StructField("n_bytes", T.LongType())]
    others = [c for c in clear(docs.select([c for c in docs.columns if c != text]), *[f.name for f in own]).columns]
    packs = packed(docs, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                raw, off, spans = unpack(batch["texts"][i].as_py()), batch["offsets"][i].as_py(), batch["runs"][i].as_py() or []
                depth = np.zeros(len(raw) + 1, np.int32)
                np.add.at(depth, np.array(spans[::2], np.int64), 1)
                np.add.at(depth, np.array(spans[1::2], np.int64), -1)
                gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
                data = np.frombuffer(raw, np.uint8)
                removed, kept = [], []
                for a, b in zip(off, off[1:]):
                    if gone[a:b].any():
                        removed.append(flat_spans(gone[None, a:b])[0])
                        kept.append(data[a:b][~gone[a:b]].tobytes())
                    else:
                        removed.append([])
                        kept.append(raw[a:b])
                rows = batch["kept"].slice(i, 1).flatten()
                if as_text:
                    none = rows.field(rows.type.num_fields - 1).to_pylist()
                    rest = pa.array([None if n else x.decode(errors="ignore") for x, n in zip(kept, none)], pa.string())
                else:
                    rest = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([rows, pa.array(removed, pa.list_(pa.int32())), rest, pa.array(np.diff(off))], names=["kept", *[f.name for f in own]])
        trim()

    both = packs.join(find_runs(packs, span, block), "pack", "left").select("kept", "offsets", "texts", "runs")
    out = both.mapInArrow(cut, T.StructType([T.StructField("kept", packs.schema["kept"].dataType.elementType), *own]))
    return out.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(others)], *[f.name for f in own])


def brute(texts: list[str | None], span: int = SPAN) -> list[tuple[bytes, list[int]]]:
    """The same by a table of all stretches, for tests: what remains of each text, and the runs removed."""
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        flags = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                flags[i : i + span] = True
        out.append((bytes(np.frombuffer(r, np.uint8)[~flags]), flat_spans(flags[None, :])[0]))
    return out
