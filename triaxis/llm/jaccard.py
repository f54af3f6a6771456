"""Exact Jaccard join of word n-gram sets, and the classes its links form.

Words are the runs of `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a document's set holds the 64-bit hashes
of its distinct `N`-word shingles (of the whole sequence, if it has fewer words). Two documents link when
intersection over union is 0.8 or more. The join skips by what sets have in common:

1. Equal sets are one set. A set takes part only if enough of its first shingles (in hash order) stand in
   another document too: sets that link share `head_share` of such a head at least (prefix filter with
   overlap). Heads are exchanged as packed blocks per hash range, a shingle once a block.
2. Index lists hold the first shingles of each remaining set, frequent shingles last. The sets of a list are
   compared with the list's most central set (which has the fewest shingles that no other list entry shares);
   those that link form classes, so a group of near copies costs one comparison a set and not one a pair. The
   classes of a list are then compared in the same way, each by its most central set with the largest class.
3. Only pairs of classes that still meet in a list go on, by their central sets. An entry is skipped where it leaves
   too little of the sets to reach the overlap (position skip), sizes differ too much, or the parities of the
   shingles in 512 cells show that too many differ. Jaccard distance is a metric, so classes whose central sets are
   further apart than 0.2 plus both radii have no link. Of the others, the sets of the smaller class ask in the
   larger one: they are compared with its central set, and the answers of its members are derived incrementally from
   this one answer by the few shingles in which members and asking set differ from it (see `derived`).

Every pair that can link is compared by whole sets or excluded by a bound, so no link is lost. The list of
frequent shingles (at most `MAX_FREQUENT`) only orders shingles; any order gives the same links.

Null or empty text: empty set, linked with nothing. Rows that share a key count as one document whose
links unite. Rows with a null key are in no class (component null) but have their set size. Repeated rows keep
their rows; an empty table gives none; extra columns are not read. Keys are integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, LOWER, chunks, expected_bytes, forget, join_hot, materialize, mix, once, ready, trim, word_hashes, word_spans

N, PERCENT = 5, 80
#: Shingles known as frequent at most; from how many documents on a shingle is; shingles packed at once.
MAX_FREQUENT, FREQUENT, PACKED = 100_000, 48, 1 << 19
#: Blanks that part words.
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
FLAG = np.uint32(1 << 31)
#: Bytes of input whose heads a task takes, where there are more tasks than usual.
DEALT = 32 << 20
#: Cells whose parities bound the overlap of two sets.
BITS = 512


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, in ascending order text by text, and how many each text has."""
    docs = len(off) - 1
    data = LOWER[data]
    lo, hi, doc = word_spans(data, off, IS_WORD)
    word = word_hashes(data, lo, hi)
    count = np.bincount(doc, minlength=docs)
    total = max(0, len(word) - n + 1)
    shingle = np.zeros(total, np.uint64)
    for j in range(n):
        shingle += word[j : j + total] * np.uint64(pow(int(BASE), j + 1, 1 << 64))
    inside = doc[:total] == doc[n - 1 : n - 1 + total] if total else np.zeros(0, bool)
    shingle, owner = mix(shingle[inside]), doc[:total][inside]
    first = np.searchsorted(doc, np.arange(docs))
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            h = np.full(len(short), np.uint64(size * 0xA24BAED4963EE407 % (1 << 64)))
            for j in range(size):
                h = (h ^ word[first[short] + j]) * BASE
            shingle, owner = np.concatenate([shingle, mix(h)]), np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], np.bincount(owner[new], minlength=docs)


def needed(size, percent: int = PERCENT):
    """The least overlap of a set of this size with any set that links."""
    return -(-size * percent // 100)


def share(size):
    """The overlap asked of the heads of two sets of this size or more."""
    return np.maximum(1, -(-size // 10))


def heads(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """kind 0: (reference k, v head shingles that stand in other documents too), kind 1: (frequent shingle k, v
    documents), kind 2: (key k, size v, set hash a and b, reference ref)."""
    spark = docs.sparkSession
    usual, wanted = int(spark.conf.get("spark.sql.shuffle.partitions")), expected_bytes(docs) // DEALT
    buckets = max(64, 4 * usual, 4 * wanted)
    ref = F.xxhash64(key).bitwiseAND((1 << 31) - 1)
    own = docs.select(F.col(key).cast("long").alias("k"), ref.alias("ref"), F.col(text).alias("whole"))
    packed = "bucket int, tokens binary, refs binary, k long, v long, a long, b long, ref long"
    names = [x.split()[0] for x in packed.split(", ")]
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5]

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

    def pack(tokens: np.ndarray, refs: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(tokens, kind="stable")
        tokens, refs = tokens[order], refs[order]
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        times = np.diff(np.concatenate([edge, [len(tokens)]]))
        many = np.repeat(times > 1, times)
        own, counts = np.unique(refs[many], return_counts=True)  # known to be shared here already
        yield batch(1, bucket=[-1 - turn % buckets], tokens=[own.astype(np.uint32).tobytes()], refs=[counts.astype(np.uint32).tobytes()])
        tokens, refs = tokens[edge], np.where(times > 1, FLAG | times.astype(np.uint32), refs[edge].astype(np.uint32))
        bucket = (tokens >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        six = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        full = np.flatnonzero(np.diff(cut))
        yield batch(len(full), bucket=full, tokens=[six[cut[b] : cut[b + 1]].tobytes() for b in full], refs=[refs[cut[b] : cut[b + 1]].tobytes() for b in full])

    def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []
        held_refs: list[np.ndarray] = []
        n = turn = 0
        for part, data, off in chunks(batches, "whole"):
            shingle, size = shingle_sets(data, off)
            start = np.concatenate([[0], np.cumsum(size)])
            a = np.add.reduceat(np.append(mix(shingle), np.uint64(0)), start[:-1]) * (size > 0)
            b = np.add.reduceat(np.append(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0)), start[:-1]) * (size > 0)
            refs = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch(len(size), bucket=-1 - (refs % buckets), k=part.column(0), v=size, a=a.astype(np.uint64).view(np.int64), b=b.astype(np.uint64).view(np.int64), ref=refs)
            head = np.minimum(size, size - needed(size, percent) + share(size)) * (size > 0)
            pick = np.arange(head.sum()) + np.repeat(start[:-1] - np.concatenate([[0], np.cumsum(head)[:-1]]), head)
            held.append(shingle[pick] >> np.uint64(16))
            held_refs.append(np.repeat(refs, head))
            n += len(pick)
            if n > PACKED:
                yield from pack(np.concatenate(held), np.concatenate(held_refs), turn)
                held, held_refs, n, turn = [], [], 0, turn + 1
        if n:
            yield from pack(np.concatenate(held), np.concatenate(held_refs), turn)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tokens, refs = [], []
        shared: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(kind: int, k, v, **more) -> pa.RecordBatch:
            n = len(k)
            rest = [more.get(c, pa.nulls(n, pa.int64())) for c in ("a", "b", "ref")]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(k, pa.int64()), pa.array(v, pa.int64()), *rest], names=["kind", "k", "v", "a", "b", "ref"])

        for x in batches:
            c = {f: x.column(i) for i, f in enumerate(x.schema.names)}
            whole = x.filter(c["ref"].is_valid())
            if whole.num_rows:
                c2 = {f: whole.column(i) for i, f in enumerate(whole.schema.names)}
                yield rows(2, c2["k"], c2["v"], a=c2["a"], b=c2["b"], ref=c2["ref"])
            for bucket, t, r in zip(c["bucket"].to_pylist(), c["tokens"], c["refs"]):
                if not t.is_valid:
                    continue
                r = np.frombuffer(r.as_buffer(), np.uint32)
                if bucket < 0:
                    shared.append((np.frombuffer(t.as_buffer(), np.uint32).astype(np.int64), r.astype(np.int64)))
                    continue
                six = np.frombuffer(t.as_buffer(), np.uint8).reshape(-1, 6)
                wide = np.zeros((len(six), 8), np.uint8)
                wide[:, :6] = six
                tokens.append(wide.view("<u8").ravel())
                refs.append(r)
        if tokens:
            token, r = np.concatenate(tokens), np.concatenate(refs)
            tokens.clear()
            order = np.argsort(token, kind="stable")
            token, r = token[order], r[order]
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            times = np.diff(np.concatenate([edge, [len(token)]]))
            single = (r & FLAG) == 0
            mine = r[np.repeat(times > 1, times) & single].astype(np.int64)
            shared.append((mine, np.ones(len(mine), np.int64)))
            df = np.add.reduceat(np.where(single, 1, r & ~FLAG).astype(np.int64), edge)
            often = np.flatnonzero(df >= FREQUENT)
            yield rows(1, token[edge[often]].astype(np.int64), df[often])
        if shared:
            who, back = np.unique(np.concatenate([s[0] for s in shared]), return_inverse=True)
            yield rows(0, who, np.bincount(back, np.concatenate([s[1] for s in shared]), len(who)).astype(np.int64))
        trim()

    found = own.mapInArrow(map_side, packed)
    dealt = found.repartition(wanted, "bucket") if wanted > usual else found.repartition("bucket")
    return materialize(dealt.mapInArrow(meet, "kind int, k long, v long, a long, b long, ref long"))


def sorted_sets(docs: DataFrame, chosen: DataFrame, frequent: DataFrame, key: str, text: str) -> DataFrame:
    """(sid, n, tokens): the whole sets of the chosen keys, frequent shingles last."""
    spark = docs.sparkSession
    top = frequent.orderBy(F.desc("v"), "k").limit(MAX_FREQUENT).toArrow()
    often, times = top["k"].to_numpy().astype(np.uint64), top["v"].to_numpy()
    order = np.argsort(often)
    shared, token = spark.sparkContext.broadcast((often[order], times[order])), uuid.uuid4().hex

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = once("frequent", token, lambda: shared.value)
        for part, data, off in chunks(batches, "whole"):
            shingle, size = shingle_sets(data, off)
            start = np.concatenate([[0], np.cumsum(size)])
            a = np.add.reduceat(np.append(mix(shingle), np.uint64(0)), start[:-1]).view(np.int64)
            b = np.add.reduceat(np.append(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0)), start[:-1]).view(np.int64)
            weight = np.zeros(len(shingle), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, shingle >> np.uint64(16)), len(often) - 1)
                weight = np.where(often[at] == shingle >> np.uint64(16), times[at], 0)
            order = np.lexsort((shingle, weight, np.repeat(np.arange(len(size)), size)))
            lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(shingle[order].view(np.int64)))
            cell = ((shingle >> np.uint64(7)) % np.uint64(BITS)).astype(np.int64) + np.repeat(np.arange(len(size)), size) * BITS
            odd = (np.bincount(cell, minlength=len(size) * BITS) & 1).astype(np.uint8)
            bits = np.packbits(odd, bitorder="little").view("<i8")
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits))
            same = (part.column(2).to_numpy(zero_copy_only=False) == a) & (part.column(3).to_numpy(zero_copy_only=False) == b) & (size > 0)
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), lists, parity], names=["sid", "n", "tokens", "bits"])
            yield out.filter(pa.array(same))

    texts = chosen.join(docs.select(F.col(key).cast("long").alias("sid"), F.col(text).alias("whole")), "sid").select("sid", "whole", "a", "b")
    return materialize(texts.mapInArrow(build, "sid long, n int, tokens array<long>, bits array<long>").groupBy("sid", "n", F.xxhash64("tokens").alias("h")).agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits")).drop("h"))


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y) with the sizes of both sets and of what they share."""
    left = sets.select(F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    met = pairs.join(left, "x").join(right, "y")
    return met.select("x", "y", "nx", "ny", F.size(F.array_intersect("tx", "ty")).alias("both"))


def links(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both"))


def distance() -> Column:
    return 1 - F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))


def differences(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (x, y): diff, the shingles that only one of both sets has; the distance d; and whether they link, which is
    cost <= room: cost is 100 for each shingle that x lacks and `percent` for each that y lacks."""
    left = sets.select(F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    met = pairs.join(left, "x").join(right, "y").select("x", "y", "nx", "ny", F.array_except("ty", "tx").alias("gone"), F.array_except("tx", "ty").alias("new"))
    both = F.col("ny") - F.size("gone")
    return met.select("x", "y", (100 * F.size("gone") + percent * F.size("new")).alias("cost"), ((100 - percent) * F.col("ny")).alias("room"), (1 - both / (F.col("nx") + F.size("gone"))).alias("d"), F.concat("gone", "new").alias("diff"))


def derived(asking: DataFrame, rays: DataFrame, percent: int) -> DataFrame:
    """(base, other) for which an asking set of `other` links with a member of `base`.

    Let c be the central set of `base`, a member x and an asking set y differ from it by X and Y. They share
    |c| less the shingles that either lacks, more |X and Y|; so they link where (100 + percent) * |X and Y| is x's
    cost and y's excess (cost over room) at least. y does not link with c, so its excess is over 0, and X and Y must meet.
    Shingles that one side alone has go first, with all sets that have too few others left; then the sets meet
    by the rarest shingles of what is left, by as many as the overlap that is due makes necessary."""
    due = lambda cost, excess: F.ceil((F.col(cost) + F.col(excess)) / (100 + percent))
    least = asking.groupBy("base").agg(F.min("excess").alias("least"))
    members = rays.withColumnRenamed("y", "base").join(least, "base").select("base", "x", "cost", "least", "diff")
    ask = asking.select("base", "sid", "excess", F.explode("diff").alias("e"))
    have = members.select("base", "x", due("cost", "least").alias("due"), "cost", F.explode("diff").alias("e"))
    count = lambda key: F.count("*").over(Window.partitionBy("base", key))
    have = materialize(have.join(ask.select("base", "e").distinct(), ["base", "e"], "left_semi").withColumn("left", count("x")).where("left >= due"))
    cheap = have.groupBy("base").agg(F.min("cost").alias("cheap"))
    ask = ask.join(have.select("base", "e").distinct(), ["base", "e"], "left_semi").join(cheap, "base").withColumn("due", due("cheap", "excess"))
    ask = materialize(ask.withColumn("left", count("sid")).where("left >= due"))
    often = have.groupBy("base", "e").agg(F.count("*").alias("f")).join(ask.groupBy("base", "e").agg(F.count("*").alias("g")), ["base", "e"]).select("base", "e", (F.col("f") * F.col("g")).alias("f"))
    head = lambda rows, key: rows.join(often, ["base", "e"], "left").na.fill(0, ["f"]).withColumn("at", F.row_number().over(Window.partitionBy("base", key).orderBy("f", "e"))).where("at <= left - due + 1").select("base", key, "e")
    pairs = head(have, "x").join(head(ask, "sid"), ["base", "e"]).select("base", "x", "sid").distinct()
    met = pairs.join(members.select("base", "x", "cost", F.col("diff").alias("dx")), ["base", "x"]).join(asking.withColumnRenamed("diff", "dy"), ["base", "sid"])
    return met.where((100 + percent) * F.size(F.array_intersect("dx", "dy")) >= F.col("cost") + F.col("excess")).select("base", "other").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node but the least of its component, and that least node; alternating star contraction."""
    e = materialize(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct())
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        nodes = e.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        if nodes["n"] == nodes["d"] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return e


def with_bits(df: DataFrame, bits: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(bits.select(F.col("sid").alias(key), F.col("bits").alias(name)), key)


def may_link(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """Whether two sets can reach the overlap by the parities of their shingles in `BITS` cells: cells that differ
    need a shingle that only one set has."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 + percent) * (F.col(na) + F.col(nb) - apart) >= 2 * percent * (F.col(na) + F.col(nb))


def classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(sid, label): the least key of the class of every set that links with another."""
    n = F.col("n")
    first = n - F.ceil(n * percent / 100).cast("int") + 1
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    every = sets.select("sid", "n", first.alias("first"), F.posexplode(F.slice("tokens", F.lit(1), first)).alias("pos", "token"))
    met = every.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    lists = materialize(every.join(met, "token"))
    # sets with few shingles of their own stand in the middle of their class
    odd = materialize(lists.groupBy("sid").agg((F.first("first") - F.count("*")).cast("int").alias("odd"), F.first("n").alias("n")))
    bits = sets.select("sid", "bits")

    def compared(pairs: DataFrame) -> DataFrame:
        return verify(sets, pairs).where(links(percent)).select("x", "y")

    # each list: all its sets against the one most in the middle
    lists = lists.join(odd.select("sid", "odd"), "sid")
    middle = lists.groupBy("token").agg(F.min(F.struct("odd", "sid", "n")).alias("m")).select("token", F.col("m.sid").alias("y"), F.col("m.n").alias("ny"))
    stars = lists.join(middle, "token").where((F.col("sid") != F.col("y")) & fits(F.col("n"), F.col("ny"))).select(F.col("sid").alias("x"), "y").distinct()
    found = materialize(compared(stars))
    near_label = found.groupBy(F.col("x").alias("sid")).agg(F.min("y").alias("label"))  # one step is enough here
    # each list once more: of every class the set most in the middle against that of the largest class
    named = lists.join(near_label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    of_class = materialize(named.groupBy("token", "label").agg(F.count("*").alias("c"), F.min(F.struct("odd", "sid", "n")).alias("m")))
    largest = of_class.groupBy("token").agg(F.min(F.struct(-F.col("c"), F.col("m.odd"), F.col("m.sid"), F.col("m.n"))).alias("g"), F.count("*").alias("k")).where("k > 1").select("token", F.col("g.sid").alias("y"), F.col("g.n").alias("ny"))
    again = of_class.join(largest, "token").where((F.col("m.sid") != F.col("y")) & fits(F.col("m.n"), F.col("ny"))).select(F.col("m.sid").alias("x"), "y").distinct()
    label = components(found.unionByName(compared(again))).select(F.col("a").alias("sid"), F.col("b").alias("label"))
    # a class goes by its most central set
    placed = materialize(odd.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    center = materialize(placed.groupBy("label").agg(F.min(F.struct("odd", "sid"))["sid"].alias("cls"), F.count("*").alias("k")).withColumn("many", F.col("k") > 1))
    placed = materialize(join_hot(placed, center, ["label"], "k").select("sid", "cls", "many"))
    # classes that still meet in a list
    known = materialize(lists.join(placed, "sid").select("token", "cls", "many", "sid", "n", (F.col("n") - F.col("pos")).alias("rest")))
    entry = known.groupBy("token", "cls").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"), F.first("many").alias("many"))
    several = entry.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    entry = materialize(with_bits(entry.join(several, "token"), bits, "cls", "bits"))
    other = entry.select("token", *[F.col(c).alias(f"{c}_") for c in ("cls", "lo", "hi", "rest", "many", "bits")])
    reach = (100 + percent) * F.least("rest", "rest_") >= percent * (F.col("lo") + F.col("lo_"))
    sizes = (100 * F.col("hi") >= percent * F.col("lo_")) & (100 * F.col("hi_") >= percent * F.col("lo"))
    alike = F.col("many") | F.col("many_") | may_link("bits", "bits_", "lo", "lo_", percent)
    meet = materialize(entry.join(other, "token").where((F.col("cls") < F.col("cls_")) & reach & sizes & alike).select("token", "cls", "cls_"))
    pairs = materialize(verify(sets, meet.select(F.col("cls").alias("x"), F.col("cls_").alias("y")).distinct()).select(F.col("x").alias("cls"), F.col("y").alias("cls_"), distance().alias("d"), links(percent).alias("link")))
    # how the members of those classes differ from their central sets; a class of one set has no radius
    open_pairs = pairs.where(~F.col("link"))
    wanted = open_pairs.select("cls").unionByName(open_pairs.select(F.col("cls_").alias("cls"))).distinct()
    spokes = placed.where("many and sid <> cls").join(wanted, "cls").select(F.col("sid").alias("x"), F.col("cls").alias("y"))
    rays = materialize(differences(sets, spokes, percent))
    radius = materialize(rays.groupBy("y").agg(F.max("d").alias("r"), F.count("*").alias("k")))
    side = lambda s: radius.select(F.col("y").alias(f"cls{s}"), F.col("r").alias(f"r{s}"), F.col("k").alias(f"k{s}"))
    near = open_pairs.join(side(""), "cls", "left").join(side("_"), "cls_", "left").na.fill(0.0, ["r", "r_"]).na.fill(0, ["k", "k_"])
    far = 1 - percent / 100 + 1e-9
    near = near.where((F.col("r") + F.col("r_") > 0) & (F.col("d") <= far + F.col("r") + F.col("r_")))
    pick = lambda a, b, name: F.when(F.col("k_") > F.col("k"), F.col(b)).otherwise(F.col(a)).alias(name)
    near = materialize(near.select(pick("cls", "cls_", "base"), pick("cls_", "cls", "other"), "d", pick("r", "r_", "r")))
    # the sets of the smaller class that may reach into the larger one ask there: they link with its central set or not
    members = rays.select(F.col("y").alias("other"), F.col("x").alias("sid"), F.col("d").alias("own"))
    asks = near.select("base", "other", F.col("other").alias("sid"), "r").unionByName(near.join(members, "other").where(F.col("d") - F.col("own") <= far + F.col("r")).select("base", "other", "sid", "r"))
    told = differences(sets, asks.select(F.col("sid").alias("x"), F.col("base").alias("y")), percent)
    told = materialize(asks.join(told.select(F.col("x").alias("sid"), F.col("y").alias("base"), "cost", "room", "d", "diff"), ["sid", "base"]).where(F.col("d") <= far + F.col("r")))
    direct = told.where(F.col("cost") <= F.col("room")).select("base", "other").distinct()
    asking = materialize(told.where(F.col("cost") > F.col("room")).join(direct, ["base", "other"], "left_anti").select("base", "other", "sid", (F.col("cost") - F.col("room")).alias("excess"), "diff"))
    # the answers of members follow from that of the central set and from what both differ from it in
    linked = derived(asking, rays, percent)
    edges = pairs.where("link").select("cls", "cls_").unionByName(direct.unionByName(linked).toDF("cls", "cls_"))
    joined = components(edges.select(F.col("cls").alias("x"), F.col("cls_").alias("y"))).select(F.col("a").alias("cls"), F.col("b").alias("top"))
    final = materialize(placed.join(joined, "cls", "left").select("sid", F.coalesce("top", "cls").alias("top")))
    least = materialize(final.groupBy("top").agg(F.min("sid").alias("label"), F.count("*").alias("k")).where("k > 1"))
    return join_hot(final, least, ["top"], "k").where(F.col("label").isNotNull()).select("sid", "label")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row of docs."""
    ready(docs.sparkSession)
    found = heads(docs, key, text, percent)
    rows = found.where("kind = 2").select(F.col("k").alias(key), F.col("v").alias("n"), "a", "b", "ref")
    least = rows.where((F.col("n") > 0) & F.col(key).isNotNull()).groupBy("a", "b", "n").agg(F.min(key).alias("sid"), F.count("*").alias("copies"))
    shared = found.where("kind = 0").groupBy(F.col("k").alias("ref")).agg(F.sum("v").alias("shared"))
    smallest = F.ceil(F.col("n") * percent / 100)
    asked = F.greatest(F.lit(1), F.ceil(smallest / 10))
    own = least.withColumn("ref", F.xxhash64("sid").bitwiseAND((1 << 31) - 1))
    chosen = own.join(shared, "ref").where(F.col("shared") >= asked).select("sid", "a", "b")
    sets = sorted_sets(docs, chosen, found.where("kind = 1").select("k", "v"), key, text)
    label = materialize(classes(sets, percent))
    named = materialize(least.join(label, "sid", "left").select("a", "b", "n", "copies", F.coalesce("label", "sid").alias("component_id")))
    out = join_hot(rows, named, ["a", "b", "n"], "copies")
    return out.select(key, F.col("n").alias("n_shingles"), F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"))


def brute(texts: dict[int, str | None], n: int = N, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The same by comparing all pairs, for tests."""
    import re

    sets, parent = {}, {k: k for k in texts}
    for k, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    def top(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            small, large = sorted((len(sets[x]), len(sets[y])))
            if small and 100 * small >= percent * large:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (small + large - both):
                    a, b = sorted((top(x), top(y)))
                    parent[b] = a
    return {k: (len(sets[k]), top(k)) for k in keys}
