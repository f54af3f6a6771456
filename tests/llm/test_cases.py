"""Collisions, clashing columns, long texts, repeated rows, and whole queries against plain versions."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from triaxis.llm import bpe, chat, common, decontam, jaccard, lang_id, queries, shards, suffix_dedup, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"
WORDS = ["".join(random.Random(k).choice("abcdefghij") for _ in range(random.Random(-k).randint(2, 7))) for k in range(200)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64, whatever the base."""
    texts = [morse(2048, "a", "b"), morse(2048, "b", "a"), "c " + morse(2048, "a", "b")]
    got = by_id(jaccard.join(frame(spark, texts)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == jaccard.brute(dict(enumerate(texts)))
    bench = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    got = by_id(decontam.matches(frame(spark, texts), bench).select("doc_id", decontam.n_hit().alias("n")))
    assert [got[i].n for i in range(3)] == [1, 0, 1]


def test_word_hashes_tell_words_apart():
    words = sorted({bytes(random.Random(i).choices(b"\x00ab", k=random.Random(-i).randint(0, 80))) for i in range(4000)})
    data = np.frombuffer(b"|".join(words) + b"|", np.uint8)
    hi = np.cumsum([len(w) + 1 for w in words]) - 1
    assert len(set(common.word_hashes(data, hi - [len(w) for w in words], hi).tolist())) == len(words)


def edited(base, r, words=True):
    w = list(base)
    for _ in range(r.randint(0, 5)):
        at = r.randrange(len(w))
        turn = r.random()
        if turn < 0.4:
            w[at] = r.choice(["x1", "x2"]) if r.random() < 0.5 else f"n{r.random()}"
        elif turn < 0.7:
            del w[at]
        else:
            w.insert(at, r.choice(["y1", "y2"]))
    lo = r.randint(0, 6) if r.random() < 0.3 else 0
    return " ".join(w[lo:])


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_of_edited_groups(spark, seed):
    """Groups of substitutions, deletions and cut heads around one text, where classes lie close without a link."""
    r = random.Random(seed)
    texts = []
    for g in range(3):
        base = [r.choice(WORDS) for _ in range(r.choice([60, 110]))]
        texts += [edited(base, r) for _ in range(150)]
    got = by_id(jaccard.join(frame(spark, texts)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == jaccard.brute(dict(enumerate(texts)))


def test_derived_links_are_those_of_whole_sets(spark):
    """The answers derived from differences against a comparison of all members with all asking sets."""
    r = random.Random(5)
    center = set(range(100))
    sets = {0: center}
    for k in range(1, 120):
        near = k >= 60 and k % 2
        start = sets[r.randrange(1, 60)] if near else center
        gone = set(r.sample(sorted(start), 5 if near else r.randint(6, 12 if k < 60 else 16)))
        sets[k] = (start - gone) | {1000 + r.randrange(25) for _ in range(2 if near else r.randint(4, 9))}
    rows = spark.createDataFrame([(k, len(v), sorted(v)) for k, v in sets.items()], "sid long, n int, tokens array<long>")
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    members = [k for k in sets if 0 < k < 60]
    asks = [k for k in sets if k >= 60 and not link(sets[k], center)]
    pairs = lambda ks: spark.createDataFrame([(k, 0) for k in ks], "x long, y long")
    rays = jaccard.differences(rows, pairs(members), 80)
    told = jaccard.differences(rows, pairs(asks), 80)
    assert {x.x for x in jaccard.differences(rows, pairs(range(1, 120)), 80).where("cost <= room").collect()} == {k for k in range(1, 120) if link(sets[k], center)}
    asking = told.select(F.col("y").alias("base"), F.col("x").alias("other"), F.col("x").alias("sid"), (F.col("cost") - F.col("room")).alias("excess"), "diff")
    want = {k for k in asks if any(link(sets[k], sets[m]) for m in members)}
    assert {x.other for x in jaccard.derived(asking, rays, 80).collect()} == want and want and len(want) < len(asks)


def test_longest_matches(spark):
    item = prose(60, 1).split()
    texts = [" ".join(["q"] * 3 + item[10:40] + ["q"] + item[20:34]), " ".join(item), "a " * 300, prose(50, 2), None, " ".join(item[:13]) + " " + " ".join(item[:14])]
    items = [(1, " ".join(item)), (2, "a " * 40), (3, "a"), (4, "a b"), (2, "a " * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    for block_bytes in (1 << 20, 100):
        got = by_id(decontam.matches(frame(spark, texts), bench, block_bytes=block_bytes))
        for d, t in enumerate(texts):
            w, want = words(t), {}
            for i, b in items:
                v = words(b)
                for s in range(len(w)):
                    for p in range(len(v)):
                        n = 0
                        while s + n < len(w) and p + n < len(v) and w[s + n] == v[p + n]:
                            n += 1
                        if n >= min(13, len(v)):
                            want[str(i)] = min(want.get(str(i), (0, 0, 0)), (-n, s, p))
            assert [(m["item"], (-m["words"], m["at"], m["item_at"])) for m in got[d].longest] == sorted(want.items())


def test_longest_matches_over_several_looks(monkeypatch):
    """Finds that are looked at in many parts give the same matches."""
    bench = decontam.Benchmark(["1", "2"], ["a " * 30, "b " + "a " * 20])
    data, off = common.text_buffer(pa.array(["a " * 90 + "b " + "a " * 50, "a " * 13], pa.string()))
    want = decontam.match(bench, data, off)[3]
    monkeypatch.setattr(decontam, "PAIRS", 40)
    assert decontam.match(bench, data, off)[3] == want and want[0][1] == (21, 90, 0)


def test_suffix_dedup_on_any_partitions_and_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = {r.doc_id: kept for r, (kept, _) in zip(rows, suffix_dedup.brute([r.text for r in rows]))}
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "100000")
    try:
        for n in (1, 7):
            assert {i: bytes(r.kept_bytes) for i, r in by_id(suffix_dedup.dedup(docs.repartition(n), block=16)).items()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_long_texts(spark, tmp_path):
    """Texts over a chunk, a pack and a piece, through every operator."""
    from tokenizers import Tokenizer

    r = random.Random(4)
    plain = " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(700_000))  # 4.9 MB
    shared = prose(200, 9)
    texts = [plain + " " + shared, shared, "x" * 3_000_000, "é" * 10]
    docs = frame(spark, texts)
    got = by_id(suffix_dedup.dedup(docs))
    # every "x" is covered; of the other texts only the shared passage
    assert [len(got[i].kept_bytes) for i in range(4)] == [len(plain) + 1, 0, 0, 20]
    assert {i: x.component_id for i, x in by_id(jaccard.join(docs)).items()} == {0: 0, 1: 1, 2: 2, 3: 3}
    bench = spark.createDataFrame([(7, shared)], "item_id long, text string")
    got = by_id(decontam.matches(docs, bench))
    assert [list(got[i].hits) for i in range(4)] == [[700_000, 700_200], [0, 200], [], []]
    path = queries.tokenizer_path()
    got = by_id(bpe.encode(docs, path))
    own = Tokenizer.from_file(path)
    for i in (0, 3):
        ids = own.encode(texts[i], add_special_tokens=False).ids
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids)
    models = lang_id.train(spark.createDataFrame([(shared, "a"), ("zzz yyy", "b")], "text string, lang string"))
    got = by_id(lang_id.predict(docs, models))
    assert got[1].lang_pred == "a" and math.isclose(got[0].bits, models[0].lengths(*common.text_buffer(pa.array([texts[0]], pa.large_string()))).min(), rel_tol=1e-6)
    index = toxicity.train(frame(spark, ["grumbo " + shared, prose(30, 1)]), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    got = by_id(toxicity.score(docs, index))
    assert got[1].score > 0.3 and len(got) == 4
    assert sorted(x.size for x in shards.assign(docs.withColumn("size", F.octet_length("text")), n=2).collect()) == sorted(len(t.encode()) for t in texts)
    chats = chat.format_chats(docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in chats.t] == texts


def test_clashing_columns(spark):
    """Columns named like those an operator adds are kept under a name with underscores; none is named twice."""
    path = queries.tokenizer_path()
    docs = frame(spark, ["a b c", None, "a b c"])
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = toxicity.train(docs, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int"))
    models = lang_id.train(spark.createDataFrame([("a b", "x")], "text string, lang string"))
    every = {
        "removed kept_bytes n_bytes": suffix_dedup.dedup,
        "n_words hits items longest": lambda d: decontam.matches(d, bench),
        "score evidence": lambda d: toxicity.score(d, index),
        "lang_pred score bits": lambda d: lang_id.predict(d, models),
        "ids": lambda d: bpe.encode(d, path),
        "shard slot grown_shard": shards.assign,
    }
    for names, apply in every.items():
        own = names.split()
        rich = docs
        for n in own:
            rich = rich.withColumn(n, F.lit("mine"))
        rich = rich.withColumn(own[0].upper() + "_", F.lit("other"))
        out = apply(rich)
        assert len({c.casefold() for c in out.columns}) == len(out.columns)
        rows = out.collect()
        assert len(rows) == 3 and all(r[f"{own[0]}__"] == "mine" and r[own[0].upper() + "_"] == "other" and r[own[0]] != "mine" for r in rows)
        assert apply(rich.limit(0)).isEmpty()
    pages = spark.createDataFrame([("http://a.net/x", "mine", "mine")] * 2, "url string, host string, VERDICT string")
    rows = url_filter.judge(pages, queries.URL_RULES).collect()
    assert [(r["host_"], r["VERDICT_"], r["host"], r["verdict"]) for r in rows] == [("mine", "mine", "a.net", "block")] * 2


def spark_hash(*parts):
    """Spark's xxhash64 of longs (8 bytes) and ints (4 bytes)."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", p) if isinstance(p, np.int64) else struct.pack("<i", p), seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_shards_by_brute_force(spark):
    got = by_id(queries.op8_shards(spark, SF))
    choose = lambda key, n: max(range(n), key=lambda j: (spark_hash(np.int64(key), shards.SEED, j), -j))
    for i, r in got.items():
        assert (r.shard, r.grown_shard) == (choose(i, 24), choose(i, 25))
    for s in range(24):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))


def test_slots_do_not_depend_on_partitions(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    hot = rows.unionByName(spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = shards.assign(hot.repartition(n + 1), n=3, bucket_rows=150).collect()
            seen.append(sorted(map(tuple, out)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) == 5000
    slots = [r[3] for r in seen[0] if r[1] == "same"]
    shard = [r[3] for r in seen[0] if r[2] == [x for x in seen[0] if x[1] == "same"][0][2]]
    # rows that are alike are spread over their whole shard, and no order is left in the others
    assert len(set(slots)) == 2000 and np.corrcoef(sorted(slots), range(2000))[0, 1] > 0.99 and max(slots) > 0.98 * max(shard)
    assert abs(np.corrcoef([r[0] for r in seen[0] if r[1] == "t" and r[2] == 0], [r[3] for r in seen[0] if r[1] == "t" and r[2] == 0])[0, 1]) < 0.1


def test_fisher_yates_is_a_fair_shuffle(spark):
    df = spark.range(6000).select(shards.fisher_yates(F.lit(4), 1, F.col("id")).alias("p"))
    seen = Counter(tuple(r.p) for r in df.collect())
    assert len(seen) == 24 and all(sorted(p) == [1, 2, 3, 4] for p in seen) and max(abs(c - 250) for c in seen.values()) < 80


def test_topk_repeats_and_wide_scores(spark):
    rows = [(0, [1.0, 2.0])] * 15 + [(0, [0.5, 9.0])] + [(i, [float(i), 1.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [*range(39, 29, -1)]  # by the least of the query's vectors
    wide = spark.createDataFrame([(0, [8e15, 0.0]), (1, [0.0, 8e15]), (2, [1e-3, 0.0]), (3, [-1e-3, 3.0])], "vec_id long, embedding array<double>")
    got = topk.search(wide, F.col("vec_id") == 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 8_192_000_000_000_000_000), (1, 0), (3, -2)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.search(wide, F.col("vec_id") == 0).collect()


def plain_bits(texts, order, text):
    """Code length by method C, walked byte by byte."""
    seen = {}
    for t in texts:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                seen.setdefault(t[i - k : i], Counter())[t[i]] += 1
    total = 0.0
    for i, c in enumerate(text):
        for k in range(min(order, i), -1, -1):
            have = seen.get(text[i - k : i])
            if have is None:
                continue
            n, d = sum(have.values()), len(have)
            if c in have:
                total += -math.log2(have[c] / (n + d))
                break
            total += -math.log2(d / (n + d))
        else:
            total += 8.0
    return total


def test_languages_by_brute_force(spark):
    """Prediction, score and bits of the whole query against a walk over the same sample."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lang_id.sample(docs.where(common.crc_mod("doc_id", 5) != 0), "text", "lang")
    got = by_id(queries.op10_language_id(spark, SF))
    small = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text)) and len(r.text) < 1500][:12]
    assert len(small) > 8
    for r in small:
        bits = {lang: plain_bits(t, lang_id.ORDER, r.text.encode()) for lang, t in texts.items()}
        best = min(sorted(bits), key=bits.get)
        x = got[r.doc_id]
        assert x.lang_pred == best and math.isclose(x.bits, bits[best], rel_tol=1e-4)
        assert math.isclose(x.score, 1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values()), rel_tol=0.05)


def test_many_languages_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "LANGS", 2)
    names = "abcde"
    rows = [(" ".join(f"{n}{x}{n}" for x in "uvwxyz" for _ in range(3)), n) for n in names]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    models = lang_id.train(labelled)
    assert [m.langs for m in models] == [["a", "b"], ["c", "d"], ["e"]]
    tests = frame(spark, [t for t, _ in rows] + [None, "5"])
    parts, one = by_id(lang_id.predict(tests, models)), by_id(lang_id.predict(tests, [lang_id.Model({n: [t.encode()] for t, n in rows})]))
    assert [parts[i].lang_pred for i in range(7)] == [*names, "und", "und"]
    assert all(one[i].lang_pred == parts[i].lang_pred and math.isclose(one[i].score, parts[i].score, rel_tol=1e-3) for i in range(7))


def test_toxicity_by_brute_force(spark):
    """Nearest examples and scores of whole texts against plain TF-IDF cosines over all terms of all examples."""
    r = random.Random(8)
    rows = [(i, prose(r.randint(5, 60), i) + (f" rude{i % 7}" if i % 3 == 0 else "")) for i in range(150)]
    labels = {i: int(i % 3 == 0) for i in range(120)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    terms = lambda t: Counter(x for w in re.findall(r"[a-z0-9]+", t.lower()) for x in ((0, w), (4, w[:4]), (6, w[:6])))
    every = {i: terms(t) for i, t in rows}
    examples = sorted(index.ids)
    assert set(examples) <= set(labels)
    n, yes = len(examples), sum(labels[i] for i in examples)
    vocabulary = {t for i in examples for t in every[i]}
    weight = {}
    half = toxicity.HALF_CHI2 + 2 * math.log(len(vocabulary))
    for t in vocabulary:
        df, pos = sum(t in every[i] for i in examples), sum(t in every[i] and labels[i] for i in examples)
        a, b, c, d = pos, df - pos, yes - pos, n - yes - df + pos
        below = df * (n - df) * yes * (n - yes)
        chi2 = n * (a * d - b * c) ** 2 / below if below else 0.0
        held = sum(t in x for x in every.values())
        weight[t] = (math.log((1 + len(rows)) / (1 + held)) + 1) * (1 + chi2) / (1 + chi2 + half)

    def unit(x):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in x.items() if t in weight}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {t: a / norm for t, a in v.items()}

    vectors = {i: unit(every[i]) for i in examples}
    rate = {y: sum(labels[i] == y for i in examples) / sum(v == y for v in labels.values()) for y in (0, 1)}
    base = sum(labels[i] / rate[labels[i]] for i in examples) / sum(1 / rate[labels[i]] for i in examples)
    for i, got in by_id(toxicity.score(docs, index)).items():
        v = unit(every[i])
        near = sorted(((sum(a * u.get(t, 0.0) for t, a in v.items()), e) for e, u in vectors.items()), reverse=True)
        top = [(s, e) for s, e in near if s > 0][: toxicity.NEAREST]
        votes = [(s * s / rate[labels[e]], labels[e]) for s, e in top]
        want = (sum(w * y for w, y in votes) + toxicity.PRIOR * base) / (sum(w for w, _ in votes) + toxicity.PRIOR)
        assert math.isclose(got.score, want, rel_tol=1e-6) and math.isclose(sum(a * vectors[got.evidence[0]].get(t, 0.0) for t, a in v.items()), top[0][0], rel_tol=1e-9)


def test_toxicity_recall_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) & (got.toxic == 1)).sum() >= 0.9 * (got.toxic == 1).sum()
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.02 * (got.toxic == 0).sum()


def test_toxicity_with_text_keys_and_repeats(spark):
    docs = spark.createDataFrame([("a", "grumbo one two"), ("b", "three four five"), ("a", "grumbo one two"), (None, "grumbo")], "doc_id string, text string")
    index = toxicity.train(docs, spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, toxic int"))
    got = toxicity.score(docs, index).collect()
    assert len(got) == 4 and {r.evidence[0] for r in got if "grumbo" in r.text} == {"a"}
    assert toxicity.score(docs.limit(0), index).isEmpty()


def test_suffixes_of_hosts(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "x.com", "www.x.com:8080", "1.2.3.4:80", "[::1]:80", "", "localhost", "a.b.de", "z.org.museum"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_filter.tail(F.col("h"), 1).alias("d"), url_filter.tail(F.col("h"), 0).alias("s"))
    want = [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("x.com", "com"), ("x.com", "com"), ("1.2.3.4", "1.2.3.4"), ("[::1]", "[::1]"), ("", ""), ("localhost", "localhost"), ("b.de", "de"), ("org.museum", "museum")]
    assert [(r.d, r.s) for r in df.collect()] == want


def test_hot_keys_join_by_broadcast(spark, monkeypatch):
    """Rows of hot and other keys, of keys that the table lacks, and null keys."""
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), ("c", 1), (None, 1)], "k string, v int")
    table = spark.createDataFrame([("a", 9, "x"), ("b", 1, "y"), (None, 1, "z")], "k string, n int, w string")
    got = sorted((r.k or "", r.v, r.w) for r in common.join_hot(rows, table, ["k"], "n").select("k", "v", "w").collect())
    assert got == [("", 1, None)] + [("a", i, "x") for i in range(9)] + [("b", 1, "y"), ("c", 1, None)]


def test_released_tables_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    table = common.materialize(spark.range(5))
    assert table.count() == 5 and list((tmp_path / "shared").rglob("*.parquet"))
    common.release(spark)
    assert not list((tmp_path / "shared").rglob("*.parquet"))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null, empty and repeated rows, null and repeated ids, clashing columns, and empty tables."""
    long_ = prose(300, 3)
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %", None), (4, long_, "en"), (5, long_, "en"), (None, prose(40, 5), "en"), (6, prose(50, 6), "en"), (6, prose(50, 6), "en"), (7, prose(50, 7) + " " + long_[:400], None), (8, "über das Haus", "de")]
    kind = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, kind).withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("mine"), "hits": F.lit("mine"), "removed": F.lit(1), "KEPT_TEXT": F.lit(2)})
    bench = spark.createDataFrame([(1, prose(50, 6))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for some, want in ((docs, {4, None, 7, 8}), (docs.limit(0), set())):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.materialize(stage(spark, now, str(tmp_path)))
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        assert {r.doc_id for r in now.collect()} == want and {r.score for r in now.collect()} <= {"mine"}
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert isinstance(out.schema["n_tokens"].dataType, T.LongType) and {r.doc_id for r in out.collect()} == want
