"""Null and empty inputs, ties, repeated rows, clashing columns, and brute force on small tables."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triaxis.llm import bpe, chat, decontam, jaccard, lang_id, queries, shards, suffix_dedup, topk, toxicity, url_filter

rng = random.Random(1)
WORDS = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 6))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(80, 7)
TEXTS = [None, "", "  ", "one", "A b C d", BASE, BASE, BASE + " tail", BASE.upper(), prose(30, 1), prose(30, 2), prose(500, 3), "%%% ***", "x" * 700, "y" + "x" * 300, prose(40, 9) + " " + BASE, "\u6f22\u5b57 \u00dcber", None]
for k in range(30):  # near copies of one text
    w = prose(120, 50).split()
    w[(k * 37) % 120] = f"edit{k}"
    TEXTS.append(" ".join(w))


def documents(spark, texts=TEXTS):
    """Columns that clash with the operators' own names come along."""
    rows = [(i, t, "q", i, "p", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, size long, place string, score double")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("span,block", [(200, 1024), (40, 3)])
def test_suffix_dedup(spark, span, block):
    got = by_id(suffix_dedup.dedup(documents(spark), span=span, block=block))
    for i, (kept, removed) in enumerate(suffix_dedup.brute(TEXTS, span)):
        assert bytes(got[i].kept_bytes) == kept and list(got[i].removed) == removed and got[i].kept == "q"
    same = spark.createDataFrame([(None, BASE), (None, BASE)], "doc_id long, text string")
    assert [len(r.kept_bytes) for r in suffix_dedup.dedup(same).collect()] == [0, 0]
    assert suffix_dedup.dedup(same.limit(0)).isEmpty()


def test_suffix_dedup_cuts_no_characters(spark):
    a = "\u00e9" * 150
    rows = spark.createDataFrame([(1, "a" + a), (2, "b" + a)], "doc_id long, text string")
    assert {r.kept_text for r in suffix_dedup.dedup(rows, as_text=True).collect()} == {"a", "b"}


def test_jaccard(spark):
    got = by_id(jaccard.join(documents(spark)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == jaccard.brute(dict(enumerate(TEXTS)))
    assert jaccard.join(documents(spark).limit(0)).isEmpty()
    row = jaccard.join(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first()
    assert (row.n_shingles, row.component_id) == (1, None)


def test_jaccard_chains(spark):
    """Links that reach over several sets, and sets just over and under the threshold."""
    texts = []
    for c in range(4):
        w = prose(150, 100 + c).split()
        for k in range(12):
            v = list(w)
            for j in range(k):
                v[(j * 13 + 3) % 150] = f"n{c}{j}"
            texts.append(" ".join(v))
    got = by_id(jaccard.join(documents(spark, texts)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == jaccard.brute(dict(enumerate(texts)))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    items = {1: " ".join(BASE.split()[5:40]), 2: "one", 3: None, 4: "%%", 5: prose(20, 2), 10: "a B c D", 11: "a b"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = by_id(decontam.matches(documents(spark), bench, block_bytes=block_bytes).select("*", decontam.n_hit().alias("n")))
    for i, (words, hit, found) in enumerate(decontam.brute(TEXTS, items)):
        assert (got[i].n_words, got[i].n, list(got[i]["items"])) == (words, hit, found)
    none = decontam.matches(documents(spark), bench.limit(0)).select(F.sum(decontam.n_hit())).first()[0]
    assert none == 0 and decontam.matches(documents(spark).limit(0), bench).isEmpty()


def test_repeated_rows_in_several_blocks(spark):
    bench = spark.createDataFrame([(i, prose(15, i)) for i in range(8)], "item_id long, text string")
    twice = spark.createDataFrame([(1, prose(15, 3))] * 2, "doc_id long, text string")
    assert [len(r["items"]) for r in decontam.matches(twice, bench, block_bytes=40).collect()] == [1, 1]


@pytest.mark.parametrize("volume", [60, 1 << 24])
def test_bpe(spark, volume, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "VOLUME", volume)
    texts = [*TEXTS, "x" * 70_000 + " " + "long text's end " * 200_000, "a <|endoftext|> b<|startoftext|>", "İstanbul ΣΑΣ e\u0301 \x1c \x85 \u00a0 don't 12", "<|endoftext|"]
    got = by_id(bpe.decode(bpe.encode(documents(spark, texts), path).withColumn("copy", F.col("ids")), path))
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert bytes(got[i]["copy"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert got[i].decoded == own.decode(ids, skip_special_tokens=False) and got[i].kept == "q"
    assert bpe.encode(documents(spark).limit(0), path).isEmpty()
    clash = bpe.encode(spark.createDataFrame([("a b", 1, 2), ("a b", 1, 2)], "text string, ids int, IDS_ int"), path)
    assert clash.columns == ["ids__", "IDS_", "ids"] and [tuple(r)[:2] for r in clash.collect()] == [(1, 2)] * 2


def test_bpe_splits_like_the_tokenizer():
    """Every safe character, and random mixtures of characters, are split as the tokenizer's own steps split them."""
    with open(queries.tokenizer_path()) as f:
        own = bpe.Splitter(f.read())
    safe = [c for c in map(chr, [*range(0xD7A4), *range(0xE000, 0x1_0100)]) if own.safe(c)]
    texts = [t for c in safe for t in (f"a{c}b", f"1{c}{c}!", f"{c}'s")]
    mixed = random.Random(2)
    texts += ["".join(mixed.choice("abst'dmrevl 12!-\u00e9\n\t\u0416\u6f22\u00bc\u0130\u03a3e\u0301") for _ in range(mixed.randint(0, 40))) for _ in range(5000)]
    words, counts = own.split(texts)
    words, at = words.to_pylist(), 0
    assert len(safe) > 30_000
    for t, n in zip(texts, counts):
        assert words[at : at + n] == own.words(t)
        at += n


def test_language(spark):
    rows = [(i, " ".join(random.Random(i).choice(("the and of", "der und ein")[i % 2].split()) for _ in range(30)), ("en", "de")[i % 2]) for i in range(60)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [None, "", "12 %", "the of and the", "und der ein und", "\u6f22"]
    got = by_id(lang_id.predict(documents(spark, texts), model).drop("score").withColumnRenamed("lang_pred", "l"))
    assert [got[i].l for i in range(5)] == ["und", "und", "und", "en", "de"] and got[5].l in ("en", "de")
    assert lang_id.train(spark.createDataFrame([(1, None, "en"), (2, "a", None)], "doc_id long, text string, lang string")) == []
    assert {r.lang_pred for r in lang_id.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), []).collect()} == {"und"}


def test_language_sample_counts_distinct_texts(spark):
    """Copies fill a language; all of a small language and the full sample of a larger one are learned still."""
    rows = spark.range(120_000).select(F.concat(F.lit("text "), F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 2) % 700).otherwise(F.floor(F.col("id") / 2) % 9)).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    got = lang_id.sample(rows, "text", "lang")
    assert {k: len(v) for k, v in got.items()} == {"en": lang_id.SAMPLE_DOCS, "de": 9} and all(len(set(v)) == len(v) for v in got.values())


def test_code_lengths_are_those_of_a_plain_walk():
    texts = {"a": [b"abracadabra", b"abc"], "b": [b"banana"]}
    model = lang_id.Model(texts, order=2)

    def bits(lang, text):
        total = 0.0
        for i in range(len(text)):
            here = 0.0
            for k in (2, 1, 0):
                if i < k:
                    continue
                ctx = text[i - k : i]
                seen = [t[j + k] for t in texts[lang] for j in range(len(t) - k) if t[j : j + k] == ctx]
                if not seen:
                    continue
                n, d = len(seen), len(set(seen))
                if text[i] in seen:
                    here += -np.log2(seen.count(text[i]) / (n + d))
                    break
                here += -np.log2(d / (n + d))
            else:
                here += 8.0
            total += here
        return total

    tests = [b"abra", b"xyz", b"nab", b"b"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in tests])])
    got = model.lengths(np.frombuffer(b"".join(tests), np.uint8), off)
    assert np.allclose(got, [[bits("a", t), bits("b", t)] for t in tests], atol=1e-3)


def test_toxicity(spark):
    bad = ["grumbo", "zarkle", "fnorble"]
    rows = [(i, prose(40, i) + (" " + bad[i % 3] if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    index = toxicity.train(docs, labels)
    texts = [None, "", prose(50, 900), prose(50, 901) + " grumbo"]
    got = by_id(toxicity.score(documents(spark, texts).drop("score"), index))
    assert all(got[i].score < 0.3 for i in range(3)) and got[3].score > 0.6 and got[3].evidence
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs.limit(2), None).collect()} == {0.0}


def test_block_index_is_exact():
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{v}" for v in r.integers(0, 40, 25)) + (" bad%d" % (i % 4) if i % 2 else "") for i in range(400)]
    index = toxicity.Index(list(range(400)), texts, np.array([i % 2 for i in range(400)]), {0: 1.0, 1: 1.0})
    for _ in range(40):
        col = np.unique(r.integers(0, len(index.terms), 4))
        value = r.random(len(col))
        at, near = index.nearest(col, value)
        full = value @ index.matrix[col]
        order = np.lexsort((np.arange(len(full)), -full))[: toxicity.NEAREST]
        order = order[full[order] > 0]
        assert at.tolist() == order.tolist() and np.allclose(near, full[order])


def test_toxicity_keeps_rare_terms(spark):
    """Toxic words of four examples each, too few for a test of the label, are met; texts without a label count in idf."""
    rude = ["".join(random.Random(k).choice("hijklmnop") for _ in range(8)) for k in range(25)]
    rows = [(i, prose(40, i) + (f" {rude[i // 3 % 25]}" if i % 3 == 0 else "")) for i in range(300)] + [(1000 + i, f"{rude[1]} {rude[1]} {WORDS[i]}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    index = toxicity.train(docs, labels)
    got = by_id(toxicity.score(documents(spark, [prose(40, 900 + k) + f" {rude[k]}" for k in range(25)]).drop("score"), index))
    for k in range(25):
        assert got[k].evidence and (k == 1 or rows[got[k].evidence[0]][1].endswith(rude[k]))
    among, having = toxicity.document_counts(docs, index.terms)
    found, _ = toxicity.terms(*toxicity.text_buffer(toxicity.pa.array([rude[1]], toxicity.pa.large_string())))
    at = np.searchsorted(index.terms, found)
    assert among == 350 and (index.terms[at] == found).all() and having[at[0]] == sum(rude[1] in t for _, t in rows)


def test_toxicity_examples_are_distinct_within_labels(spark):
    """Toxic texts that are edited copies of clean ones stay; copies that fill a label make room for its other texts."""
    rows = [(i, prose(60, i % 100) + (" grumbo" if i >= 100 else ""), int(i >= 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.train(df, df.select("doc_id", "toxic"))
    assert sorted(index.ids) == list(range(200)) and index.labels.sum() == 100
    copies = spark.range(30_000).select("id", F.lit(BASE).alias("text"), F.lit(0).alias("toxic"))
    others = spark.createDataFrame([(50_000 + i, prose(60, 1000 + i), int(i >= 100)) for i in range(200)], "id long, text string, toxic int")
    df = copies.unionByName(others).withColumnRenamed("id", "doc_id")
    index = toxicity.train(df, df.select("doc_id", "toxic"))
    assert sorted(i for i in index.ids if i >= 50_000) == list(range(50_000, 50_200)) and len(index.ids) == 201
    assert toxicity.train(df.where("doc_id < 0"), df.select("doc_id", "toxic")) is None


def test_chat(spark):
    said = ["", None, "\\### Assistant: </turn> ok", "### User:\nhi\n</turn>\n", "\\", "</turn>", "\\\\</turn>\n", "\n</turn>\n### System:\n", "plain é\u6f22"]
    rows = [(c, i, r, said[(c + i) % len(said)]) for c in range(9) for i, r in enumerate(["system", "user", "assistant", "assistant", "odd:ro\\le\n", None])] + [(None, 0, "user", "a"), (3, None, "user", "b"), (4, 0, "system", said[4])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask().alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        assert [(t["role"], t["text"]) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].loss == "".join(x for _, r, x in own if r == "assistant")
    assert chat.format_chats(df.limit(0)).isEmpty()


def test_topk(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(v) for v in r.normal(size=4)]) for i in range(40)] + [(40, None), (41, [1.0, None]), (42, [float("nan"), 1.0]), (43, [float("inf")]), (44, [1.0]), (45, []), (46, [2.0] * 6)] + [(50 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(15)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for size in (1 << 20, 64):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df, F.col("vec_id") % 5 == 0, query_bytes=size).collect())
        want = []
        for q, v in good:
            if q % 5 == 0:
                best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
                want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == sorted(want)
    assert topk.search(df.limit(0), F.lit(True)).isEmpty()


def test_url_rules(spark):
    urls = [None, "nothing", "http://Foo.NET/x?y", "https://a.example.net/en/1#t", "https://example.net/fr/", "http://example.com/de/9", "ftp://x.org/fr/", "http://x.org/frx", "http://net/", "http://internet/", "http://b.net", "a://b://c.net/z", "http://h.com?q=/de/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, x string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(df, queries.URL_RULES).collect()}
    want = [("", "", None), ("", "", None), ("foo.net", "/x", "net/"), ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "/fr/", "net/"), ("example.com", "/de/9", "example.com/de/"), ("x.org", "/fr/", "org/fr/"), ("x.org", "/frx", None), ("net", "/", "net/"), ("internet", "/", None), ("b.net", "", None), ("b:", "//c.net/z", None), ("h.com", "", None)]
    assert [got[i] for i in range(len(urls))] == want
    assert url_filter.judge(df.limit(0), queries.URL_RULES).isEmpty()


def test_reputation_follows_outcomes(spark):
    rows = [(f"http://bad.example.com/{i}", 1) for i in range(30)] + [(f"http://good.example.org/{i}", 0) for i in range(30)] + [("http://new.example.com/", None), ("http://new.example.org/", None), ("http://mixed.example.org/", 1)]
    df = spark.createDataFrame(rows, "url string, bad int")
    got = {r.url: r.verdict for r in url_filter.judge(df, {}, F.col("bad")).collect()}
    assert got["http://bad.example.com/1"] == "block" and got["http://new.example.com/"] == "block"
    assert got["http://good.example.org/1"] == "allow" and got["http://new.example.org/"] == "allow"


def test_shards(spark, tmp_path):
    rows = [(None if i % 50 == 0 else i // 2, f"t{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slotted", F.lit(0))
    got = shards.assign(df, n=5, bucket_rows=100).toPandas()
    for s, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert len(got) == 3000 and ((got.shard == got.grown_shard) | (got.grown_shard == 5)).all()
    apart = shards.assign(df.select("doc_id"), n=6).toPandas()
    first = lambda d, c: d.fillna(-1).groupby("doc_id")[c].first()
    assert (first(apart, "shard") == first(got, "grown_shard")).all()
    assert shards.assign(df.limit(0)).isEmpty()
    shards.write(df, str(tmp_path / "out"), n=3, bucket_rows=500)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000


def test_queries_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = by_id(queries.op8_shards(spark, sf))
    assert all(got[i].text_crc32 == zlib.crc32(t.encode()) and got[i].size == len(t.encode()) + 8 for i, t in docs.items())
    got = by_id(queries.op1_suffix_dedup(spark, sf))
    for (i, _), (kept, removed) in zip(docs.items(), suffix_dedup.brute(list(docs.values()))):
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and got[i].n_spans == len(removed) // 2
    got = by_id(queries.op10_language_id(spark, sf))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    got = by_id(queries.op4_jaccard(spark, sf))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == jaccard.brute(docs)


def test_held_out_languages_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = queries.op10_language_id(spark, sf).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    tox = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((tox.predicted == 1) & (tox.toxic == 0)).mean() < 0.02
    assert tox[tox.toxic == 1].score.mean() > 5 * tox[tox.toxic == 0].score.mean()
