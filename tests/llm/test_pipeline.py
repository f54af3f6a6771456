"""The pipeline against plain versions of its stages."""

import struct
import hashlib

import corpus_pipeline
from triaxis.llm import decontam, jaccard, queries, suffix_dedup
from triaxis.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in list(steps)[:-1]:
        docs = materialize(steps[name](spark, docs, SF))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    want = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert kept["language_id"] == want
    classes = jaccard.brute(want)
    want = {i: t for i, t in want.items() if classes[i][1] == i}
    assert kept["ngram_jaccard"] == want
    cut = dict(zip(want, suffix_dedup.brute(list(want.values()))))
    want = {i: k.decode(errors="ignore") for i, (k, _) in cut.items() if k.decode(errors="ignore") or not want[i]}
    assert kept["suffix_dedup"] == want
    found = dict(zip(want, decontam.brute(list(want.values()), items)))
    want = {i: t for i, t in want.items() if not (found[i][1] and 20 * found[i][1] >= found[i][0])}
    assert kept["decontamination"] == want
    own = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in steps["bpe"](spark, docs, SF).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        ids = own.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
