"""The queries of this subpackage: each applies one operator to its whole table and derives the digests asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed values of the contract: rules, longest first when they fit alike.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.dedup(docs)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(table(spark, sf_dir, "conversations").select(planted.columns).unionByName(planted))
    read = chats.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.under_mask())
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_escaped").cast("long").alias("n_escaped"),
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    index = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, index, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shards

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    records = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shards.assign(records)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    hit = F.col("n_hit")
    return (
        found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
        .withColumn("contaminated", decontam.contaminated(hit, F.col("n_words")))
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lang_id

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True))
    model = lang_id.train(docs.where(~held_out).select("text", "lang"))
    return lang_id.predict(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_digests(docs: DataFrame) -> DataFrame:
    """n_tokens, and digests of the ids and of the text decoded from them, in place of `text`."""
    from . import bpe

    ids = bpe.encode(docs, tokenizer_path())
    own = [c for c in docs.columns if c != "text"]
    digests = ids.select(*own, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(digests, tokenizer_path()).select(*own, "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()
