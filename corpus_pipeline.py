"""A pipeline from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is
written as Parquet and read again. All stages but the last return the columns of documents.

Null and empty texts, and texts without a letter, go in the first stage. Rows that share a doc_id count as one
document when near copies are joined; rows with a null doc_id stay there. Extra columns of any name are carried to the
last stage, which returns doc_id, lang, source and the digests. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triaxis.llm import decontam, jaccard, lang_id, suffix_dedup
from triaxis.llm.common import crc_mod, materialize
from triaxis.llm.queries import token_digests


def own_columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, which an operator hands on first and in order (renamed where they clash with its own)."""
    return found.select(found.columns[: len(docs.columns)]).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    model = lang_id.train(docs.where(crc_mod("doc_id", 5) != 0).select("text", "lang"))
    return own_columns(lang_id.predict(docs, model).where(lang_id.readable(F.col("lang_pred"))), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id."""
    classes = jaccard.join(docs.select("doc_id", "text"))
    others = classes.where(F.col("component_id") < F.col("doc_id")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches that stand elsewhere too; a text of nothing else goes."""
    cut = suffix_dedup.dedup(docs, as_text=True)
    left = cut.where(F.col("kept_text").isNull() | (F.col("kept_text") != "") | (F.col("n_bytes") == 0))
    others = [c for c in docs.columns if c != "text"]
    kept = left.select(*[F.col(a).alias(c) for a, c in zip(left.columns, others)], F.col("kept_text").alias("text")).select(docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    found = decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return own_columns(found.where(~decontam.contaminated(decontam.n_hit(), F.col("n_words"))), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each text and of the text decoded from them."""
    return token_digests(docs.select("doc_id", "lang", "source", "text"))


STAGES = [("language_id", language), ("ngram_jaccard", near_copies), ("suffix_dedup", repeats), ("decontamination", benchmarks), ("bpe", tokens)]
#: SQL can't express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
