"""From documents to token ids: toxicity, near duplicates, secrets, mixing, encoding.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

- toxicity: documents at or above the threshold go. The model learns from ``labels`` of rows whose
  crc32(doc_id) mod 4 isn't 2, as in op7.
- jaccard: of each group of linked documents the one with the smallest doc_id stays; documents without words
  all stay. Rows repeated whole are one document.
- secrets: spans are replaced by a mark; n_chars follows the text.
- mixing: documents are repeated or left out as the mix of sources asks.
- sentencepiece: ids of each document's text.

Null texts pass all stages; a null doc_id or source is a value like any. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.jaccard import jaccard_components
from paperlake.llm.mixing import mix_sources, word_count
from paperlake.llm.scratch import materialise
from paperlake.llm.secrets import find_secrets
from paperlake.llm.sentencepiece import MODEL, encode_documents, read_model
from paperlake.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL can't express the learnt, hashed and encoded stages; tests compare them with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = fit_toxicity(docs, labels, where=known)
    return score_toxicity(docs, model, tuple(docs.columns), "_toxicity").filter(F.col("_toxicity") < THRESHOLD).drop("_toxicity")


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(docs)
    first = found.filter((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = docs.withColumn("_found", find_secrets(F.col("text"), redacted=True)["redacted"])
    length = F.when(F.col("_found").isNotNull(), F.length("_found").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns({"text": F.coalesce("_found", "text"), "n_chars": length}).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64("doc_id", "text")
    mixed = mix_sources(docs.select(key.alias("_key"), "source", word_count(F.col("text")).alias("size")), id_column="_key")
    copies = mixed.groupBy("_key").agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    joined = docs.withColumn("_key", key).join(copies, "_key")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_documents(docs, read_model(MODEL))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("secrets", secrets), ("mixing", mixing), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
