"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All
but the last return the columns of ``documents``. Between stages the rows are written as
Parquet to the shared folder and read again, so a lost executor never costs a finished stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bpe, decontam, simhash, substring, toxicity
from memlake.llm.common import cleanup, free_names, materialise, table, written

#: A document with this score or more is rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.3 or more; null and empty texts stay.

    All columns stay, whatever their names; repeated rows share their fate; no rows in, no rows out.
    """
    (score,) = free_names(docs, "_score")
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id (without one: the last choice).

    Null and empty texts are copies of each other; of repeated rows one stays; all columns stay.
    """
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their words in passages of 35 words or more that stand elsewhere too.

    Where words go, the rest is joined by single spaces and n_chars counts it anew; other
    texts stay as they are, nulls too. No document goes; all other columns stay as they are.
    """
    text, *counts = free_names(docs, "_kept_text", "_n_words", "_n_removed", "_factors")
    kept = substring.deduplicate(docs, text, tuple(counts))
    cut = F.col(counts[1]) > 0
    new = kept.withColumn("text", F.when(cut, F.col(text)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of ten words of a benchmark item occurs.

    Null and empty texts stay; repeated rows share their fate; all columns stay, whatever their names.
    """
    id_, key = free_names(docs, "_id", "_key")
    hit = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document that is left."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL can express neither the learned scores nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = materialise(docs, f"stage-{name}")
            cleanup(spark, keep=[*before, path])  # the stage's own tables and its input
    return docs
