"""A corpus from documents: language, near-duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's
docs. All but the last return the columns of documents, and work on all that the stage before them kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, langid, mixing, neardup, pii
from siftline.llm.common import shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Near-duplicates have a similarity of 0.8 or more; two sets at 0.8 agree on fewer than 19 of 40 coordinates with a chance of 1.1e-6.
PERCENT, MATCHES = 80, 19


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language (null texts and texts without a letter); the language found becomes lang."""
    found = langid.predict(docs, langid.train(docs), lang_col="lang_pred", score_col="lang_score").filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return neardup.keep_first(docs, percent=PERCENT, matches=MATCHES)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, replaced in the texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their target shares, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether they decode to it."""
    coded = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("byte-level BPE", tokens),
]

#: Character n-gram kernels and min-hashes aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/siftline-stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
