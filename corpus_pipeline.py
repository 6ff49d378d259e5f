"""A corpus from raw documents to token ids: five stages, each written as Parquet and read by the next.

language ID -> exact dedup -> near-dedup -> mixing sources to target weights -> SentencePiece ids
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import checkpoint_dir, crc_mod
from sondera.llm.exact_dedup import drop_copies
from sondera.llm.language_id import UNKNOWN, identify, train
from sondera.llm.mixing import repeat_by_mix
from sondera.llm.near_text import drop_similar
from sondera.llm.sentencepiece_codec import encode

#: Documents whose language is less sure than this are rejected, with those that have none.
LEAST_LANGUAGE_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or no language that is at all sure."""
    model = train(docs.filter(crc_mod("doc_id", 5) != 0))
    found = identify(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text, the one with the largest id."""
    return drop_copies(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word Jaccard of 0.8), the one with the smallest id."""
    return drop_similar(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the mix takes, as often as it takes them."""
    return repeat_by_mix(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids."""
    return encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_pieces", "piece_ids")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]
#: SQL can express neither the model of the first stage nor the links of the third.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes to the shared folder and is read again."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
