"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text: each task adds up a (language, bucket) matrix of its rows, and
only these matrices are shuffled. The log-probability matrix (languages x buckets, floats) is broadcast; its size is
bounded: many languages have fewer buckets. Scoring hashes all n-grams of a text with numpy, block by block, and adds up
the rows of the matrix that they name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import crc_mod, table

ORDERS, BUCKET_BITS, SMOOTHING = (1, 2, 3), 16, 0.1
#: The broadcast matrix has this many bytes at most: where there are many languages, buckets are halved until it fits.
MODEL_BYTES, LEAST_BITS = 64 << 20, 8
#: Characters hashed at a time: bounds a task's memory whatever the length of a text.
BLOCK = 1 << 18
#: Evidence of so many n-grams is counted in full; of longer texts the mean is taken, so that scores stay comparable.
EVIDENCE = 64.0
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(text: str, bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, block by block."""
    cp = code_points(f" {text} ")
    shift = np.uint32(32 - bits)
    for at in range(0, len(cp), BLOCK):
        part = cp[at : at + BLOCK + max(ORDERS) - 1]
        own, h, found = min(BLOCK, len(cp) - at), np.zeros(len(part), np.uint32), []
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(part) - n + 1] * np.uint32(31) + part[n - 1 :]) * _MIX + np.uint32(n)
            if n in ORDERS:
                found.append((h[:own] * _MIX >> shift).astype(np.intp))
        yield np.concatenate(found)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (buckets, languages), float32
    prior: np.ndarray
    bits: int = BUCKET_BITS

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, probability); a null text and one without a letter is ``und`` with 0."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for ids in blocks(text, self.bits):
            total += self.log_prob[ids].sum(0, dtype=np.float64)
            n += len(ids)
        total *= min(1.0, EVIDENCE / n)
        total += self.prior
        p = np.exp(total - total.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def bits_for(languages: int) -> int:
    """Bits of a bucket number such that the matrix keeps to its bound. Up to 256 languages it is all of them."""
    bits = BUCKET_BITS
    while languages * (4 << bits) > MODEL_BYTES and bits > LEAST_BITS:
        bits -= 1
    return bits


def train(docs: DataFrame) -> Model:
    """Fit on all rows of ``docs`` (text, lang) where both are given. No such rows: a model that says ``und``.

    Over ``MODEL_BYTES >> (LEAST_BITS + 2)`` (65,536) different languages are an error: the column holds something else.
    """
    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    most = MODEL_BYTES >> (LEAST_BITS + 2)
    languages = sorted(r[0] for r in known.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"over {most} languages")
    bits = bits_for(len(languages))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << bits, np.int64)
                for ids in blocks(text, bits):
                    sums[lang] += np.bincount(ids, minlength=1 << bits)
                rows[lang] = rows.get(lang, 0) + 1
        for lang, own in sums.items():
            has = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(has, -1), "n": np.append(own[has], rows[lang])})

    counted = known.mapInPandas(count, "lang string, bucket long, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    at = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.intp)
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    is_gram = bucket >= 0
    grams = np.full((1 << bits, len(languages)), SMOOTHING)
    grams[bucket[is_gram], at[is_gram]] += n[is_gram]
    rows = np.zeros(len(languages))
    rows[at[~is_gram]] = n[~is_gram]
    with np.errstate(divide="ignore"):
        return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), np.log(rows / max(rows.sum(), 1)), bits)


def predictor(spark: SparkSession, model: Model) -> Column:
    """A column function: struct(lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [shared.value.score(t) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return of


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score. Equal texts get equal answers; of languages that tie the first by name wins."""
    with_it = docs.withColumn("_found", predictor(docs.sparkSession, model)("text"))
    return with_it.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
