"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.lineage import checkpoint_dir, cut

__all__ = ["ascii_lower", "checkpoint_dir", "crc_mod", "cut", "table", "with_hot_apart"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z and nothing else. ``lower`` is the same and faster where all characters are ASCII."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``: the fold that the contracts name."""
    return F.crc32(F.col(column).cast("string")) % divisor


def with_hot_apart(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` left join ``groups`` on ``key`` (unique in ``groups``), safe for keys that hold a large part of the rows.

    A key with more than 1/``share`` of the rows is looked up in a broadcast of such keys, of which there can be
    ``share`` at most; its rows take no part in the shuffle on the key. ``size`` names the column of ``groups`` that
    holds the number of rows of a key. A null key matches nothing.
    """
    other = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > total / share).select(F.col(key).alias("_hot_key"), F.struct(*other).alias("_hot"))
    cold = groups.filter(F.col(size) <= total / share).select(F.col(key).alias("_cold_key"), F.struct(*other).alias("_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    return _union_sides(marked, cold, key, other)


def _union_sides(marked: DataFrame, cold: DataFrame, key: str, other: list[str]) -> DataFrame:
    keep = [c for c in marked.columns if not c.startswith("_hot")]
    is_hot = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    found = marked.filter(is_hot).select(*keep, *(F.col("_hot")[c].alias(c) for c in other))
    rest = marked.filter(~is_hot).join(cold, F.col(key) == F.col("_cold_key"), "left")
    return found.unionByName(rest.select(*keep, *(F.col("_cold")[c].alias(c) for c in other)))
