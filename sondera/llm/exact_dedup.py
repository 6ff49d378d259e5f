"""Exact dedup with a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by the text's digest. New documents are
reduced to one row per digest (the row with the largest id), anti-joined with the index by sort-merge, and what is
new is appended. The index side is never shuffled: its buckets are the join's partitions. A bucket to which several
batches were appended has several sorted files, and its task sorts it again for the join.

Only DataFrame and SQL functions run here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import ascii_lower, cut, table, with_hot_apart

#: Buckets of an index. Size them so that a bucket of digests fits a task: 64 for some 10^8 texts, 4096 for 10^10.
BUCKETS = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, row): the digest of each whole text, A-Z lower-cased; a null text counts as empty.

    ``row`` tells repeated rows apart, so that of two rows with one id and text just one is kept.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """A table (text_sha256, keep_id, keep_row, group_size, batch), bucketed and sorted by text_sha256."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, found: DataFrame, batch: str) -> None:
        """Add the digests of ``found`` (doc_id, text_sha256, row) that the index hasn't got."""
        best = found.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        new = best.select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", F.lit(batch).alias("batch"))
        if self.exists():
            new = new.hint("merge").join(self.read().select("text_sha256"), "text_sha256", "left_anti")
        writer = new.repartition(self.buckets, "text_sha256").write.format("parquet").mode("append")
        writer.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None, first: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row.

    ``keep_id`` is the document that stands for the text in the index; ``group_size`` counts the rows of its batch.
    Rows for which ``first`` holds are appended before the others, which then meet an index that has them. Of texts new
    to the index the row with the largest id stays. Nulls: a null text is empty, a null id is the smallest. An empty
    table gives no rows. Of repeated rows (equal id and text) one is kept. Texts are digested whole, however long. Other
    columns are not read. A text that holds a large part of the batch is looked up apart.
    """
    batch = batch or uuid.uuid4().hex
    found = cut(digests(docs))
    for part in [found] if first is None else [found.filter(F.coalesce(first, F.lit(False))), found.filter(~F.coalesce(first, F.lit(False)))]:
        index.append(part, batch)
    sizes = found.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    known = index.read().select("text_sha256", "keep_id", "keep_row", F.col("batch").alias("of_batch")).join(sizes, "text_sha256")
    joined = with_hot_apart(found, cut(known), "text_sha256", "group_size")
    kept = (F.col("of_batch") == batch) & (F.col("row") == F.col("keep_row"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with the columns of ``docs``.

    Only ids and digests are shuffled to find them. Where ids are unique the rows are then picked by id; else by id and
    digest, and of repeated rows one is picked.
    """
    found = cut(digests(docs))
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    index.append(found, "all")
    stays = cut(index.read().select("keep_id", F.col("text_sha256").alias("_keep_sha")))
    index.drop()
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        return docs.join(stays, F.col("doc_id") == F.col("keep_id"), "left_semi")
    keyed = docs.withColumn("_sha", F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    kept = keyed.join(stays, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_sha") == F.col("_keep_sha")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_sha"]).drop("_sha")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half of the documents with the larger ids makes the index, the other half is deduplicated against it and appended."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    found = cut(dedup(docs, index, first=F.col("doc_id") >= F.lit(middle)).drop("row"))
    index.drop()
    return found


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
