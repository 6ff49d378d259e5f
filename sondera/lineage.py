"""How tables lie on the cluster: lineage cut in a place that all executors share, small inputs dealt out."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on a single machine where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty() and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, with no lineage before it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` in columns in the shared checkpoint folder, until the block ends: a third of what ``cut`` writes for narrow rows."""
    spark, folder = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        df.write.option("compression", "zstd").parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: it changes when the table does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)]
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores is dealt out to all of them; others stay as they are read.

    For work that is dear by the row, as on long texts: a small file is one split, a large table has enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df``, to be broadcast in a join if it is counted to have few rows; else an ordinary side of it.

    For rows of bounded width that are cheap to count, such as a table that has just been cut.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def held(df: DataFrame, most_rows: int = 100_000) -> tuple[DataFrame, list | None]:
    """``df`` computed once: with its rows, to be broadcast, if they are few; else cut, and nothing.

    For rows of bounded width. Few rows are fetched in the one job that counts them and cost no file.
    """
    rows = df.limit(most_rows + 1).toArrow()
    if rows.num_rows > most_rows:
        return cut(df), None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows.to_pylist()
