"""Works: content-addressed ids, idempotent appends, versions, backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.lineage import exists


def work_id(source: Column, external_id: Column, metric: Column, observed_at: Column) -> Column:
    """The id of a work from its natural key: the later half of an md5, little-endian, without its lowest bit."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), observed_at).cast("string")
    tail = F.substring(F.md5(F.concat_ws("\x1f", source, external_id, metric, micros)), 17, 16)
    turned = F.concat(*(F.substring(tail, i, 2) for i in range(15, 0, -2)))
    return F.shiftrightunsigned(F.conv(turned, 16, -10).cast("long"), 1)


def first_per_id(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def to_insert(batch: DataFrame, stored: DataFrame, key: str = "id", *order: Column) -> DataFrame:
    """Rows of a batch to append: one for each id, and none whose id is stored."""
    return first_per_id(batch, key, *order).join(stored.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows with the new one where both have a key; empty values are written too."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_at")))).filter("_n = 1").drop("_n", "_at")


def versions(rows: DataFrame, url: str = "url", key: str = "id") -> DataFrame:
    """``rows`` with base (the url without its version) and keep: the lowest version of a base, then the lowest id."""
    base = F.regexp_replace(url, r"v\d+$", "")
    ver = F.coalesce(F.nullif(F.regexp_extract(url, r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return rows.withColumn("base", base).withColumn("keep", F.row_number().over(W.partitionBy("base").orderBy(ver, key)) == 1)


def untagged(works: DataFrame, mentions: DataFrame, model: str, since: str | None = None) -> DataFrame:
    """Works with content that this model has not annotated, newest first."""
    own = mentions.filter(F.col("model") == model).select(F.col("signal_id").alias("id"))
    left = works.filter(~F.col("junk")).join(own, "id", "left_anti")
    return (left if since is None else left.filter(F.col("observed_at") >= F.lit(since).cast("date"))).orderBy(F.desc("observed_at"), F.desc("id"))


def backlog(works: DataFrame, vectors: DataFrame, limit: int, chars: int = 1500) -> DataFrame:
    """The newest works without a vector, their text cut for embedding."""
    left = works.join(vectors.select("id"), "id", "left_anti").orderBy(F.desc("observed_at"), F.desc("id")).limit(limit)
    return left.select("id", "observed_at", F.substring("term_raw", 1, chars).alias("text"))


def page(works: DataFrame, mark: tuple[str, int], size: int) -> DataFrame:
    """Keyset page: works before (observed_at, id), newest first."""
    day, key = F.lit(mark[0]).cast("date"), F.lit(mark[1])
    before = (F.col("observed_at") < day) | ((F.col("observed_at") == day) & (F.col("id") < key))
    return works.filter(before).orderBy(F.desc("observed_at"), F.desc("id")).limit(size)


def sample(works: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A seeded choice of n works that does not hang on partitions."""
    return works.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def model_guard(vectors: DataFrame, model: str, size: int) -> DataFrame:
    """``vectors``, failing the job on a row of another model or length: two models' vectors never mix."""
    ok = (F.col("model") == model) & (F.size("v") == size)
    return vectors.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("vector of another model or length")).isNull()))


#: Sources whose records are works.
SCIENCE = ("arxiv", "openalex")


def from_signals(signals: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    """Works to append from collected signals (id, source, url): science sources only, one version of each, none stored."""
    own = versions(signals.filter(F.col("source").isin(*SCIENCE)), url).filter("keep")
    return own.join(versions(stored, url).select("base").distinct(), "base", "left_anti").drop("base", "keep")


def jdbc(spark, address: str, name: str, key: str, chunks: int = 32, low: int = 0, high: int = 2**63 - 1, **options: str) -> DataFrame:
    """A table of a database, read in ``chunks`` equal ranges of its key between ``low`` and ``high``.

    A content-addressed key fills [0, 2^63), so the ranges hold like numbers of rows.
    """
    ranges = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(chunks)}
    return spark.read.format("jdbc").options(url=address, dbtable=name, **ranges, **options).load()


def copy_ranges(spark, address: str, name: str, key: str, path: str, ranges: int = 4, chunks: int = 32, high: int = 2**63 - 1, **options: str) -> list[tuple[int, int]]:
    """Copy a table of a database to Parquet at ``path`` by ranges of its key; gives (range, rows) of those now copied.

    Each range is a folder of its own, counted when it is written; a range that has been written whole is not read
    again, so a copy that broke off goes on with the range it was in. Fails where a range that is there no longer holds
    as many rows as the database: then the target is no copy broken off.
    """
    step, done = -(-(high + 1) // ranges), []
    for i in range(ranges):
        low, top = i * step, min(high, (i + 1) * step - 1)
        source = jdbc(spark, address, name, key, chunks, low, top, **options).filter(F.col(key).between(low, top))  # the database filters
        folder = f"{path}/range={i}"
        if exists(spark, f"{folder}/_SUCCESS"):
            want, have = source.count(), spark.read.parquet(folder).count()
            if want != have:
                raise ValueError(f"range {i}: the source has {want} rows and the target {have}")
            continue
        source.write.mode("overwrite").parquet(folder)
        done.append((i, spark.read.parquet(folder).count()))
    return done


def to_copy(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``source`` that a copy broken off has still to bring: those above the largest key of ``target``.

    Fails where the two hold a different number of rows up to that key: then the target isn't a copy broken off.
    """
    last, have = target.agg(F.max(key), F.count(F.lit(1))).first()
    if last is None:
        return source
    want = source.filter(F.col(key) <= last).count()
    if want != have:
        raise ValueError(f"up to {key} {last} the source has {want} rows and the target {have}")
    return source.filter(F.col(key) > last)


def write_features(rows: DataFrame, path: str, key: str, vector: str | None = None) -> None:
    """One row for each item with all its features; an empty text is null. Vectors, if any, stay an array column."""
    kinds = dict(rows.dtypes)
    cols = [F.nullif(F.col(c), F.lit("")).alias(c) if kinds[c] == "string" and c != key else F.col(c) for c in rows.columns if c != vector]
    rows.select(*cols, *([vector] if vector else [])).write.mode("overwrite").parquet(path)
