"""Sharding by best-fit-decreasing bin packing.

Documents of equal text form a group that no shard boundary may cut. Groups, from the largest down, enter the bin with
the least remaining capacity that still holds them, found in a balanced tree of remaining capacities; a new bin opens
where none does. ``pack`` thus fills as few bins of a fixed capacity as best fit decreasing can; ``near_equal`` looks
for the least capacity at which the groups need no more than a given number of bins.

Groups of one size are alike, so the packing needs their number by size only: documents are hashed to groups, groups
counted by size, and the packing says of each size how many go to which bin. Distinct sizes that add up to T bytes are
sqrt(2 T) at most (14 million for 100 TB), which bounds what the driver holds. Which groups of a size go where is then
decided on the cluster by their order of digest.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.llm.common import cut, table, with_hot_apart

SHARDS, SEED = 16, 13
#: Groups of one size are put in order within so many ranges of their digest.
RANGES = 1024
#: Keys in a leaf of the tree, at most twice as many.
LEAF = 512


class CapacityTree:
    """Ordered keys (remaining, bin) in leaves under one row of their largest keys; leaves split in halves."""

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []

    def _leaf(self, key: tuple[int, int]) -> int:
        return min(bisect_left(self.tops, key), len(self.leaves) - 1)

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        at = self._leaf(key)
        leaf = self.leaves[at]
        insort(leaf, key)
        if len(leaf) > 2 * LEAF:
            self.leaves[at : at + 1] = [leaf[:LEAF], leaf[LEAF:]]
            self.tops[at : at + 1] = [leaf[LEAF - 1], leaf[-1]]
        elif at < len(self.tops):
            self.tops[at] = leaf[-1]
        else:
            self.tops.append(leaf[-1])

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the key of the bin with the least remaining capacity that holds ``size``."""
        key = (size, -1)
        at = bisect_left(self.tops, key)
        if at == len(self.tops):
            return None
        leaf = self.leaves[at]
        found = leaf.pop(bisect_left(leaf, key))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.tops[at]
            if len(self.leaves) > 1:
                del self.leaves[at]
        return found


def pack(sizes: np.ndarray, counts: np.ndarray, capacity: int, most_bins: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """Best fit decreasing: runs (place in ``sizes``, bin, number of groups), and the number of bins.

    ``sizes`` fall and are distinct, none over ``capacity``. A bin that has taken a group stays the tightest for the
    next of that size while it has room, so groups of a size enter it together. Stops early, with the runs so far, once
    more than ``most_bins`` are needed.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for at, (size, left) in enumerate(zip(sizes.tolist(), counts.tolist())):
        while left:
            remaining, bin_ = tree.pop_tightest(size) or (capacity, bins)
            if bin_ == bins:
                bins += 1
                if most_bins is not None and bins > most_bins:
                    return runs, bins
            n = min(left, remaining // size)
            runs.append((at, bin_, n))
            left -= n
            tree.add(remaining - n * size, bin_)
    return runs, bins


def near_equal(sizes: np.ndarray, counts: np.ndarray, bins: int) -> list[tuple[int, int, int]]:
    """Runs as of ``pack`` that fill ``bins`` bins near equally.

    A group larger than an even share of what is left has a bin of its own. The others are packed at the least
    capacity, an even share and a slack of 0, 1, 2, 4 ..., that needs no more than the bins left.
    """
    order = np.argsort(-sizes, kind="stable")
    sizes, counts = sizes[order], counts[order].copy()
    runs, total, at = [], int((sizes * counts).sum()), 0
    while bins > 1 and at < len(sizes) and sizes[at] * bins > total:  # no share holds it
        bins, total = bins - 1, total - int(sizes[at])
        runs.append((at, bins, 1))
        counts[at] -= 1
        at += counts[at] == 0
    slack, share = 0, -(-total // bins)
    while at < len(sizes):
        capacity = max(share + slack, int(sizes[at]))
        packed, needed = pack(sizes[at:], counts[at:], capacity, bins)
        if needed <= bins:
            runs += [(at + i, b, n) for i, b, n in packed]
            break
        slack = max(1, 2 * slack)
    return [(int(order[i]), b, n) for i, b, n in runs]


def _places(groups: DataFrame, hot: DataFrame) -> DataFrame:
    """``groups`` whose ``bytes`` are in ``hot``, with ``place``: from 0 within the bytes by order of the digest.

    Counts of digest ranges come first, so that no size is one task.
    """
    part = F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") * RANGES / 65536
    own = groups.join(hot, "bytes", "left_semi").withColumn("part", F.floor(part).cast("int"))
    parts = own.groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("bytes", "part", (F.sum("n").over(W.partitionBy("bytes").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("bytes", "part").orderBy("digest")) - 1
    return own.withColumn("within", within).join(parts, ["bytes", "part"]).withColumn("place", F.col("before") + F.col("within")).drop("part", "within", "before")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, digest, row: each document's shard; equal texts share one."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row")))
    groups = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    by_size = cut(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("groups")))
    known = by_size.orderBy("bytes").toPandas()  # distinct sizes: at most sqrt(2 x all bytes)
    sizes = known["bytes"].to_numpy(np.int64)
    runs = pd.DataFrame(near_equal(sizes, known["groups"].to_numpy(np.int64), shards), columns=["at", "shard", "n"], dtype="int64")
    runs["bytes"] = sizes[runs["at"].to_numpy(np.int64)]
    runs["upto"] = runs.groupby("at")["n"].cumsum()
    runs = spark.createDataFrame(pa.table({c: pa.array(runs[c].to_numpy(np.int64), pa.int64()) for c in ("bytes", "shard", "upto")}))
    ways = F.array_sort(F.collect_list(F.struct("upto", F.col("shard").cast("int").alias("shard"))))  # one for each bin at most
    runs = cut(runs.groupBy("bytes").agg(ways.alias("ways"), F.count(F.lit(1)).alias("n_ways")).join(by_size, "bytes"))
    whole = runs.filter("n_ways = 1").select("bytes", F.col("ways")[0]["shard"].alias("shard"), "groups")
    split = runs.filter("n_ways > 1")
    alone = with_hot_apart(groups, whole, "bytes", "groups").filter("shard is not null").select("digest", "n", "shard")
    placed = _places(groups, split.select("bytes"))
    way = F.filter("ways", lambda w: w["upto"] > F.col("place"))[0]["shard"]
    parted = with_hot_apart(placed, split.select("bytes", "ways", "groups"), "bytes", "groups").select("digest", "n", way.alias("shard"))
    of_digest = cut(alone.unionByName(parted))
    return with_hot_apart(rows, of_digest, "digest", "n").select("doc_id", "size", "text_crc32", "shard", "digest", "row")


def slotted(rows: DataFrame, columns: list[str], seed: int = SEED) -> DataFrame:
    """``columns`` of ``rows`` (shard, doc_id, digest, row) and ``slot``: gapless from 0 in each shard, in a seeded order.

    Rows are put in order over all tasks; each task counts its rows by shard, and the sums of the tasks before it are
    where its slots begin. Equal rows are told apart by ``row``, so that no task gets all of many. Reruns agree.
    """
    order = ["_draw", "doc_id", "digest", "row"]
    keyed = rows.withColumn("_draw", F.xxhash64("doc_id", F.lit(seed)))
    ordered = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns))
    numbered = ordered.withColumn("task", F.spark_partition_id())
    counts = numbered.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.select("task", "shard", (F.sum("n").over(W.partitionBy("shard").orderBy("task")) - F.col("n")).alias("begins"))
    known: dict[int, dict[int, int]] = {}
    for task, shard, at in begins.collect():  # tasks x shards
        known.setdefault(task, {})[shard] = at
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def number(batches):
        from pyspark import TaskContext

        at = dict(shared.value.get(TaskContext.get().partitionId(), {}))
        for batch in batches:
            shard = batch["shard"].to_numpy(zero_copy_only=False)
            slot = np.zeros(len(shard), np.int64)
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                slot[own] = at[int(s)] + np.arange(len(own))
                at[int(s)] += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], names=[*batch.schema.names, "slot"])

    kinds = dict(ordered.dtypes)
    return ordered.mapInArrow(number, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", slot long")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``, by the law of near equal bytes.

    Equal texts share a shard; a null text counts as empty. Repeated rows each have a slot. Shards differ by a few
    bytes where the groups allow; a group above an even share has a shard of its own. An empty table gives no rows, and
    fewer groups than shards leave shards empty. Texts of any length count whole. Other columns are not read. Of groups
    of one size, lesser digests go to the bins filled first, so reruns agree.
    """
    placed = slotted(assign(docs, shards), ["doc_id", "size", "text_crc32", "shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def fewest_shards(groups: DataFrame, capacity: int) -> DataFrame:
    """(bytes, shard, groups): how many groups of each size of ``groups`` (bytes) go to which of the fewest shards of ``capacity``.

    A group above the capacity is an error: it can be in no shard.
    """
    known = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).toPandas()
    sizes, counts = known["bytes"].to_numpy(np.int64), known["n"].to_numpy(np.int64)
    if len(sizes) and sizes[0] > capacity:
        raise ValueError(f"a group of {sizes[0]} bytes does not fit a shard of {capacity}")
    runs, _ = pack(sizes, counts, capacity)
    return groups.sparkSession.createDataFrame([(int(sizes[i]), b, n) for i, b, n in runs], "bytes long, shard int, groups long")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
