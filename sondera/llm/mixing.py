"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a budget in words. A document is taken a whole number of times, at most three. Of a budget, the
full rounds (every document of the source once) come first. For the rest the source's documents are counted by exact
length, each length gets its even share of the rest, and what rounding leaves open is closed by a bounded-knapsack
dynamic program over the lengths. Then as many documents of each length as the plan says are selected, by a seeded
hash of their id.

Only counts by (source, length) come together in a task, never documents. Where one (source, length) holds a large
part of all documents its selection is split by hash range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.llm.common import cut, table

#: Sources in order of their names have these weights in turn; no target exceeds so many times a source.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
SEED = 20
#: Fixed value: a word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The dynamic program closes a gap of up to so many words; larger gaps are first narrowed by whole documents.
KNAPSACK_WORDS = 1 << 17
#: A (source, length) with over 1/HOT_SHARE of the documents is selected in HOT_PARTS hash ranges.
HOT_SHARE, HOT_PARTS = 10_000, 1024


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size counts the words ``[^\\x20\\x09-\\x0D]+`` of the whole text; null has none."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", words.cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size); null is a source like any other, the last.

    The words of all sources are shared by weight; a target stops at ``most`` times its source and what is over is
    shared again by weight, until none is above. Each round is one small aggregate over the sources.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    own = cut(own.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int"))))
    total = own.agg(F.sum("source_size")).first()[0] or 0
    cap, level, before = F.col("source_size") * float(most), None, None
    while level is None or level != before:
        before = level
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        capped, open_weight = own.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        level = (total - (capped or 0.0)) / open_weight if open_weight else before
        if not open_weight:
            break
    return own.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(float(level or 0.0))).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near ``budget`` as can be found.

    ``sizes`` are distinct and above zero. Even shares first; then whole documents from the longest down; the last
    gap by a bounded knapsack, in which up to one more, or one fewer, share of each length may be exchanged.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = counts * budget // total
    gap = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    while gap > KNAPSACK_WORDS:  # every length is short of its even share by less than one document
        before = gap
        for i in order:
            if take[i] < counts[i] and sizes[i] <= gap - KNAPSACK_WORDS // 2:
                take[i] += 1
                gap -= int(sizes[i])
        if gap == before:
            break
    if gap <= 0:
        return take
    limit = min(gap, KNAPSACK_WORDS)
    best, steps = _knapsack(sizes, counts - take, limit)
    for i, n in steps(best):
        take[i] += n
    left = gap - best
    fits = [i for i in order if take[i] < counts[i] and 0 < sizes[i] < 2 * left]  # one more goes over, but lands nearer
    if fits:
        nearest = min(fits, key=lambda i: (abs(int(sizes[i]) - left), int(sizes[i])))
        take[nearest] += 1
    return take


def _knapsack(sizes: np.ndarray, room: np.ndarray, limit: int):
    """The largest sum up to ``limit`` of lengths, each used ``room`` times at most, and a function that traces it."""
    first = np.full(limit + 1, -1, np.int64)  # the item that first reached a sum
    used = np.zeros(limit + 1, np.int64)
    reached = np.zeros(limit + 1, bool)
    reached[0] = True
    for i in np.argsort(-sizes, kind="stable"):
        s, n = int(sizes[i]), int(min(room[i], limit // max(1, int(sizes[i]))))
        if s > limit or n <= 0:
            continue
        frontier, k = np.flatnonzero(reached), 0
        while k < n and len(frontier):
            k += 1
            nxt = frontier + s
            nxt = nxt[nxt <= limit]
            nxt = nxt[~reached[nxt]]
            reached[nxt], first[nxt], used[nxt] = True, i, k
            frontier = nxt
        if reached[limit]:
            break
    best = int(np.flatnonzero(reached)[-1])

    def steps(at: int):
        while at:
            i, k = int(first[at]), int(used[at])
            yield i, k
            at -= k * int(sizes[i])

    return best, steps


def plan(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, rounds, extra): times that every document is taken, and how many are taken once more.

    ``counts`` is (source, size, n), with sizes above zero. A task gets the counts of whole sources.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        target, of_source = float(group["target"].iat[0]), int(group["source_size"].iat[0])
        budget = int(round(target))
        rounds = min(budget // of_source, MOST_REPEATS)
        extra = fit_budget(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), budget - rounds * of_source) if rounds < MOST_REPEATS else 0
        return pd.DataFrame({"source": group["source"], "size": group["size"], "rounds": rounds, "extra": extra})

    with_goal = counts.join(goals, counts["source"].eqNullSafe(goals["source"])).select(counts["source"], "size", "n", "source_size", "target")
    return with_goal.groupBy("source").applyInPandas(fit, "source string, size long, rounds long, extra long")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies x size).

    Nulls: a null text has size 0, a null source is a source of its own, the last. Documents without words are never
    taken (0 copies). Repeated rows count and are selected singly. An empty table gives no rows. Reruns agree: the
    selection hangs on doc_id, source, size and ``seed`` alone. Other columns are not read.
    """
    own = cut(sized(docs).withColumn("draw", F.xxhash64("doc_id", F.lit(seed))))
    counts = cut(own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = cut(targets(counts.select("source", (F.col("size") * F.col("n")).alias("size"))))
    planned = cut(plan(counts.filter("size > 0"), goals).join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(1000, total / HOT_SHARE)).select(F.col("source").alias("_hs"), F.col("size").alias("_hz"), F.lit(True).alias("_hot"))
    split = own.join(F.broadcast(hot), F.col("source").eqNullSafe(F.col("_hs")) & (F.col("size") == F.col("_hz")), "left")
    part = F.when(F.col("_hot"), F.shiftrightunsigned("draw", 64 - HOT_PARTS.bit_length() + 1).cast("int")).otherwise(F.lit(0))
    split = split.select("doc_id", "source", "size", "draw", part.alias("part"))
    # (source, size, part): documents in the parts before
    parts = split.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("source", "size").orderBy("part")) - F.col("n")
    known = parts.withColumn("before", before).join(planned.withColumnsRenamed({"source": "_s", "size": "_z"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    known = known.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("part").alias("_p"), "before", "rounds", "extra")
    place = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("draw", "doc_id"))
    ranked = split.withColumn("place", place).join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("part") == F.col("_p")))
    copies = F.coalesce(F.col("rounds") + (F.col("before") + F.col("place") <= F.col("extra")).cast("long"), F.lit(0))
    out = ranked.select("doc_id", "source", "size", copies.alias("copies"))
    out = out.join(F.broadcast(goals.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s") if _few(goals) else out.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _few(goals: DataFrame, most: int = 10_000) -> bool:
    """Whether so few sources are there that a row for each may be broadcast."""
    return goals.limit(most + 1).count() <= most


def repeat_by_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; the columns of ``docs``.

    Rows of one doc_id are told apart by source and size, and those alike in both in the order of their texts: so just
    the words that the mix has planned are written, also where ids repeat.
    """
    alike = ["doc_id", "source", "size"]
    place = F.row_number().over(W.partitionBy(*alike).orderBy(F.desc("copies")))
    taken = cut(mix(docs, seed).select(*alike, "copies"))
    repeated = cut(taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id")))
    again = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    once = taken.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    out = docs.join(once, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_n", again).select(*docs.columns)
    if repeated.isEmpty():
        return out
    several = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumn("_size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    several = several.withColumn("_place", F.row_number().over(W.partitionBy("doc_id", "source", "_size").orderBy("text")))
    ranked = taken.withColumn("place", place).filter("copies > 0").select(*(F.col(c).alias(f"_t_{c}") for c in [*alike, "place"]), F.col("copies").alias("_copies"))
    same = [F.col(a).eqNullSafe(F.col(f"_t_{b}")) for a, b in (("doc_id", "doc_id"), ("source", "source"), ("_size", "size"), ("_place", "place"))]
    return out.unionAll(several.join(ranked, same).withColumn("_n", again).select(*docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
