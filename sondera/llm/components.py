"""Connected components of a graph that is spread over the cluster.

Rounds of two steps, each one aggregation and one join: in the first, every node links its larger neighbours to the
smallest node that it knows; in the second, its smaller ones. After a logarithmic number of rounds what is left is a
star around the smallest node of each component. Links stay distributed; each round is cut from its lineage by a
checkpoint; the driver sees only a count, a checksum and the most links of a node. Once that is over a million, nodes
with very many links (1,000 at most) are looked up in a broadcast, so that their links do not come together in one task.

Before the rounds each task reduces the links that it holds, a bounded number, to stars of its own. A graph of no more
links than one task may hold is done with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import cut, with_hot_apart


#: From so many links of one node on, such nodes are joined apart.
MANY_LINKS = 1 << 20
#: Links that a task reduces at a time.
LOCAL_LINKS = 1 << 18


def components(links: DataFrame, many: int = MANY_LINKS, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b), the smallest node that it reaches. No links: no rows."""
    edges = cut(_tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    tasks = -(-edges.count() // local)
    edges = cut(edges.coalesce(max(1, tasks)).mapInPandas(_local_stars, "a long, b long"))
    if tasks > 1:
        edges = _in_rounds(edges, many)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _local_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, smallest node that it reaches) over the links of a task."""
    held = list(batches)
    if not held or not sum(map(len, held)):
        return
    edges = pd.concat(held)
    ids, at = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    u, v = at[: len(edges)], at[len(edges) :]
    least = np.arange(len(ids))
    while (least[u] != least[v]).any():
        both = np.minimum(least[u], least[v])
        np.minimum.at(least, least[u], both)
        np.minimum.at(least, least[v], both)
        while (least[least] != least).any():
            least = least[least]
    linked = np.flatnonzero(least != np.arange(len(ids)))
    yield pd.DataFrame({"a": ids[linked], "b": ids[least[linked]]})


def _in_rounds(edges: DataFrame, many: int) -> DataFrame:
    seen, most = _mark(edges)
    while seen[0]:
        edges = cut(_small_star(_large_star(edges, most > many), most > many))
        now, most = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select("a", "b").distinct()


def _mark(edges: DataFrame) -> tuple[tuple, int]:
    """(count and checksum of the edges, most links of a node on either side)."""
    sides = edges.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("u")), F.struct(F.lit(1).alias("side"), F.col("b").alias("u")))).alias("e"), F.xxhash64("a", "b").cast("decimal(20,0)").alias("h"))
    by_node = sides.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    n, h, most = by_node.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return (n or 0, h), most or 0


def _met(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of u."""
    return with_hot_apart(edges, least, "u", "links") if many else edges.join(least, "u")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Every node u links each neighbour above u to the smallest of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("links"))
    return _tidy(_met(both.filter("v > u"), least, many).select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Every node u links itself and its neighbours below u to the smallest of them."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links"))
    linked = _met(down, least, many).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _tidy(linked.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
