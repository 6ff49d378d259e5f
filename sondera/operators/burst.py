"""Bursts: phrases whose share of titles rose, by log-odds with a Dirichlet prior."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.functions.text import phrases, title_of

#: Window lengths in days, the least count, the least rise of the share, and the strength of the prior.
RECENT_DAYS, BEFORE_DAYS, MIN_RECENT, MIN_GROWTH, ALPHA = 365, 730, 5, 2.0, 0.01


def counts(works: DataFrame, as_of: str) -> DataFrame:
    """(phrase, recent, before) of arXiv titles: once per title, in the last year and in the two before it."""
    at, day = F.lit(as_of).cast("date"), F.col("observed_at")
    mid = F.date_sub(at, RECENT_DAYS)
    held = works.filter((F.col("source") == "arxiv") & ~F.col("junk") & (day <= at) & (day >= F.date_sub(mid, BEFORE_DAYS)))
    each = held.select((day >= mid).alias("is_recent"), F.explode(phrases(title_of("term_raw"))).alias("phrase"))
    return each.groupBy("phrase").agg(F.count_if("is_recent").alias("recent"), F.count_if(~F.col("is_recent")).alias("before"))


def totals(works: DataFrame, as_of: str) -> DataFrame:
    """(n_recent, n_before): titles of the two windows."""
    at, day = F.lit(as_of).cast("date"), F.col("observed_at")
    mid = F.date_sub(at, RECENT_DAYS)
    held = works.filter((F.col("source") == "arxiv") & ~F.col("junk") & (day <= at) & (day >= F.date_sub(mid, BEFORE_DAYS)))
    return held.agg(F.count_if(day >= mid).alias("n_recent"), F.count_if(day < mid).alias("n_before"))


def score(found: DataFrame, titles: DataFrame, min_recent: int = MIN_RECENT) -> DataFrame:
    """``found`` (phrase, recent, before) that rose enough, with z. Sums are over the whole vocabulary of the windows."""
    sums = found.agg(F.sum("recent").alias("a_r"), F.sum("before").alias("a_b"))
    r, b = F.col("recent").cast("double"), F.col("before").cast("double")
    both = found.filter(F.col("recent") >= min_recent).crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(titles))
    rose = r / F.greatest("n_recent", F.lit(1)) >= MIN_GROWTH * ((b + 1) / F.greatest("n_before", F.lit(1)))
    prior, a0 = ALPHA * (r + b), ALPHA * (F.col("a_r") + F.col("a_b"))
    delta = F.log((r + prior) / (F.col("a_r") + a0 - r - prior)) - F.log((b + prior) / (F.col("a_b") + a0 - b - prior))
    z = delta / F.sqrt(1 / (r + prior) + 1 / (b + prior))
    return both.filter(rose).select("phrase", "recent", "before", z.alias("z"))


def distinct_phrases(ranked: DataFrame, n: int = 6, group: str = "query_id") -> DataFrame:
    """The first ``n`` of each group by z, leaving out phrases whose words are a part of a taken one's, or the reverse.

    A greedy choice looks at few rows: ``ranked`` must hold the best of each group only.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[set[str]] = []
        keep = []
        for i, phrase in rows.sort_values(["z", "phrase"], ascending=[False, True])["phrase"].items():
            words = set(phrase.split())
            if not any(words <= w or w <= words for w in taken):
                taken.append(words)
                keep.append(i)
            if len(taken) == n:
                break
        return rows.loc[keep]

    return ranked.groupBy(group).applyInPandas(choose, ranked.schema)
