"""Orders, cuts and layers of the candidates of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.operators.scoring import PLAYERS_CAP

TOP, WATCH_MOST = 15, 10
#: The large companies, whose sales make a direction a trend.
BIG_PLAYERS = (
    "OpenAI", "Anthropic", "Google", "Google Cloud", "Google DeepMind", "DeepMind", "Alphabet", "Microsoft", "Azure", "Amazon", "AWS",
    "Amazon Web Services", "Meta", "Apple", "NVIDIA", "IBM", "Oracle", "Intel", "AMD", "Qualcomm", "Samsung", "Alibaba", "Tencent", "Baidu",
    "Huawei", "ByteDance", "Salesforce", "SAP", "Cisco", "Tesla", "Siemens", "Broadcom", "TSMC", "Visa", "Mastercard", "JPMorgan",
    "J.P. Morgan", "Goldman Sachs", "Pfizer", "Roche", "Novartis", "Johnson & Johnson", "Moderna", "BioNTech",
)
KINDS = ("too_broad", "noise", "hype", "standard", "mature", "emerging")


def top_order(confidence: str = "confidence", listed: Column | None = None) -> list[Column]:
    """Confidence, then backed, share, players, visibility, evidence and recent share; ties by key."""
    keys = [F.col(confidence).desc_nulls_last(), F.col("backed").desc()]
    if listed is not None:
        keys.append(F.coalesce(listed, F.lit(-1.0)).desc())
    return keys + [
        F.coalesce("query_share", F.lit(-1.0)).desc(), F.least("players", F.lit(PLAYERS_CAP)).desc(), F.col("low_visibility").desc(),
        F.col("evidence_share").desc(), F.col("recent_share").desc(), F.col("key").asc(),
    ]


def low_visibility(works: str, query: str = "query_id") -> Column:
    return F.col(works) <= F.median(works).over(W.partitionBy(query))


def top_n(rows: DataFrame, n: int | Column, order: list[Column], *by: str) -> DataFrame:
    """The first n of each group; n may be a column. With ``place``."""
    limit = F.lit(n) if isinstance(n, int) else n
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= limit)


def layer(companies: Column, leaders: Column, commercial: Column, pilot: Column, funding: Column, works: Column, patent_growth: Column, floor: Column, extra: dict[str, Column] | None = None) -> Column:
    """struct(layer, confirmations): trend, weak (two independent confirmations or more) or watch."""
    extra = extra or {}
    big = F.filter(companies, lambda c: F.lower(F.trim(c)).isin([b.lower() for b in BIG_PLAYERS]))
    market = F.size(companies) > F.size(big)
    zero = F.lit(0)
    paths = [
        works + extra.get("preprint", zero) >= 2,
        F.coalesce(patent_growth > floor, F.lit(False)),
        market | pilot | funding | (extra.get("yc", zero) > 0),
        extra.get("grants", zero) > 0,
        extra.get("trials", zero) > 0,
    ]
    n = sum((p.cast("int") for p in paths[1:]), paths[0].cast("int"))
    trend = leaders | ((F.size(big) > 0) & (2 * F.size(big) >= F.size(companies)) & commercial)
    return F.struct(F.when(trend, "trend").when(n >= 2, "weak").otherwise("watch").alias("layer"), n.alias("confirmations"))


def fill_top(ranked: DataFrame, top: int = TOP, watch: int = WATCH_MOST, query: str = "query_id") -> DataFrame:
    """``ranked`` (place, layer) with bucket: top (weak first, then the best of watch, marked filled), watch, beyond."""
    weak = F.col("layer") == "weak"
    by = W.partitionBy(query)
    n_weak = F.count_if(weak).over(by)
    of_layer = F.row_number().over(W.partitionBy(query, weak).orderBy("place"))
    need = F.greatest(F.lit(top) - n_weak, F.lit(0))
    out = ranked.withColumns({"_n": of_layer, "_need": need})
    bucket = F.when(weak & (F.col("_n") <= top), "top").when(weak, "beyond").when(F.col("_n") <= F.col("_need"), "top").when(F.col("_n") <= F.col("_need") + watch, "watch").otherwise("beyond")
    return out.withColumns({"bucket": bucket, "filled": ~weak & (bucket == "top")}).drop("_n", "_need")


def take_on_topic(ranked: DataFrame, n: int = TOP, least: int = 2, query: str = "query_id") -> DataFrame:
    """Walk in order and keep what passes until n are kept: ``state`` is kept, dropped or untested. No grade passes."""
    passes = F.coalesce(F.col("grade") >= least, F.lit(True))
    before = F.coalesce(F.sum(passes.cast("int")).over(W.partitionBy(query).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("state", F.when(before >= n, "untested").when(passes, "kept").otherwise("dropped"))


def evidence_stage(available: Column, piloted: Column, built: Column, has_ladder: Column, stage: Column, commercial: Column, pilot: Column) -> Column:
    """Stage 1 to 4 by the highest milestone read; rows without milestones keep their stage, raised by sales and pilots."""
    ladder = F.when(available, 4).when(piloted, 3).when(built, 2).otherwise(1)
    return F.when(has_ladder, ladder).otherwise(F.greatest(stage, F.when(commercial, 4).when(pilot, 3).otherwise(0)))


def parse_stage(text: Column) -> Column:
    """The latest of the named stages, 1 to 4, or null. The stems of their names."""
    low = F.lower(text)
    return F.nullif(
        F.greatest(
            F.when(low.rlike("концепц|исследован"), 1).otherwise(0), F.when(low.rlike("прототип|poc"), 2).otherwise(0),
            F.when(low.rlike("пилот"), 3).otherwise(0), F.when(low.rlike("раннее внедрен|раннего внедрен"), 4).otherwise(0),
        ), F.lit(0))


def parse_trend(text: Column) -> Column:
    """3 for a fast rise, 2 for a rise, else null."""
    low = F.trim(F.lower(text))
    return F.when(low.rlike("^раст[её]т быстро"), 3).when(low.rlike("^(раст[её]т|стабильный/раст[её]т)"), 2)


def excluded_why(kind: Column, readings: dict[str, Column]) -> Column:
    """Empty for what is shown; else the readings that speak against it."""
    seen = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in readings.items())))
    return F.when(kind == "emerging", "").when(F.size(seen) > 0, F.concat(F.lit("by: "), F.array_join(seen, "; "))).otherwise("no reason given")


def greedy_cover(rows: DataFrame, group: str, most: int = 3) -> DataFrame:
    """(group, n, adds): up to ``most`` rows (n, companies) of each group, each naming most companies not yet named.

    Groups are the few shown headlines of a candidate; cut them with ``top_n`` before.
    """
    import pandas as pd

    def cover(part: pd.DataFrame) -> pd.DataFrame:
        named: set[str] = set()
        out = []
        items = [(int(n), set(c)) for n, c in zip(part["n"], part["companies"])]
        for _ in range(most):
            n, own = max(items, key=lambda x: (len(x[1] - named), -x[0]), default=(None, set()))
            if n is None or not own - named:
                break
            out.append((part[group].iat[0], n, len(own - named)))
            named |= own
        return pd.DataFrame(out, columns=[group, "n", "adds"])

    return rows.groupBy(group).applyInPandas(cover, f"{group} string, n long, adds int")
