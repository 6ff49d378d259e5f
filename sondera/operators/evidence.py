"""The row of features of a candidate: its papers, its news, and its footprints in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions.money import is_funding
from sondera.functions.trust import domain_of, with_trust

#: Days that count as recent; the kind of source that papers add.
RECENT_DAYS, SCIENCE = 365, "science"


def _share(p: str) -> Column:
    return F.when(F.col(f"{p}_works") > 0, F.col(f"{p}_last_year_works") / F.col(f"{p}_works"))


def candidate_features(labels: DataFrame, papers: DataFrame, news: DataFrame, core: DataFrame, whole: DataFrame, today: str) -> DataFrame:
    """``labels`` (label) with twenty features as of ``today``.

    ``papers`` (label, score, day) and ``news`` (label, title, url, publisher, published) are what was found; ``core`` and
    ``whole`` (label, works, first_year, last_year_works) are footprints of the label's core and of all its words. A label
    without a row in ``core`` was not measured: core_unseen is null then, 1 if it has no works, else 0. What can't be
    measured is null; recent_share of no dates is 0. Evidence is one aggregate a side, with partial sums before the shuffle.
    """
    at = F.lit(today).cast("date")
    age = F.datediff(at, "day")
    recent = F.count_if(age <= RECENT_DAYS)
    of_papers = papers.groupBy("label").agg(
        F.count(F.lit(1)).alias("papers_found"), F.max("score").alias("cos_max"), F.avg("score").alias("cos_mean"), F.max(age).alias("paper_first_age_days"),
        F.count("day").alias("_p_dated"), recent.alias("_p_recent"),
    )
    publisher = F.coalesce(F.nullif("publisher", F.lit("")), F.nullif(domain_of("url"), F.lit("")))
    of_news = with_trust(news.withColumn("day", F.col("published"))).groupBy("label").agg(
        F.count(F.lit(1)).alias("news_found"), F.countDistinct(publisher).alias("publishers_distinct"), F.collect_set("kind").alias("_kinds"),
        F.count_if(F.col("level") == "high").alias("trust_high_count"), (F.count_if(is_funding("title")) / F.count(F.lit(1))).alias("funding_share"),
        F.max(age).alias("news_first_age_days"), (F.max(age) - F.min(age)).alias("news_span_days"), F.count("day").alias("_n_dated"), recent.alias("_n_recent"),
    )
    out = labels.select("label").join(of_papers, "label", "left").join(of_news, "label", "left")
    for p, prints in (("core", core), ("label", whole)):
        out = out.join(prints.select("label", *(F.col(c).alias(f"{p}_{c}") for c in ("works", "first_year", "last_year_works"))), "label", "left")
    none = dict.fromkeys(("papers_found", "news_found", "publishers_distinct", "trust_high_count", "_p_dated", "_p_recent", "_n_dated", "_n_recent"), 0)
    out = out.fillna(none)
    kinds = F.coalesce("_kinds", F.array().cast("array<string>"))
    dated, works = F.col("_p_dated") + F.col("_n_dated"), F.col("core_works")
    made = {
        "source_kinds_distinct": F.size(F.when(F.col("papers_found") > 0, F.array_union(kinds, F.array(F.lit(SCIENCE)))).otherwise(kinds)).cast("long"),
        "recent_share": F.when(dated > 0, (F.col("_p_recent") + F.col("_n_recent")) / dated).otherwise(0.0),
        "paper_recent_share": F.when(F.col("_p_dated") > 0, F.col("_p_recent") / F.col("_p_dated")),
        "core_age_years": F.when(works > 0, F.greatest(F.year(at) - F.col("core_first_year"), F.when(F.col("core_first_year").isNotNull(), 0))),
        "core_unseen": F.when(works.isNotNull(), (works == 0).cast("long")),
        "core_last_year_share": _share("core"),
        "label_last_year_share": _share("label"),
        "label_to_core_ratio": F.when(works > 0, F.col("label_works") / works),
    }
    return out.withColumns(made).select("label", *FEATURES)


#: The features, in the order of the row.
FEATURES = (
    "papers_found", "cos_max", "cos_mean", "news_found", "publishers_distinct", "source_kinds_distinct", "trust_high_count", "recent_share", "core_works", "core_age_years", "core_unseen",
    "core_last_year_share", "label_works", "label_last_year_share", "label_to_core_ratio", "news_first_age_days", "news_span_days", "funding_share", "paper_first_age_days", "paper_recent_share",
)
