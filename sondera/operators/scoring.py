"""Features inside a query, the linear model with contributions, and its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions.stats import sigmoid

PLAYERS_CAP, PRIOR_WEIGHT = 4, 10
#: The growth model.
GROWTH_MODEL = {
    "features": ["query_share_pct"], "impute_median": [0.5], "scale_mean": [0.498785438108616], "scale_std": [0.2904734407358093],
    "coef": [1.370578065067387], "intercept": -0.09370021277865638, "platt": {"a": 1.2235182887270881, "b": -0.19104144306322499},
    "log1p": [], "gate": {"passed": True},
}


def shrunk_share(share: Column, works: Column, by: W) -> Column:
    """A share drawn towards the median of its query with the weight of ten works; null stays null."""
    prior = F.median(share).over(by)
    return (share * works + PRIOR_WEIGHT * prior) / (works + PRIOR_WEIGHT)


def mid_percentile(value: str, *by: str) -> Column:
    """(below + (ties + 1) / 2 - 0.5) / n among the measured of a group; null for null."""
    of = [*by, F.col(value).isNull()]
    below = F.rank().over(W.partitionBy(*of).orderBy(value)) - 1
    ties = F.count(value).over(W.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), (below + (ties + 1) / F.lit(2.0) - 0.5) / F.count(value).over(W.partitionBy(*by)))


def query_features(pool: DataFrame, query: str = "query_id") -> DataFrame:
    """``pool`` (share, works, players, money, funding, commercial, pilot) with the features that compare inside a query."""
    w = W.partitionBy(query)
    out = pool.withColumn("query_share", shrunk_share(F.col("share"), F.col("works"), w))
    out = out.withColumn("query_share_pct", mid_percentile("query_share", query))
    yes = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out.withColumns(
        {
            "share_missing": F.col("query_share").isNull().cast("double"),
            "backed": ((F.col("players") > 0) | F.col("money")).cast("double"),
            "players_cap": F.least("players", F.lit(PLAYERS_CAP)).cast("double"),
            "f_funding": yes("funding"),
            "f_commercial": yes("commercial"),
            "f_pilot": yes("pilot"),
        }
    )


def probability(features: dict[str, Column], params: dict, top: int = 3) -> Column:
    """struct(probability, contributions): a logistic model with Platt calibration over standardised features.

    A missing value is the training median (already as the model sees it); listed counts go through log1p.
    Contributions are coefficient times z, the largest in size first.
    """
    margin, found = F.lit(float(params["intercept"])), []
    for name, median, mean, std, coef in zip(*(params[k] for k in ("features", "impute_median", "scale_mean", "scale_std", "coef"))):
        value = features[name].cast("double")
        seen = F.log1p(F.greatest(value, F.lit(0.0))) if name in params.get("log1p", ()) else value
        part = F.lit(float(coef)) * (F.coalesce(seen, F.lit(float(median))) - F.lit(float(mean))) / F.lit(float(std or 1.0))
        margin = margin + part
        found.append(F.struct((-F.abs(part)).alias("size"), F.lit(name).alias("name"), part.alias("part")))
    p = sigmoid(params["platt"]["a"] * margin + params["platt"]["b"])
    parts = F.transform(F.slice(F.array_sort(F.array(*found)), 1, top), lambda x: F.struct(x["name"].alias("name"), x["part"].alias("part")))
    return F.struct(p.alias("probability"), parts.alias("contributions"))


def score(pool: DataFrame, params: dict = GROWTH_MODEL) -> DataFrame:
    """``pool`` with confidence and predictors; both null where the model has not passed its gate."""
    if not params.get("gate", {}).get("passed"):
        return pool.withColumns({"confidence": F.lit(None).cast("double"), "predictors": F.lit(None).cast("array<struct<name:string,part:double>>")})
    found = pool.withColumn("_p", probability({f: F.col(f) for f in params["features"]}, params))
    return found.withColumns({"confidence": F.col("_p.probability"), "predictors": F.col("_p.contributions")}).drop("_p")
