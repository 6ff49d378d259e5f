"""Training on feature tables with spark.ml."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.lineage import cut


def _prepared(features: list[str]) -> list:
    filled = [f"{f}_f" for f in features]
    return [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def logistic(features: list[str], label: str, l1: float = 0.0, c: float = 1.0) -> Pipeline:
    """Median imputation, scaling, and a logistic regression of inverse strength ``c``."""
    return Pipeline(stages=[*_prepared(features), LogisticRegression(labelCol=label, elasticNetParam=l1, regParam=1.0 / (100 * c))])


def fit_logistic(rows: DataFrame, features: list[str], label: str, grid: tuple = (0.03, 0.1, 0.3, 1.0), folds: int = 3) -> DataFrame:
    """(penalty, c, auc): the best strength of either penalty by inner folds.

    A fold is imputed and scaled once for all strengths of both penalties, and kept while they are fitted.
    """
    dealt = cut(rows.select(*features, label).withColumn("_at", F.rand(7)))
    measure, found = BinaryClassificationEvaluator(labelCol=label), {}
    for f in range(folds):
        own = (F.col("_at") >= f / folds) & (F.col("_at") < (f + 1) / folds)
        ready = Pipeline(stages=_prepared(features)).fit(dealt.filter(~own))
        train, test = (ready.transform(x).select("features", label).persist() for x in (dealt.filter(~own), dealt.filter(own)))
        for penalty, l1 in (("l1", 1.0), ("l2", 0.0)):
            for c in grid:
                model = LogisticRegression(labelCol=label, elasticNetParam=l1, regParam=1.0 / (100 * c)).fit(train)
                found.setdefault(penalty, {}).setdefault(c, []).append(measure.evaluate(model.transform(test)))
        train.unpersist()
        test.unpersist()
    out = []
    for penalty, areas in found.items():
        mean = {c: sum(x) / len(x) for c, x in areas.items()}
        best = max(grid, key=mean.get)
        out.append((penalty, best, round(float(mean[best]), 4)))
    return rows.sparkSession.createDataFrame(out, "penalty string, c double, auc double")


def leave_one_out(rows: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    """``rows`` with p, each scored by a model fitted on the other groups. One fit per group: for few groups."""
    out = None
    for (g,) in rows.select(group).distinct().orderBy(group).collect():
        model = logistic(features, label).fit(rows.filter(F.col(group) != g))
        got = model.transform(rows.filter(F.col(group) == g)).select(*rows.columns, vector_to_array("probability")[1].alias("p"))
        out = got if out is None else out.unionByName(got)
    return out


def stratified(rows: DataFrame, label: str, key: str, folds: int, seed: int = 7, bucket_rows: int = 10_000) -> DataFrame:
    """``rows`` with _fold: dealt out in turn within each outcome, in the order of a seeded hash of their key.

    Of each outcome, folds get the same number of rows within one. The order goes by hash ranges of about ``bucket_rows``
    rows; the counts of those before, one number a range, make the turn go on from one to the next.
    """
    buckets = max(1, rows.count() // bucket_rows)
    h = F.xxhash64(F.lit(seed), key)
    own = rows.withColumns({"_h": h, "_b": F.pmod(h, F.lit(buckets))})
    w = W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = own.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n")).select(label, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    turn = F.col("_before") + F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)) - 1
    return own.join(before, [label, "_b"]).withColumn("_fold", F.pmod(turn, F.lit(folds)).cast("int")).drop("_h", "_b", "_before")


def repeated_folds(rows: DataFrame, features: list[str], label: str, key: str, repeats: int = 3, folds: int = 5, seed: int = 7) -> DataFrame:
    """(repeat, fold, n_train, n_test, auc): each repeat deals the rows anew to folds, in turn within each outcome.

    Every row is scored in each repeat by a model that has not seen it. One fit for each fold of a repeat.
    """
    auc, out = BinaryClassificationEvaluator(labelCol=label), []
    for r in range(1, repeats + 1):
        dealt = cut(stratified(rows, label, key, folds, seed * 1000 + r))
        sizes = {f: n for f, n in dealt.groupBy("_fold").count().collect()}
        for f in sorted(sizes):
            got = logistic(features, label).fit(dealt.filter(F.col("_fold") != f)).transform(dealt.filter(F.col("_fold") == f))
            out.append((r, int(f), sum(sizes.values()) - sizes[f], sizes[f], round(float(auc.evaluate(got)), 4)))
    return rows.sparkSession.createDataFrame(out, "repeat int, fold int, n_train long, n_test long, auc double")


def compare(rows: DataFrame, features: list[str], label: str, seed: int = 7) -> DataFrame:
    """(model, auc): estimators trained on four fifths of the rows and tried on the rest, by a hash of the row."""
    fold = F.pmod(F.xxhash64(*features), F.lit(5))
    train, test = rows.filter(fold != 0).cache(), rows.filter(fold == 0)
    kinds = {
        "logistic": LogisticRegression(labelCol=label),
        "tree": DecisionTreeClassifier(labelCol=label, maxDepth=3, seed=seed),
        "forest": RandomForestClassifier(labelCol=label, numTrees=10, seed=seed),
        "boosted": GBTClassifier(labelCol=label, maxIter=5, seed=seed),
    }
    auc = BinaryClassificationEvaluator(labelCol=label)
    out = [(name, round(float(auc.evaluate(Pipeline(stages=[*_prepared(features), e]).fit(train).transform(test))), 4)) for name, e in kinds.items()]
    train.unpersist()
    return rows.sparkSession.createDataFrame(out, "model string, auc double")


def usable_features(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, present, constant): a feature with nothing present is dropped; a constant one is reported."""
    each = rows.select(*(F.col(f).cast("double").alias(f) for f in features)).unpivot([], features, "feature", "v")
    return each.groupBy("feature").agg(F.count("v").alias("present"), (F.min("v") == F.max("v")).alias("constant"))


def temporal_holdout(rows: DataFrame, features: list[str], label: str, when: str, last: int) -> DataFrame:
    """(train_rows, test_rows, auc): fitted on rows up to ``last``, tried on the later ones."""
    own, later = rows.filter(F.col(when) <= last), rows.filter(F.col(when) > last)
    score = BinaryClassificationEvaluator(labelCol=label).evaluate(logistic(features, label).fit(own).transform(later))
    return rows.sparkSession.createDataFrame([(own.count(), later.count(), round(float(score), 4))], "train_rows long, test_rows long, auc double")


def shuffled(rows: DataFrame, column: str, key: str, seed: int, bucket_rows: int = 10_000) -> DataFrame:
    """``rows`` with the values of a column dealt out anew: in random buckets, each row gets the next one's value."""
    buckets = max(1, rows.count() // bucket_rows)
    w = W.partitionBy(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets))).orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.lead(F.lit(1)).over(w).isNull()
    return rows.withColumn(column, F.when(last, F.first(column).over(whole)).otherwise(F.lead(column).over(w)))


def importance(rows: DataFrame, features: list[str], label: str, key: str, seed: int = 7) -> DataFrame:
    """(feature, drop): what the area under the curve loses when the values of a feature are dealt out anew."""
    model, auc = logistic(features, label).fit(rows), BinaryClassificationEvaluator(labelCol=label)
    full = auc.evaluate(model.transform(rows))
    out = [(f, round(full - float(auc.evaluate(model.transform(shuffled(rows, f, key, seed)))), 4)) for f in features]
    return rows.sparkSession.createDataFrame(out, "feature string, drop double")


def tree_rules(rows: DataFrame, features: list[str], label: str, depth: int = 3) -> str:
    """A tree of few levels over the features, as indented lines; thresholds are in the features' own units."""
    fill, assemble, _ = _prepared(features)
    tree = DecisionTreeClassifier(labelCol=label, featuresCol="raw", maxDepth=depth, seed=7)
    lines = Pipeline(stages=[fill, assemble, tree]).fit(rows).stages[-1].toDebugString.splitlines()[1:]
    return "\n".join(re.sub(r"feature (\d+)", lambda m: features[int(m[1])], line) for line in lines if line.strip())


def vector_probe(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(train_rows, test_rows, auc): a logistic regression on the raw coordinates, tried on a fifth of the rows."""
    own = rows.withColumn("features", array_to_vector(vector)).withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(5)))
    train, test = own.filter("_fold <> 0"), own.filter("_fold = 0")
    score = BinaryClassificationEvaluator(labelCol=label).evaluate(LogisticRegression(labelCol=label, regParam=0.01).fit(train).transform(test))
    return rows.sparkSession.createDataFrame([(train.count(), test.count(), round(float(score), 4))], "train_rows long, test_rows long, auc double")
