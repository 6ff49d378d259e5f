"""Queries on calibration, paired tests, model choice, injected targets and what reports said in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions import text
from sondera.operators import evaluation, grouping, ranking, scoring, training
from sondera.plans import views as V
from sondera.plans.corpus_queries import _PAIRS, _pairs
from sondera.plans.evidence_queries import _training_rows
from sondera.plans.ranking_queries import _FEATS
from sondera.plans.registry import query, r6
from sondera.plans.views import AS_OF, sql

_NEWTON = """WITH c AS (SELECT share AS s, CAST(after > 30 AS DOUBLE) AS y FROM candidates WHERE share IS NOT NULL),
it AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
  SELECT any_value(i) + 1, any_value(a) + (sum(w) * sum((y - p) * s) - sum(w * s) * sum(y - p)) / (sum(w * s * s) * sum(w) - sum(w * s) * sum(w * s)),
    any_value(b) + (sum(w * s * s) * sum(y - p) - sum(w * s) * sum((y - p) * s)) / (sum(w * s * s) * sum(w) - sum(w * s) * sum(w * s))
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT i, a, b, s, y, 1 / (1 + exp(-(a * s + b))) AS p FROM it, c WHERE i < 12)) HAVING count(*) > 0)
SELECT round(a, 4) AS a, round(b, 4) AS b FROM it WHERE i = 12"""


@query("m6_platt", sql("candidates", _NEWTON).replace("WITH ", "WITH RECURSIVE ", 1))
def m6_platt(spark, d) -> DataFrame:
    """Slope and offset that turn a margin into a chance; the SQL reaches the same optimum by Newton's steps."""
    a, b = evaluation.platt(V.candidates(spark, d).withColumn("y", F.col("after") > 30), "share", "y")
    return spark.createDataFrame([(round(a, 4) + 0.0, round(b, 4) + 0.0)], "a double, b double")


@query("m18_corrected_t", sql("candidates", """
WITH f AS (SELECT domain, key % 10 AS fold, avg(CAST(money = (after > 30) AS DOUBLE)) - avg(CAST(funding = (after > 30) AS DOUBLE)) AS diff, count(*) AS n FROM candidates GROUP BY 1, 2),
g AS (SELECT *, sum(n) OVER (PARTITION BY domain) - n AS rest FROM f),
k AS (SELECT domain, count(*) AS folds, avg(diff) / sqrt(var_samp(diff) * (1.0::DOUBLE / count(*) + avg(n::DOUBLE / rest))) AS t FROM g GROUP BY domain),
a AS (SELECT *, atan(abs(t) / 3) AS x FROM k WHERE folds = 10), s AS (SELECT *, cos(x) * cos(x) AS c FROM a)
SELECT domain, folds, round(t, 6) AS t, round(1 - 2 / pi() * (x + sin(x) * cos(x) * (1 + 2 / 3.0::DOUBLE * c + 8 / 15.0::DOUBLE * c * c + 48 / 105.0::DOUBLE * c * c * c)), 6) AS p FROM s"""))
def m18_t(spark, d) -> DataFrame:
    """Two predictors of growth compared over ten folds of each domain."""
    y = F.col("after") > 30
    right = lambda c: F.avg((F.col(c) == y).cast("double"))
    f = V.candidates(spark, d).groupBy("domain", (F.col("key") % 10).alias("fold")).agg((right("money") - right("funding")).alias("diff"), F.count(F.lit(1)).alias("n"))
    f = f.withColumn("rest", F.sum("n").over(W.partitionBy("domain")) - F.col("n"))
    return evaluation.corrected_t(f, "diff", F.col("rest"), F.col("n"), "domain").select("domain", "folds", r6("t"), r6("p"))


@query("m18_mcnemar", sql("candidates", """
WITH c AS (SELECT domain, count(*) FILTER (WHERE money = (after > 30) AND funding <> (after > 30)) AS only_a, count(*) FILTER (WHERE money <> (after > 30) AND funding = (after > 30)) AS only_b FROM candidates GROUP BY domain),
u AS (SELECT domain, unnest(range(0, least(only_a, only_b) + 1)) AS i, only_a + only_b AS n FROM c),
p AS (SELECT domain, sum(exp(CASE WHEN n > 0 THEN lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2) END)) AS tail FROM u GROUP BY domain)
SELECT domain, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1, 2 * tail) END, 6) AS p FROM c JOIN p USING (domain)"""))
def m18_mcnemar(spark, d) -> DataFrame:
    c = V.candidates(spark, d).withColumn("y", F.col("after") > 30)
    return evaluation.mcnemar(c, "y", "money", "funding", "domain").select("domain", "only_a", "only_b", r6("p"))


@query("m11_model_choice", sql("candidates", """
WITH u AS (SELECT after > 30 AS pos, unnest(['works', 'share', 'players', 'minus_before']) AS model, unnest([true, true, false, false]) AS sparse, unnest([works, share, players, -before])::DOUBLE AS v FROM candidates),
r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0::DOUBLE AS r FROM u WHERE v IS NOT NULL),
a AS (SELECT model, any_value(sparse) AS sparse, round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r GROUP BY model)
SELECT model, auc FROM a ORDER BY (sparse AND auc >= (SELECT max(auc) FROM a WHERE NOT sparse) - 0.02) DESC, auc DESC, model LIMIT 1"""))
def m11(spark, d) -> DataFrame:
    """Of models measured by their area under the curve, the sparse one if it is near enough to the best other one."""
    c = V.candidates(spark, d).select((F.col("after") > 30).alias("y"), *(F.col(x).cast("double").alias(x) for x in ("works", "share", "players")), (-F.col("before")).cast("double").alias("minus_before"))
    lines = c.unpivot(["y"], ["works", "share", "players", "minus_before"], "model", "v")
    found = evaluation.auc(lines, "v", "y", "model").select("model", r6("auc"), F.col("model").isin("works", "share").alias("sparse"))
    return evaluation.choose(found).select("model", "auc")


_TARGET = "target AS (SELECT * REPLACE ('emerging' AS kind, CAST(0 AS INT) AS players, false AS money) FROM candidates WHERE kind = 'mature' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY works DESC, key) = 1)"


@query("m22_oracle_rank", sql("candidates", f"WITH {_TARGET}, pool AS (SELECT * FROM candidates WHERE kind = 'emerging' UNION ALL SELECT * FROM target), " + _FEATS.replace("FROM candidates", "FROM pool") + """,
m AS (SELECT query_id, key, round(confidence, 9) AS mine FROM h WHERE key IN (SELECT key FROM target))
SELECT m.query_id, m.key, round(mine, 6) AS confidence, count(*) FILTER (WHERE round(h.confidence, 9) > mine) + 1 AS place, count(*) AS n FROM m JOIN h USING (query_id) GROUP BY ALL"""))
def m22(spark, d) -> DataFrame:
    """The place that a candidate from outside gets in each query's pool, without players or money of its own."""
    c = V.candidates(spark, d)
    target = ranking.top_n(c.filter("kind = 'mature'"), 1, [F.desc("works"), F.asc("key")], "query_id").select(c.columns)
    target = target.withColumns({"kind": F.lit("emerging"), "players": F.lit(0), "money": F.lit(False), "injected": F.lit(True)})
    pool = c.filter("kind = 'emerging'").withColumn("injected", F.lit(False)).unionByName(target)
    s = scoring.score(scoring.query_features(pool)).withColumn("c9", F.round("confidence", 9))
    mine = F.max(F.when(F.col("injected"), F.col("c9"))).over(W.partitionBy("query_id"))
    got = s.withColumn("mine", mine).groupBy("query_id").agg(
        F.max(F.when(F.col("injected"), F.col("key"))).alias("key"), r6(F.max("mine"), "confidence"),
        (F.count_if(F.col("c9") > F.col("mine")) + 1).alias("place"), F.count(F.lit(1)).alias("n"),
    )
    return got.filter("key is not null")


_RETRO = """WITH items AS (SELECT name AS report, unnest(labels) AS label, unnest(range(1, len(labels) + 1)) AS spot FROM reports),
t AS (SELECT DISTINCT label AS target, 'Query ' || (CAST(regexp_extract(label, '[0-9]+') AS INT) % 30) AS query FROM items),
pool AS (SELECT report, count(*) AS pool FROM items GROUP BY report),
p AS (SELECT t.target, r.name AS report, r.day AS cut, coalesce(pool, 0) AS pool, CASE WHEN spot IS NULL THEN 'missing' WHEN spot <= 2 THEN 'top' WHEN spot = 3 THEN 'watch' WHEN spot = 4 THEN 'beyond' ELSE 'excluded' END AS stage
  FROM t JOIN reports r USING (query) LEFT JOIN pool ON pool.report = r.name LEFT JOIN items ON items.report = r.name AND items.label = t.target)"""


def _places(spark, d) -> tuple[DataFrame, DataFrame]:
    r = V.reports(spark, d)
    at = F.col("at") + 1
    stage = F.when(at <= 2, "top").when(at == 3, "watch").when(at == 4, "beyond").otherwise("excluded")
    items = r.select(F.col("name").alias("report"), F.posexplode("labels").alias("at", "label")).select("report", stage.alias("stage"), at.alias("place"), "label")
    asked = F.concat(F.lit("Query "), (F.regexp_extract("label", "[0-9]+", 0).cast("int") % 30).cast("string"))
    targets = items.select("label").distinct().select(F.col("label").alias("target"), F.lower("label").alias("alias"), asked.alias("query"))
    runs = r.select(F.col("name").alias("report"), "query", F.col("day").alias("cut"))
    pairs = targets.join(runs.select("report", "query"), "query").select("target", "report", "alias")
    return evaluation.locate(items, runs, pairs), pairs.join(runs, "report").groupBy("target").agg(F.date_add(F.max("cut"), 30).alias("day"))


@query("m23_coverage", sql("reports", f"""{_RETRO} SELECT count(*) AS n, count(*) FILTER (WHERE stage = 'top') AS in_top, count(*) FILTER (WHERE stage IN ('top', 'watch')) AS seen,
count(*) FILTER (WHERE stage <> 'missing') AS in_pool, round(sum(CASE WHEN stage <> 'missing' AND pool > 0 THEN least(1.0::DOUBLE, 2.0::DOUBLE / pool) ELSE 0.0 END), 4) AS chance FROM p"""))
def m23_coverage(spark, d) -> DataFrame:
    places, _ = _places(spark, d)
    return evaluation.retro(places, top=2).withColumn("chance", F.round("chance", 4))


@query("m23_lead_time", sql("reports", f"""{_RETRO} SELECT target, min(cut) FILTER (WHERE stage = 'top') AS first_top, min(cut) FILTER (WHERE stage IN ('top', 'watch')) AS first_seen,
CAST(date_diff('day', min(cut) FILTER (WHERE stage IN ('top', 'watch')), max(cut) + 30) AS INT) AS lead_days FROM p GROUP BY target"""))
def m23_lead(spark, d) -> DataFrame:
    """For each target the first run that put it on top or watched it, and the days from then until it was known."""
    places, known = _places(spark, d)
    return evaluation.lead_time(places, known)


@query("j12_first_naming", sql("headlines", """WITH firms AS (SELECT DISTINCT title, unnest([publisher, split_part(label, ' ', 1), split_part(title, ' ', 2)]) AS company FROM headlines)
SELECT label, company, min(n) AS n FROM headlines JOIN firms USING (title) WHERE NOT list_contains(regexp_extract_all(lower(label), '[a-z0-9+#-]+'), lower(company)) GROUP BY ALL"""))
def j12_naming(spark, d) -> DataFrame:
    """For each label the companies named in its headlines, with the first headline that names each."""
    h = V.headlines(spark, d)
    named = F.array("publisher", F.split_part("label", F.lit(" "), F.lit(1)), F.split_part("title", F.lit(" "), F.lit(2)))
    return grouping.first_naming(h, h.select("title", F.explode(named).alias("company")), "n")


_FOLD_WORD = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, -3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, -1) ELSE w END"


@query("s11_catalogue", sql("works", f"""
WITH {_PAIRS}, p AS (SELECT name AS phrase, list_transform(string_split(name, ' '), lambda w: {_FOLD_WORD}) AS ws FROM pairs),
pp AS (SELECT phrase, ' ' || array_to_string(ws, ' ') || ' ' AS k FROM p WHERE len(list_filter(ws, lambda x: length(x) > 2 AND NOT list_contains({text.CATALOGUE_STOP}, x))) >= 2),
f AS (SELECT doc_id AS id, DATE '2018-01-01' + CAST((doc_id * 37) % 2192 AS INT) AS launched, ' ' || array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: {_FOLD_WORD}), ' ') || ' ' AS t FROM documents),
h AS (SELECT phrase, id, launched, row_number() OVER (PARTITION BY phrase ORDER BY id) AS n FROM pp JOIN f ON contains(t, k) WHERE launched <= DATE '{AS_OF}') SELECT phrase, id, launched, n FROM h WHERE n <= 3"""))
def s11(spark, d) -> DataFrame:
    """Companies of a catalogue, launched by the date, whose description holds a phrase."""
    second = 1514764800 + (F.col("id") * 37 % 2192) * 86400 + F.col("id") % 86400
    c = V.works(spark, d).select("id", F.col("term_raw").alias("text")).withColumn("launched_at", second)
    return grouping.catalogue(_pairs(spark, d).select(F.col("name").alias("phrase")), c, AS_OF)


@query("m5_repeated_folds")
def m5_repeated(spark, d) -> DataFrame:
    return training.repeated_folds(_training_rows(spark, d), ["works", "players", "share", "after"], "y", "key", repeats=2, folds=3)
