"""Queries on vectors, candidates, outcomes, runs and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions import stats, text, vectors
from sondera.operators import evaluation, grouping, history, neighbours, ranking, scoring
from sondera.plans import views as V
from sondera.plans.registry import query, r6
from sondera.plans.views import sql
from sondera.sources import works as S

# --- vectors

_DOT = "list_dot_product(a.v, b.v)"


def _queries(spark, d) -> DataFrame:
    """Every vector whose id is divisible by 50; they ask all vectors."""
    return V.vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query"), "v")


@query("j4_nearest", sql("vectors", f"""WITH s AS (SELECT b.id AS query, a.id AS id, round({_DOT}, 6) AS score, row_number() OVER (PARTITION BY b.id ORDER BY round({_DOT}, 9) DESC, a.id) AS rank
  FROM vectors a, vectors b WHERE b.id % 50 = 0) SELECT * FROM s WHERE rank <= 5"""))
def j4(spark, d) -> DataFrame:
    return neighbours.top_k(V.vectors(spark, d), _queries(spark, d), 5).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("j5_pairs_above", sql("vectors", f"SELECT a.id AS a, b.id AS b, round({_DOT}, 6) AS score FROM vectors a JOIN vectors b ON a.id < b.id AND {_DOT} >= 0.3"))
def j5(spark, d) -> DataFrame:
    return neighbours.pairs_above(V.vectors(spark, d), 0.3).withColumn("score", F.round("score", 6))


@query("n2_neighbourhoods", sql("vectors", f"""
WITH c AS (SELECT *, CASE WHEN observed_at > DATE '2020-06-30' THEN 'last' WHEN observed_at > DATE '2018-06-30' THEN 'prev' ELSE 'old' END AS win FROM vectors WHERE observed_at <= DATE '2022-06-30'),
s AS (SELECT b.id AS query, win, {_DOT} AS s FROM c a, vectors b WHERE b.id % 50 = 0), g AS (SELECT query, max(s) AS now, max(s) FILTER (WHERE win <> 'last') AS before_last, count(*) FILTER (WHERE s >= 0.25 AND win = 'last') AS l, count(*) FILTER (WHERE s >= 0.25 AND win = 'prev') AS p FROM s GROUP BY query)
SELECT query, round(now, 6) AS nn_now, round(before_last, 6) AS nn_asof, round(now - before_last, 6) AS gain, l AS dense_last, p AS dense_prev, round((l + 1)::DOUBLE / (p + 1), 6) AS ratio FROM g"""))
def n2(spark, d) -> DataFrame:
    got = neighbours.neighbourhoods(V.vectors(spark, d), _queries(spark, d), "2022-06-30", tau=0.25)
    return got.select("query", r6("nn_now"), r6("nn_asof"), r6("gain"), "dense_last", "dense_prev", r6("ratio"))


@query("n3_window_coverage", sql("works vectors", """
SELECT CASE WHEN w.observed_at > DATE '2020-06-30' THEN 'last' WHEN w.observed_at > DATE '2018-06-30' THEN 'prev' ELSE 'old' END AS win, count(*) AS works, count(v.id) AS with_vector, round(count(v.id)::DOUBLE / count(*), 6) AS share
FROM works w LEFT JOIN vectors v USING (id) WHERE w.observed_at <= DATE '2022-06-30' GROUP BY 1"""))
def n3(spark, d) -> DataFrame:
    return neighbours.window_coverage(V.works(spark, d), V.vectors(spark, d), "2022-06-30").withColumn("share", F.round("share", 6))


@query("n4_coherence", sql("vectors", f"""
WITH s AS (SELECT b.id AS query, a.id, a.v, row_number() OVER (PARTITION BY b.id ORDER BY round({_DOT}, 9) DESC, a.id) AS rank FROM vectors a, vectors b WHERE b.id % 50 = 0), k AS (SELECT * FROM s WHERE rank <= 20)
SELECT a.query, round(avg({_DOT}), 6) AS coherence FROM k a JOIN k b ON a.query = b.query AND a.rank < b.rank GROUP BY a.query"""))
def n4(spark, d) -> DataFrame:
    return neighbours.coherence(V.vectors(spark, d), _queries(spark, d)).withColumn("coherence", F.round("coherence", 6))


@query("f5_normalise", sql("vectors", "SELECT id, round(CASE WHEN id % 11 = 0 THEN 0 ELSE v[1] / sqrt(list_dot_product(v, v)) END, 6) AS first, CASE WHEN id % 11 = 0 THEN 0 ELSE 1 END AS norm FROM vectors"))
def f5(spark, d) -> DataFrame:
    """Vectors of other lengths have the direction that they had; a zero vector stays zero."""
    scale = F.when(F.col("id") % 11 == 0, 0.0).otherwise(F.col("id") % 7 + 0.5)
    v = V.vectors(spark, d).select("id", vectors.normalise(F.transform("v", lambda x: x * scale)).alias("u"))
    return v.select("id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 6).cast("int").alias("norm"))


@query("g1_variant_groups")
def g1(spark, d) -> DataFrame:
    return grouping.vector_groups(V.vectors(spark, d), 0.3, 0.3)


def _labels(spark, d) -> DataFrame:
    """Names of three words for each part: name, type, brand size."""
    p = V.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("size"), F.col("p_size").cast("string")), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("name"))


@query("j6_similar_names", """WITH l AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || lower(p_type) || ' size' || p_size || ' ' || replace(lower(p_brand), '#', '')), '[a-z0-9+#-]{3,}'), lambda x: NOT list_contains(""" + str(text.NAME_STOP) + """, x))) AS w FROM part)
SELECT a.id AS a, b.id AS b, round(CASE WHEN a.w = b.w THEN 1.0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS score FROM l a JOIN l b ON a.id < b.id AND len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.8""")
def j6(spark, d) -> DataFrame:
    return grouping.similar_names(_labels(spark, d), 0.8).withColumn("score", F.round("score", 6))


@query("g2_merge_near")
def g2(spark, d) -> DataFrame:
    l = _labels(spark, d)
    return grouping.merge_near(l.withColumn("rank", F.length("name")), grouping.similar_names(l, 0.8))


@query("j8_company_links", """WITH t AS (SELECT s_suppkey AS id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(s_name || ' unit' || (s_suppkey // 2), '[A-Za-z][A-Za-z0-9&.\\-]+'), lambda x: lower(trim(x, '.'))), lambda x: length(x) > 2 AND NOT list_contains(""" + str(text.COMPANY_GENERIC) + """, x)))) AS w FROM supplier),
f AS (SELECT w FROM t GROUP BY w HAVING count(*) <= 2) SELECT DISTINCT a.id AS a, b.id AS b FROM t a JOIN t b ON a.w = b.w AND a.id < b.id JOIN f ON f.w = a.w""")
def j8(spark, d) -> DataFrame:
    s = V.table(spark, d, "supplier")
    return grouping.linked_companies(s.select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" unit"), F.floor(F.col("s_suppkey") / 2).cast("string")).alias("name")))


# --- candidates

_SHRUNK = "(share * works + 10 * median(share) OVER (PARTITION BY query_id)) / (works + 10)"
_FEATS = f"""f AS (SELECT *, {_SHRUNK} AS query_share FROM candidates WHERE kind = 'emerging'),
g AS (SELECT *, CASE WHEN query_share IS NOT NULL THEN (rank() OVER (PARTITION BY query_id, query_share IS NULL ORDER BY query_share) - 1 + (count(query_share) OVER (PARTITION BY query_id, query_share) + 1) / 2.0::DOUBLE - 0.5::DOUBLE) / count(query_share) OVER (PARTITION BY query_id) END AS pct,
  CAST(players > 0 OR money AS DOUBLE) AS backed, least(players, 4)::DOUBLE AS players_cap, label_works <= median(label_works) OVER (PARTITION BY query_id) AS low_visibility FROM f),
h AS (SELECT *, 1 / (1 + exp(-(1.2235182887270881::DOUBLE * (-0.09370021277865638::DOUBLE + 1.370578065067387::DOUBLE * (coalesce(pct, 0.5::DOUBLE) - 0.498785438108616::DOUBLE) / 0.2904734407358093::DOUBLE) - 0.19104144306322499::DOUBLE))) AS confidence FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, backed DESC, round(coalesce(query_share, -1), 9) DESC, least(players, 4) DESC, low_visibility DESC, evidence_share DESC, recent_share DESC, key) AS place FROM h)"""


def _scored(spark, d) -> DataFrame:
    pool = scoring.query_features(V.candidates(spark, d).filter("kind = 'emerging'"))
    pool = scoring.score(pool.withColumn("low_visibility", ranking.low_visibility("label_works")))
    rounded = pool.withColumns({"c9": F.round("confidence", 9), "query_share": F.round("query_share", 9)})
    return rounded.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*ranking.top_order("c9"))))


@query("m2_query_features", sql("candidates", f"WITH {_FEATS} SELECT query_id, key, round(query_share, 6) AS query_share, round(pct, 6) AS pct, backed, players_cap, CAST(query_share IS NULL AS DOUBLE) AS share_missing FROM g"))
def m2(spark, d) -> DataFrame:
    p = scoring.query_features(V.candidates(spark, d).filter("kind = 'emerging'"))
    return p.select("query_id", "key", r6("query_share"), r6("query_share_pct", "pct"), "backed", "players_cap", "share_missing")


@query("m1_score", sql("candidates", f"WITH {_FEATS} SELECT key, round(confidence, 6) AS confidence, round(1.370578065067387::DOUBLE * (coalesce(pct, 0.5::DOUBLE) - 0.498785438108616::DOUBLE) / 0.2904734407358093::DOUBLE, 6) AS part FROM h"))
def m1(spark, d) -> DataFrame:
    return _scored(spark, d).select("key", r6("confidence"), r6(F.col("predictors")[0]["part"], "part"))


@query("m29_gate", sql("candidates", f"WITH {_FEATS} SELECT 'open' AS gate, key, round(confidence, 6) AS confidence FROM h UNION ALL SELECT 'closed', key, NULL FROM h"))
def m29(spark, d) -> DataFrame:
    """A model whose parameters, read from JSON, have passed their gate, and the same one where they have not."""
    pool, out = scoring.query_features(V.candidates(spark, d).filter("kind = 'emerging'")), None
    for gate, passed in (("open", True), ("closed", False)):
        params = json.loads(json.dumps(scoring.GROWTH_MODEL | {"gate": {"passed": passed}}))
        one = scoring.score(pool, params).select(F.lit(gate).alias("gate"), "key", r6("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


@query("o1_top_order", sql("candidates", f"WITH {_FEATS} SELECT query_id, label, place FROM o WHERE place <= 15"))
def o1(spark, d) -> DataFrame:
    return _scored(spark, d).filter("place <= 15").select("query_id", "label", F.col("place").cast("long").alias("place"))


@query("w13_low_visibility", sql("candidates", f"WITH {_FEATS} SELECT query_id, count(*) FILTER (WHERE low_visibility) AS low, count(*) AS n FROM g GROUP BY query_id"))
def w13(spark, d) -> DataFrame:
    c = V.candidates(spark, d).filter("kind = 'emerging'").withColumn("low", ranking.low_visibility("label_works"))
    return c.groupBy("query_id").agg(F.count_if("low").alias("low"), F.count(F.lit(1)).alias("n"))


@query("w4_shrunk_share", sql("candidates", f"SELECT key, round({_SHRUNK}, 6) AS shrunk FROM candidates"))
def w4(spark, d) -> DataFrame:
    return V.candidates(spark, d).select("key", r6(scoring.shrunk_share(F.col("share"), F.col("works"), W.partitionBy("query_id")), "shrunk"))


@query("w3_percentile", sql("candidates", "SELECT key, round(CASE WHEN share IS NOT NULL THEN (rank() OVER (PARTITION BY query_id, share IS NULL ORDER BY share) - 1 + (count(share) OVER (PARTITION BY query_id, share) + 1) / 2.0::DOUBLE - 0.5::DOUBLE) / count(share) OVER (PARTITION BY query_id) END, 6) AS pct FROM candidates"))
def w3(spark, d) -> DataFrame:
    return V.candidates(spark, d).select("key", r6(scoring.mid_percentile("share", "query_id"), "pct"))


@query("w5_top_n_per_domain", sql("candidates", "SELECT domain, key, place FROM (SELECT domain, key, row_number() OVER (PARTITION BY domain ORDER BY works DESC, key) AS place, count(*) OVER (PARTITION BY domain) // 10 AS k FROM candidates) WHERE place <= k"))
def w5(spark, d) -> DataFrame:
    c = V.candidates(spark, d).withColumn("k", F.floor(F.count(F.lit(1)).over(W.partitionBy("domain")) / 10))
    return ranking.top_n(c, F.col("k"), [F.desc("works"), F.asc("key")], "domain").select("domain", "key", F.col("place").cast("long").alias("place"))


@query("o2_queue_order", sql("candidates", "SELECT query_id, key, place FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY money DESC, coalesce(2000 + before, 0) DESC, works, key) AS place FROM candidates) WHERE place <= 45"))
def o2(spark, d) -> DataFrame:
    order = [F.desc("money"), F.coalesce(F.lit(2000) + F.col("before"), F.lit(0)).desc(), F.asc("works"), F.asc("key")]
    return ranking.top_n(V.candidates(spark, d), 45, order, "query_id").select("query_id", "key", F.col("place").cast("long").alias("place"))


@query("o3_money_queue", sql("candidates", "SELECT query_id, key, place FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY least(players, 4) DESC, least(key % 5, 3) DESC, after DESC, key) AS place FROM candidates WHERE money) WHERE place <= 35"))
def o3(spark, d) -> DataFrame:
    order = [F.least("players", F.lit(4)).desc(), F.least(F.col("key") % 5, F.lit(3)).desc(), F.desc("after"), F.asc("key")]
    return ranking.top_n(V.candidates(spark, d).filter("money"), 35, order, "query_id").select("query_id", "key", F.col("place").cast("long").alias("place"))


_LAYER = """l AS (SELECT *, CASE WHEN leaders OR (players >= 1 AND key % 5 < 2 AND commercial) THEN 'trend' WHEN CAST(label_works >= 2 AS INT) + CAST(coalesce(patent_growth > 1.5, false) AS INT) + CAST((players > 0 AND NOT (key % 5 < 2)) OR pilot OR funding AS INT) >= 2 THEN 'weak' ELSE 'watch' END AS layer FROM o)"""


def _layered(spark, d) -> DataFrame:
    big, own = F.array(F.lit("NVIDIA")), F.array(F.lit("Acme"))
    companies = F.when(F.col("players") < 1, F.array().cast("array<string>")).when(F.col("key") % 5 < 2, big).otherwise(own)
    c = _scored(spark, d)
    return c.withColumn("layer", ranking.layer(companies, F.col("leaders"), F.col("commercial"), F.col("pilot"), F.col("funding"), F.col("label_works"), F.col("patent_growth"), F.lit(1.5))["layer"])


@query("p11_layers", sql("candidates", f"WITH {_FEATS}, {_LAYER} SELECT query_id, layer, count(*) AS n FROM l GROUP BY ALL"))
def p11(spark, d) -> DataFrame:
    return _layered(spark, d).groupBy("query_id", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("o7_fill_top", sql("candidates", f"""WITH {_FEATS}, {_LAYER}, x AS (SELECT *, count(*) FILTER (WHERE layer = 'weak') OVER (PARTITION BY query_id) AS nw, row_number() OVER (PARTITION BY query_id, layer = 'weak' ORDER BY place) AS rn FROM l)
SELECT query_id, key, CASE WHEN layer = 'weak' AND rn <= 15 THEN 'top' WHEN layer = 'weak' THEN 'beyond' WHEN rn <= greatest(15 - nw, 0) THEN 'top' WHEN rn <= greatest(15 - nw, 0) + 10 THEN 'watch' ELSE 'beyond' END AS bucket, layer <> 'weak' AND rn <= greatest(15 - nw, 0) AS filled FROM x"""))
def o7(spark, d) -> DataFrame:
    return ranking.fill_top(_layered(spark, d)).select("query_id", "key", "bucket", "filled")


@query("o6_take_on_topic", sql("candidates", f"""WITH {_FEATS}, x AS (SELECT *, coalesce(sum(CAST(grade >= 2 AS INT)) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before15 FROM o)
SELECT key, CASE WHEN before15 >= 15 THEN 'untested' WHEN grade >= 2 THEN 'kept' ELSE 'dropped' END AS state FROM x"""))
def o6(spark, d) -> DataFrame:
    return ranking.take_on_topic(_scored(spark, d)).select("key", "state")


@query("p12_evidence_stage", sql("candidates", """SELECT key, CASE WHEN key % 2 = 0 THEN CASE WHEN commercial THEN 4 WHEN pilot THEN 3 WHEN funding THEN 2 ELSE 1 END
  ELSE greatest(grade + 1, CASE WHEN commercial THEN 4 WHEN pilot THEN 3 ELSE 0 END) END AS stage FROM candidates"""))
def p12(spark, d) -> DataFrame:
    c = F.col
    stage = ranking.evidence_stage(c("commercial"), c("pilot"), c("funding"), c("key") % 2 == 0, c("grade") + 1, c("commercial"), c("pilot"))
    return V.candidates(spark, d).select("key", stage.alias("stage"))


@query("p13_rubric", sql("candidates", """SELECT key, CASE grade WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE NULL END AS stage, CASE WHEN players < 3 THEN 3 WHEN players < 5 THEN 2 END AS trend FROM candidates"""))
def p13(spark, d) -> DataFrame:
    written = F.when(F.col("grade") == 0, "Концепция/Исследование").when(F.col("grade") == 1, "Прототип/PoC → первые поставки").when(F.col("grade") == 2, "Пилот → Раннее внедрение").otherwise("серия")
    trend = F.when(F.col("players") < 3, "Растёт быстро").when(F.col("players") < 5, "Стабильный/растёт").otherwise("Падает")
    return V.candidates(spark, d).select("key", ranking.parse_stage(written).alias("stage"), ranking.parse_trend(trend).alias("trend"))


@query("p14_excluded_why", sql("candidates", """SELECT key, CASE WHEN kind = 'emerging' THEN '' WHEN NOT (funding OR commercial OR leaders) THEN 'no reason given'
  ELSE 'by: ' || array_to_string(list_filter([CASE WHEN funding THEN 'funding' END, CASE WHEN commercial THEN 'commercial' END, CASE WHEN leaders THEN 'leaders' END], lambda x: x IS NOT NULL), '; ') END AS why FROM candidates"""))
def p14(spark, d) -> DataFrame:
    return V.candidates(spark, d).select("key", ranking.excluded_why(F.col("kind"), {k: F.col(k) for k in ("funding", "commercial", "leaders")}).alias("why"))


@query("p15_checks", sql("candidates", "SELECT key, round((CAST(works >= 2 AS INT) + CAST(players >= 2 AS INT) + CAST(funding AS INT) + CAST(pilot AS INT)) / 4.0::DOUBLE, 6) AS share FROM candidates"))
def p15(spark, d) -> DataFrame:
    checks = [F.col("works") >= 2, F.col("players") >= 2, F.col("funding"), F.col("pilot")]
    return V.candidates(spark, d).select("key", r6(sum((c.cast("int") for c in checks[1:]), checks[0].cast("int")) / F.lit(4.0), "share"))


@query("a14_check_rates", sql("candidates", """SELECT name, round(avg(CAST(ok AS DOUBLE)), 6) AS rate, avg(CAST(ok AS DOUBLE)) > 0.9 AS flag FROM (SELECT unnest([{'name': 'works', 'ok': works >= 2}, {'name': 'players', 'ok': players >= 2}, {'name': 'funding', 'ok': funding}], recursive := true) FROM candidates) GROUP BY name"""))
def a14(spark, d) -> DataFrame:
    c = V.candidates(spark, d).select((F.col("works") >= 2).alias("works"), (F.col("players") >= 2).alias("players"), "funding")
    each = c.unpivot([], ["works", "players", "funding"], "name", "ok")
    return each.groupBy("name").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("rate"), (F.avg(F.col("ok").cast("double")) > 0.9).alias("flag"))


@query("o11_bucket_moves", sql("candidates", f"WITH {_FEATS}, {_LAYER} SELECT key, CASE WHEN layer = 'trend' THEN 'mature' WHEN grade = 0 THEN 'too_broad' ELSE 'kept' END AS bucket FROM l"))
def o11(spark, d) -> DataFrame:
    return _layered(spark, d).select("key", F.when(F.col("layer") == "trend", "mature").when(F.col("grade") == 0, "too_broad").otherwise("kept").alias("bucket"))


@query("p21_kinds", sql("candidates", "SELECT kind, list_position(['too_broad', 'noise', 'hype', 'standard', 'mature', 'emerging'], kind) AS ord, kind = 'emerging' AS shown, count(*) AS n FROM candidates GROUP BY kind"))
def p21(spark, d) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ranking.KINDS)), F.col("kind")).cast("int")
    return V.candidates(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", place.alias("ord"), (F.col("kind") == "emerging").alias("shown"), "n")


# --- evaluation


@query("m7_auc", sql("candidates", """WITH r AS (SELECT domain, after > 30 AS pos, rank() OVER (PARTITION BY domain ORDER BY share) + (count(*) OVER (PARTITION BY domain, share) - 1) / 2.0::DOUBLE AS r FROM candidates WHERE share IS NOT NULL)
SELECT domain, round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc, count(*) FILTER (WHERE pos) AS pos, count(*) FILTER (WHERE NOT pos) AS neg FROM r GROUP BY domain"""))
def m7(spark, d) -> DataFrame:
    return evaluation.auc(V.candidates(spark, d).withColumn("y", F.col("after") > 30), "share", "y", "domain").withColumn("auc", F.round("auc", 6))


def floor_sql(rows: str, by: str, seed: int = 7) -> str:
    """Common tables ``areas`` (by, n, pos, auc) and ``floors`` (by, floor) of a table of by, key, y and score."""
    u = "(sum({r}) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y), 0)"
    return f"""fk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS r, row_number() OVER (PARTITION BY {by} ORDER BY key) AS i FROM {rows} WHERE score IS NOT NULL),
areas AS (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE y) AS pos, {u.format(r='r')} AS auc FROM fk GROUP BY {by}),
fd AS (SELECT {by}, t, r AS own, row_number() OVER (PARTITION BY {by}, t ORDER BY md5('{seed}:' || t || ':' || key), key) AS i FROM fk, (SELECT unnest(range(1, 201)) AS t)),
fe AS (SELECT {by}, t, {u.format(r='own')} AS a FROM fd JOIN fk USING ({by}, i) GROUP BY {by}, t),
floors AS (SELECT {by}, a AS floor FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY a, t) AS place FROM fe) WHERE place = 191)"""


@query("m8_permutation_floor", sql("candidates", f"WITH s AS (SELECT 0 AS g, key, after > 30 AS y, share AS score FROM candidates), {floor_sql('s', 'g')} SELECT round(floor, 6) AS floor FROM floors"))
def m8(spark, d) -> DataFrame:
    return evaluation.permutation_floor(V.candidates(spark, d).withColumn("y", F.col("after") > 30), "share", "y", "key").select(r6("floor"))


@query("m9_spearman", sql("candidates", """WITH r AS (SELECT domain, rank() OVER (PARTITION BY domain ORDER BY works) + (count(*) OVER (PARTITION BY domain, works) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY domain ORDER BY after) + (count(*) OVER (PARTITION BY domain, after) - 1) / 2.0::DOUBLE AS y FROM candidates)
SELECT domain, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY domain"""))
def m9(spark, d) -> DataFrame:
    return evaluation.spearman(V.candidates(spark, d), "works", "after", "domain").withColumn("rho", F.round("rho", 6))


@query("w14_average_ranks", sql("candidates", "SELECT key, rank() OVER (ORDER BY works) + (count(*) OVER (PARTITION BY works) - 1) / 2.0::DOUBLE AS r FROM candidates"))
def w14(spark, d) -> DataFrame:
    return V.candidates(spark, d).select("key", evaluation.average_rank("works").alias("r"))


@query("a17_excess", sql("candidates", """WITH v AS (SELECT *, before < 5 AS thin, ln(greatest(CASE WHEN before > 0 THEN after::DOUBLE / before WHEN after > 0 THEN 2.0 ELSE 0.0 END, 0.05::DOUBLE)) AS value FROM candidates), u AS (SELECT *, CASE WHEN NOT thin THEN value END AS used FROM v),
p AS (SELECT *, median(used) OVER (PARTITION BY domain) AS med, count(used) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY used DESC NULLS LAST, key) AS place FROM u), c AS (SELECT *, max(used) FILTER (WHERE place = greatest(n // 3, 1)) OVER (PARTITION BY domain) AS cut FROM p)
SELECT key, round(used - med, 6) AS excess, used > med AS above, used >= cut AS top FROM c"""))
def a17(spark, d) -> DataFrame:
    c = V.candidates(spark, d).withColumns({"thin": F.col("before") < 5, "ratio": evaluation.growth_ratio(F.col("before"), F.col("after"))})
    c = c.withColumn("value", F.log(F.greatest("ratio", F.lit(0.05))))
    return evaluation.excess(c, "value", "thin").select("key", r6("excess"), "above", "top")


@query("a18_growth", sql("candidates", """WITH g AS (SELECT kind, before < 5 AS thin, CASE WHEN before > 0 THEN after::DOUBLE / before WHEN after > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM candidates)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE thin) AS thin, round(median(ratio), 6) AS median_ratio, round(count(*) FILTER (WHERE ratio >= 2) / count(*)::DOUBLE, 6) AS doubled FROM g GROUP BY kind"""))
def a18(spark, d) -> DataFrame:
    c = V.candidates(spark, d).withColumns({"thin": F.col("before") < 5, "ratio": evaluation.growth_ratio(F.col("before"), F.col("after"))})
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("thin").alias("thin"), F.round(F.median("ratio"), 6).alias("median_ratio"), F.round(F.count_if(F.col("ratio") >= 2) / F.count(F.lit(1)), 6).alias("doubled"))


@query("a12_confusion", sql("candidates", """WITH c AS (SELECT domain, count(*) FILTER (WHERE after > 30 AND kind = 'emerging') AS tp, count(*) FILTER (WHERE NOT after > 30 AND kind = 'emerging') AS fp, count(*) FILTER (WHERE after > 30 AND kind <> 'emerging') AS fn, count(*) FILTER (WHERE NOT after > 30 AND kind <> 'emerging') AS tn FROM candidates GROUP BY domain)
SELECT domain, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(tn::DOUBLE / (tn + fp), 6) AS specificity FROM c"""))
def a12(spark, d) -> DataFrame:
    c = evaluation.confusion(V.candidates(spark, d).withColumns({"e": F.col("after") > 30, "g": F.col("kind") == "emerging"}), "e", "g", "domain")
    return c.select("domain", "tp", "fp", "fn", "tn", *(r6(x) for x in ("precision", "recall", "f1", "accuracy", "specificity")))


@query("m6_reliability", sql("candidates", "SELECT CAST(least(floor(share * 5), 4) AS INT) AS bin, count(*) AS n, round(avg(share), 6) AS mean_p, round(avg(CAST(after > 30 AS DOUBLE)), 6) AS share FROM candidates WHERE share IS NOT NULL GROUP BY 1"))
def m6(spark, d) -> DataFrame:
    c = V.candidates(spark, d).filter("share is not null").withColumn("y", F.col("after") > 30)
    return evaluation.reliability(c, "share", "y").select("bin", "n", r6("mean_p"), r6("share"))


@query("m18_holm", sql("candidates", """WITH p AS (SELECT domain, (count(*) FILTER (WHERE money) % 97) / 970.0::DOUBLE AS p FROM candidates GROUP BY domain)
SELECT domain, round(max(least(1.0, (5 - rn + 1) * p)) OVER (ORDER BY rn), 6) AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY p, domain) AS rn FROM p)"""))
def m18(spark, d) -> DataFrame:
    p = V.candidates(spark, d).groupBy("domain").agg(((F.count_if("money") % 97) / 970.0).alias("p"))
    return evaluation.holm(p).select("domain", r6("adjusted"))


@query("f16_wilson", sql("candidates", """WITH c AS (SELECT domain, count(*) FILTER (WHERE money)::DOUBLE AS k, count(*)::DOUBLE AS n FROM candidates GROUP BY domain)
SELECT domain, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low, round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM c"""))
def f16(spark, d) -> DataFrame:
    c = V.candidates(spark, d).groupBy("domain").agg(F.count_if("money").alias("k"), F.count(F.lit(1)).alias("n"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return c.select("domain", r6(w["low"], "low"), r6(w["high"], "high"))


@query("a20_momentum", sql("candidates", "SELECT key, round(CASE WHEN after > 0 OR before > 0 THEN (after + 1.0::DOUBLE) / (before + 1) END, 6) AS momentum FROM candidates"))
def a20(spark, d) -> DataFrame:
    return V.candidates(spark, d).select("key", r6(stats.momentum(F.col("after"), F.col("before")), "momentum"))


@query("m10_stable_features", sql("candidates", """WITH u AS (SELECT key % 3 AS cut, after > 30 AS pos, unnest(['works', 'players', 'label_works']) AS feature, unnest([works, players, label_works])::DOUBLE AS v FROM candidates),
r AS (SELECT *, rank() OVER (PARTITION BY cut, feature ORDER BY v) + (count(*) OVER (PARTITION BY cut, feature, v) - 1) / 2.0::DOUBLE AS r FROM u),
a AS (SELECT cut, feature, (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)) AS auc FROM r GROUP BY ALL)
SELECT feature, round(min(auc), 6) AS lowest, round(max(auc), 6) AS highest, (bool_and(auc > 0.5) OR bool_and(auc < 0.5)) AND max(abs(auc - 0.5)) >= 0.1 AS stable FROM a GROUP BY feature"""))
def m10(spark, d) -> DataFrame:
    c = V.candidates(spark, d).select((F.col("key") % 3).alias("cut"), (F.col("after") > 30).alias("y"), *(F.col(x).cast("double").alias(x) for x in ("works", "players", "label_works")))
    each = evaluation.auc(c.unpivot(["cut", "y"], ["works", "players", "label_works"], "feature", "v"), "v", "y", "cut", "feature")
    same = F.bool_and(F.col("auc") > 0.5) | F.bool_and(F.col("auc") < 0.5)
    return each.groupBy("feature").agg(F.round(F.min("auc"), 6).alias("lowest"), F.round(F.max("auc"), 6).alias("highest"), (same & (F.max(F.abs(F.col("auc") - 0.5)) >= 0.1)).alias("stable"))


@query("m14_top_median", sql("candidates", "SELECT domain, median(after) AS top_median, count(*) AS n FROM (SELECT domain, after, row_number() OVER (PARTITION BY domain ORDER BY works DESC, key) AS rn FROM candidates) WHERE rn <= 7 GROUP BY domain"))
def m14(spark, d) -> DataFrame:
    top = ranking.top_n(V.candidates(spark, d), 7, [F.desc("works"), F.asc("key")], "domain")
    return top.groupBy("domain").agg(F.median("after").alias("top_median"), F.count(F.lit(1)).alias("n"))


@query("m13_pu_ceiling", sql("candidates", "SELECT round(c, 6) AS c, round(u, 6) AS pi_u, round(1 - u / 2, 6) AS ceiling FROM (SELECT avg(share) FILTER (WHERE money) AS c, avg(share) FILTER (WHERE NOT money) AS u FROM candidates)"))
def m13(spark, d) -> DataFrame:
    c = V.candidates(spark, d).agg(F.avg(F.when(F.col("money"), F.col("share"))).alias("c"), F.avg(F.when(~F.col("money"), F.col("share"))).alias("u"))
    return c.select(r6("c"), r6("u", "pi_u"), r6(1 - F.col("u") / 2, "ceiling"))


@query("m17_threshold_axis", sql("candidates", """WITH g AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS t), s AS (SELECT t, avg(CAST((share >= t) = (after > 30) AS DOUBLE)) FILTER (WHERE key % 2 = 1) AS tune, avg(CAST((share >= t) = (after > 30) AS DOUBLE)) FILTER (WHERE key % 2 = 0) AS hold FROM candidates, g WHERE share IS NOT NULL GROUP BY t)
SELECT t AS threshold, round(tune, 6) AS tune, round(hold, 6) AS hold FROM s ORDER BY s.tune DESC, t LIMIT 1"""))
def m17(spark, d) -> DataFrame:
    c = V.candidates(spark, d).filter("share is not null").withColumn("t", F.explode(F.array(*(F.lit(i / 20.0) for i in range(1, 20)))))
    hit = ((F.col("share") >= F.col("t")) == (F.col("after") > 30)).cast("double")
    s = c.groupBy("t").agg(F.avg(F.when(F.col("key") % 2 == 1, hit)).alias("tune"), F.avg(F.when(F.col("key") % 2 == 0, hit)).alias("hold"))
    return s.orderBy(F.desc("tune"), "t").limit(1).select(F.col("t").alias("threshold"), r6("tune"), r6("hold"))


# --- annotations and works


@query("j1_untagged", sql("works mentions", "SELECT id, observed_at FROM works WHERE NOT junk AND observed_at >= DATE '2019-01-01' AND id NOT IN (SELECT signal_id FROM mentions WHERE model = 'm0')"))
def j1(spark, d) -> DataFrame:
    return S.untagged(V.works(spark, d), V.mentions(spark, d), "m0", "2019-01-01").select("id", "observed_at")


@query("j2_mentions_of_works", sql("works mentions", "SELECT tech, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM mentions JOIN works ON id = signal_id WHERE tech <> '' AND NOT junk GROUP BY tech"))
def j2(spark, d) -> DataFrame:
    m = V.mentions(spark, d).filter("tech <> ''").join(V.works(spark, d).filter("not junk").select("id"), F.col("id") == F.col("signal_id"))
    return m.groupBy("tech").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("a10_groups_by_role", sql("works mentions", "SELECT tech, count(*) FILTER (WHERE role = 'proposes') AS proposes, count(*) FILTER (WHERE role = 'uses') AS uses, count(*) FILTER (WHERE role = 'reviews') AS reviews, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM mentions JOIN works ON id = signal_id WHERE tech <> '' GROUP BY tech"))
def a10(spark, d) -> DataFrame:
    m = V.mentions(spark, d).filter("tech <> ''").join(V.works(spark, d).select("id", "observed_at"), F.col("id") == F.col("signal_id"))
    return m.groupBy("tech").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("proposes", "uses", "reviews")), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


@query("s13_idempotent_append", sql("works", "SELECT id, min(observed_at) AS observed_at FROM (SELECT id, observed_at FROM works WHERE id % 3 = 0 UNION ALL SELECT id, observed_at + 1 FROM works WHERE id % 6 = 0) WHERE id NOT IN (SELECT id FROM works WHERE id % 9 = 0) GROUP BY id"))
def s13(spark, d) -> DataFrame:
    w = V.works(spark, d).select("id", "observed_at")
    batch = w.filter("id % 3 = 0").unionByName(w.filter("id % 6 = 0").withColumn("observed_at", F.date_add("observed_at", 1)))
    return S.to_insert(batch, w.filter("id % 9 = 0"), "id", F.asc("observed_at"))


@query("s15_upsert", sql("mentions", "SELECT signal_id, model, CASE WHEN signal_id % 4 = 0 THEN '' ELSE tech END AS tech FROM mentions"))
def s15(spark, d) -> DataFrame:
    m = V.mentions(spark, d).select("signal_id", "model", "tech")
    return S.upsert(m, m.filter("signal_id % 4 = 0").withColumn("tech", F.lit("")), ["signal_id", "model"])


@query("w1_versions", sql("works", """WITH u AS (SELECT id, 'http://arxiv.org/abs/' || (id // 3) || CASE id % 3 WHEN 0 THEN '' ELSE 'v' || (id % 3) END AS url FROM works), b AS (SELECT id, regexp_replace(url, 'v[0-9]+$', '') AS base, id % 3 AS ver FROM u)
SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY ver, id) = 1 AS keep FROM b"""))
def w1(spark, d) -> DataFrame:
    w = V.works(spark, d)
    url = F.concat(F.lit("http://arxiv.org/abs/"), F.floor(F.col("id") / 3).cast("string"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))))
    return S.versions(w.select("id", url.alias("url"))).select("id", "base", "keep")


@query("s18_vector_backlog", sql("works vectors", "SELECT id, observed_at, left(term_raw, 1500) AS text FROM works WHERE id NOT IN (SELECT id FROM vectors) ORDER BY observed_at DESC, id DESC LIMIT 50"))
def s18(spark, d) -> DataFrame:
    return S.backlog(V.works(spark, d), V.vectors(spark, d), 50)


@query("o5_keyset_page", sql("works", "SELECT id, observed_at FROM works WHERE (observed_at, id) < (DATE '2021-05-05', 500) ORDER BY observed_at DESC, id DESC LIMIT 40"))
def o5(spark, d) -> DataFrame:
    return S.page(V.works(spark, d), ("2021-05-05", 500), 40).select("id", "observed_at")


@query("s25_sample")
def s25(spark, d) -> DataFrame:
    return S.sample(V.works(spark, d), 100).select("id")


@query("s17_model_guard", sql("vectors", "SELECT count(*) AS n, min(len(v)) AS size FROM vectors"))
def s17(spark, d) -> DataFrame:
    v = S.model_guard(V.vectors(spark, d).withColumn("model", F.lit("m")), "m", 64)
    return v.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("size"))


@query("j14_completeness", sql("works", """WITH e AS (SELECT date_trunc('month', observed_at)::DATE AS month, count(*) AS expected FROM works GROUP BY 1), o AS (SELECT date_trunc('month', observed_at)::DATE AS month, count(*) AS got FROM works WHERE id % 37 <> 0 AND NOT (observed_at BETWEEN DATE '2019-03-01' AND DATE '2019-03-31') GROUP BY 1),
x AS (SELECT coalesce(e.month, o.month) AS month, coalesce(expected, 0) AS expected, coalesce(got, 0) AS got FROM e FULL JOIN o USING (month)) SELECT month, expected, got, (expected - got) > 0.01::DOUBLE * expected AND month < DATE '2023-11-01' AS hole FROM x"""))
def j14(spark, d) -> DataFrame:
    w = V.works(spark, d).withColumn("month", F.to_date(F.date_trunc("month", "observed_at")))
    e = w.groupBy("month").agg(F.count(F.lit(1)).alias("expected"))
    o = w.filter("id % 37 <> 0 and not (observed_at between '2019-03-01' and '2019-03-31')").groupBy("month").agg(F.count(F.lit(1)).alias("got"))
    x = e.join(o, "month", "full").select("month", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("got", F.lit(0)).alias("got"))
    return x.withColumn("hole", (F.col("expected") - F.col("got") > 0.01 * F.col("expected")) & (F.col("month") < F.lit("2023-11-01").cast("date")))


# --- runs and reports


@query("w8_latest_report", sql("reports", "SELECT lower(query) AS query, max_by(name, (started, name)) AS name FROM reports GROUP BY 1"))
def w8(spark, d) -> DataFrame:
    return history.latest_report(V.reports(spark, d))


_PRIOR = """r AS (SELECT name, lower(query) AS q, started, list_sort(list_transform(labels, lambda x: lower(x))) AS print FROM reports), p AS (SELECT o.name, p.name AS prior, p.started AS began, row_number() OVER (PARTITION BY o.name, p.print ORDER BY p.started DESC, p.name DESC) AS rn FROM r o JOIN r p ON o.q = p.q AND p.started < o.started),
k AS (SELECT name, prior, row_number() OVER (PARTITION BY name ORDER BY began DESC, prior DESC) AS rank FROM p WHERE rn = 1), prior AS (SELECT * FROM k WHERE rank <= 5)"""


@query("w7_prior_runs", sql("reports", f"WITH {_PRIOR} SELECT name, prior, rank FROM prior"))
def w7(spark, d) -> DataFrame:
    return history.prior_runs(V.reports(spark, d)).withColumn("rank", F.col("rank").cast("long"))


_TURN = "(['federated', 'graph', 'sparse', 'quantum', 'neural'])[k % 5 + 1] || ' ' || (['Learning', 'retrieval', 'routing', 'sensing', 'planning', 'memory', 'tracing'])[k % 7 + 1] || ' ' || (['methods', 'systems', 'by design'])[k % 3 + 1]"


@query("w9_stability", sql("reports", f"""WITH {_PRIOR}, n AS (SELECT name, count(*) AS runs FROM prior GROUP BY name),
x AS (SELECT name, CAST(string_split(unnest(labels), ' ')[2] AS INT) AS k FROM reports), l0 AS (SELECT name, {_TURN} AS label FROM x),
l AS (SELECT name, label, list_distinct(list_filter(regexp_extract_all(lower(label), '[a-z0-9+#-]{{3,}}'), lambda x: NOT list_contains({text.NAME_STOP}, x))) AS w FROM l0),
h AS (SELECT l.name, l.label, count(DISTINCT prior) AS held FROM l JOIN prior USING (name) JOIN l m ON m.name = prior
  AND (lower(m.label) = lower(l.label) OR len(list_intersect(l.w, m.w)) * 2 >= len(list_distinct(list_concat(l.w, m.w)))) GROUP BY ALL)
SELECT name, runs, (SELECT count(*) FROM l JOIN h USING (name, label) WHERE l.name = n.name AND held >= ceil(runs / 2.0)) AS stable FROM n"""))
def w9(spark, d) -> DataFrame:
    """Each topic by a name of three words, so that topics are alike where they share two."""
    words = (["federated", "graph", "sparse", "quantum", "neural"], ["Learning", "retrieval", "routing", "sensing", "planning", "memory", "tracing"], ["methods", "systems", "by design"])
    named = lambda x: F.concat_ws(" ", *(F.get(text.strings(w), F.split(x, " ")[1].cast("int") % len(w)) for w in words))
    return history.stability(V.reports(spark, d).withColumn("labels", F.transform("labels", named)))


@query("w10_stage_durations", sql("job_events", "SELECT job_id, seq, round(lead(at_s) OVER (PARTITION BY job_id ORDER BY seq) - at_s, 3) AS seconds FROM job_events"))
def w10(spark, d) -> DataFrame:
    return history.stage_durations(V.job_events(spark, d)).select("job_id", "seq", F.round("seconds", 3).alias("seconds"))


_LAST = "l AS (SELECT job_id FROM job_events GROUP BY job_id ORDER BY min(ts) DESC, job_id LIMIT 20)"


@query("a11_stage_typical", sql("job_events", f"WITH {_LAST}, f AS (SELECT job_id, kind, min(at_s) AS at_s FROM job_events WHERE job_id IN (FROM l) GROUP BY ALL) SELECT kind, round(median(at_s), 4) AS typical, count(*) AS runs FROM f GROUP BY kind"))
def a11(spark, d) -> DataFrame:
    return history.stage_typical(V.job_events(spark, d)).withColumn("typical", F.round("typical", 4))


@query("t7_keep_last_runs", sql("job_events", f"WITH {_LAST} SELECT job_id, seq, kind FROM job_events WHERE job_id IN (FROM l)"))
def t7(spark, d) -> DataFrame:
    return history.keep_last_runs(V.job_events(spark, d)).select("job_id", "seq", "kind")


@query("t8_cursor_read", sql("job_events", "SELECT job_id, seq, kind FROM job_events WHERE seq > (SELECT max(seq) * 9 // 10 FROM job_events)"))
def t8(spark, d) -> DataFrame:
    e = V.table(spark, d, "events")
    mark = e.agg(F.max("event_id")).first()[0] * 9 // 10
    return e.filter(F.col("event_id") > mark).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))


@query("t9_active_limit", sql("job_events", "SELECT job_id % 20 AS client, count(DISTINCT job_id) AS active, count(DISTINCT job_id) > 3 AS over FROM job_events WHERE kind = 'error' GROUP BY 1"))
def t9(spark, d) -> DataFrame:
    e = V.job_events(spark, d).filter("kind = 'error'")
    return e.groupBy((F.col("job_id") % 20).alias("client")).agg(F.countDistinct("job_id").alias("active")).withColumn("over", F.col("active") > 3)


@query("w11_holes", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error' AND user_id = 7), g AS (SELECT day, sum(CASE WHEN prev IS NULL OR day - prev > 1 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS i FROM (SELECT day, lag(day) OVER (ORDER BY day) AS prev FROM d)),
s AS (SELECT min(day) AS a, max(day) AS b FROM g GROUP BY i), c AS (SELECT b, unnest(range(0, b - a + 1, 3)) AS o, a FROM s) SELECT CAST(a + CAST(o AS INT) AS DATE) AS first_day, CAST(least(b, a + CAST(o AS INT) + 2) AS DATE) AS last_day, CAST(least(b, a + CAST(o AS INT) + 2) - (a + CAST(o AS INT)) + 1 AS INT) AS days FROM c""")
def w11(spark, d) -> DataFrame:
    days = V.table(spark, d, "events").filter("event_type = 'error' and user_id = 7").select(F.to_date("ts").alias("day")).distinct()
    return history.holes(days, most=3)


@query("w17_queue", sql("job_events", """WITH j AS (SELECT job_id, CASE WHEN job_id % 30 = 0 THEN 'running' WHEN job_id % 3 = 0 THEN 'done' ELSE 'queued' END AS status, min(ts) AS queued_at, max(at_s) / 1000 AS elapsed FROM job_events GROUP BY job_id),
x AS (SELECT *, count(*) FILTER (WHERE status = 'queued') OVER (ORDER BY queued_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead, max(CASE WHEN status = 'running' THEN greatest(1020 - elapsed, 60) END) OVER () AS left_s FROM j)
SELECT job_id, CASE WHEN status = 'queued' THEN ahead + 1 END AS position, round(CASE WHEN status = 'queued' THEN coalesce(left_s, 0) + 1020 * ahead END, 3) AS eta FROM x"""))
def w17(spark, d) -> DataFrame:
    status = F.when(F.col("job_id") % 30 == 0, "running").when(F.col("job_id") % 3 == 0, "done").otherwise("queued")
    j = V.job_events(spark, d).groupBy("job_id").agg(F.min("ts").alias("queued_at"), (F.max("at_s") / 1000).alias("elapsed")).withColumn("status", status)
    return history.queue(j, 1020.0).select("job_id", "position", F.round("eta", 3).alias("eta"))


@query("p16_history_search", sql("reports", "SELECT name, query, count(*) OVER () AS total FROM reports WHERE contains(lower(query), 'query 1') ORDER BY started DESC, name LIMIT 20"))
def p16(spark, d) -> DataFrame:
    return history.search(V.reports(spark, d), "query 1").select("name", "query", "total")


@query("u4_overlap", sql("reports", f"""WITH {_PRIOR}, l AS (SELECT name, list_transform(labels, lambda x: lower(x)) AS s FROM reports)
SELECT p.name, p.prior, len(list_intersect(a.s, b.s)) AS common, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM prior p JOIN l a ON a.name = p.name JOIN l b ON b.name = p.prior"""))
def u4(spark, d) -> DataFrame:
    r = V.reports(spark, d)
    l = r.select("name", F.transform("labels", lambda x: F.lower(x)).alias("s"))
    both = history.prior_runs(r).join(l, "name").join(l.select(F.col("name").alias("prior"), F.col("s").alias("t")), "prior")
    return both.select("name", "prior", F.size(F.array_intersect("s", "t")).cast("long").alias("common"), r6(text.jaccard(F.col("s"), F.col("t")), "jaccard"))


@query("u8_distinct_names", sql("reports", "SELECT DISTINCT lower(unnest(labels)) AS name FROM reports"))
def u8(spark, d) -> DataFrame:
    return V.reports(spark, d).select(F.explode("labels").alias("name")).select(F.lower("name").alias("name")).distinct()


@query("s21_report_summary", sql("reports", "SELECT name, len(labels) AS signals, n_events, round(total, 4) AS total FROM reports"))
def s21(spark, d) -> DataFrame:
    return V.reports(spark, d).select("name", F.size("labels").cast("long").alias("signals"), "n_events", F.round("total", 4).alias("total"))


@query("u1_pools", sql("candidates", f"WITH {_FEATS} SELECT bucket, count(*) AS n, sum(key)::BIGINT AS keys FROM (SELECT 'top' AS bucket, key FROM o WHERE place <= 15 UNION ALL SELECT 'control', key FROM candidates WHERE kind <> 'emerging') GROUP BY bucket"))
def u1(spark, d) -> DataFrame:
    top = _scored(spark, d).filter("place <= 15").select(F.lit("top").alias("bucket"), "key")
    rest = V.candidates(spark, d).filter("kind <> 'emerging'").select(F.lit("control").alias("bucket"), "key")
    return top.unionByName(rest).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query("u2_query_plan", "WITH t AS (SELECT i, unnest(['{q} startup raises', '{q} seed funding', '{q} series A', '{q} emerges from stealth', '{q} pilot deployment']) AS tpl, q FROM (SELECT min(p_partkey) AS i, p_name AS q FROM part GROUP BY p_name)) SELECT DISTINCT lower(replace(tpl, '{q}', q)) AS query FROM t")
def u2(spark, d) -> DataFrame:
    forms = ("{q} startup raises", "{q} seed funding", "{q} series A", "{q} emerges from stealth", "{q} pilot deployment")
    p = V.table(spark, d, "part").select("p_name").distinct().withColumn("tpl", F.explode(F.array(*map(F.lit, forms))))
    return p.select(F.lower(F.replace("tpl", F.lit("{q}"), F.col("p_name"))).alias("query")).distinct()


@query("u3_id_sets", sql("works", "SELECT id FROM (SELECT id FROM works WHERE id % 2 = 0 UNION SELECT id FROM works WHERE id % 3 = 0) EXCEPT SELECT id FROM works WHERE junk"))
def u3(spark, d) -> DataFrame:
    w = V.works(spark, d)
    return w.filter("id % 2 = 0").select("id").union(w.filter("id % 3 = 0").select("id")).distinct().subtract(w.filter("junk").select("id"))


@query("u5_two_rounds", sql("candidates", "SELECT label FROM candidates WHERE money UNION ALL SELECT label FROM candidates WHERE funding AND NOT money"))
def u5(spark, d) -> DataFrame:
    c = V.candidates(spark, d)
    first, second = c.filter("money").select("label"), c.filter("funding").select("label")
    return first.unionByName(second.join(first, "label", "left_anti"))


@query("u6_only_in_pool", sql("candidates", f"WITH {_FEATS} SELECT label FROM candidates EXCEPT SELECT label FROM o WHERE place <= 15"))
def u6(spark, d) -> DataFrame:
    return V.candidates(spark, d).select("label").subtract(_scored(spark, d).filter("place <= 15").select("label"))


@query("a8_counts_by_bucket", sql("candidates", "SELECT domain, kind, money, count(*) AS n FROM candidates GROUP BY ALL"))
def a8(spark, d) -> DataFrame:
    return V.candidates(spark, d).groupBy("domain", "kind", "money").agg(F.count(F.lit(1)).alias("n"))


@query("a36_progress", sql("works vectors", "SELECT count(*) AS works, count(v.id) AS done, min(w.observed_at) FILTER (WHERE v.id IS NOT NULL) AS oldest, max(w.observed_at) FILTER (WHERE v.id IS NOT NULL) AS newest FROM works w LEFT JOIN vectors v USING (id)"))
def a36(spark, d) -> DataFrame:
    b = V.works(spark, d).select("id", "observed_at").join(V.vectors(spark, d).select(F.col("id").alias("vid")), F.col("id") == F.col("vid"), "left")
    has = F.when(F.col("vid").isNotNull(), F.col("observed_at"))
    return b.agg(F.count(F.lit(1)).alias("works"), F.count("vid").alias("done"), F.min(has).alias("oldest"), F.max(has).alias("newest"))


@query("a26_quartiles", sql("candidates", """WITH s AS (SELECT 'training' AS side, share, works::DOUBLE AS works FROM candidates WHERE kind = 'emerging' AND before >= 3 UNION ALL SELECT 'serving', share, works::DOUBLE FROM candidates),
u AS (SELECT side, unnest(['share', 'works']) AS feature, unnest([share, works]) AS v FROM s)
SELECT side, feature, count(v) AS n, count(*) - count(v) AS missing, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3 FROM u GROUP BY side, feature"""))
def a26(spark, d) -> DataFrame:
    """Quartiles and missing values of what the model is trained on against what it serves."""
    c = V.candidates(spark, d)
    got = evaluation.skew({"training": c.filter("kind = 'emerging' and before >= 3"), "serving": c}, ["share", "works"])
    return got.select("side", "feature", "n", "missing", *(r6(f"q{i}") for i in (1, 2, 3)))


@query("a25_place_floor", sql("candidates", f"WITH {_FEATS} SELECT query_id, count(*) AS pool, round(least(15.0::DOUBLE / count(*), 1), 6) AS floor, min(place) FILTER (WHERE key % 7 = 0) AS best_place FROM o GROUP BY query_id"))
def a25(spark, d) -> DataFrame:
    return _scored(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"), F.round(F.least(F.lit(15.0) / F.count(F.lit(1)), F.lit(1.0)), 6).alias("floor"), F.min(F.when(F.col("key") % 7 == 0, F.col("place"))).cast("long").alias("best_place"))


@query("a27_confidence_by_layer", sql("candidates", f"WITH {_FEATS}, {_LAYER} SELECT layer, round(min(confidence), 6) AS low, round(max(confidence), 6) AS high, count(*) FILTER (WHERE confidence > 0.75) AS sure FROM l GROUP BY layer"))
def a27(spark, d) -> DataFrame:
    return _layered(spark, d).groupBy("layer").agg(F.round(F.min("confidence"), 6).alias("low"), F.round(F.max("confidence"), 6).alias("high"), F.count_if(F.col("confidence") > 0.75).alias("sure"))


@query("a29_forecast", sql("job_events", "SELECT job_id % 10 AS stream, count(*) AS done, 2000 - count(*) AS left_n, round((2000 - count(*)) / (count(*) / max(at_s)), 3) AS seconds_left FROM job_events GROUP BY 1"))
def a29(spark, d) -> DataFrame:
    g = V.job_events(spark, d).groupBy((F.col("job_id") % 10).alias("stream")).agg(F.count(F.lit(1)).alias("done"), F.max("at_s").alias("at"))
    return g.select("stream", "done", (2000 - F.col("done")).alias("left_n"), F.round((2000 - F.col("done")) / (F.col("done") / F.col("at")), 3).alias("seconds_left"))


@query("a30_query_coverage", sql("job_events", "SELECT job_id, count(*) AS asked, count(*) FILTER (WHERE kind = 'error') AS failed, CASE WHEN count(*) FILTER (WHERE kind = 'error') = 0 THEN 'complete' WHEN 2 * count(*) FILTER (WHERE kind = 'error') >= count(*) THEN 'none' ELSE 'partial' END AS coverage FROM job_events GROUP BY job_id"))
def a30(spark, d) -> DataFrame:
    g = V.job_events(spark, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("kind") == "error").alias("failed"))
    return g.withColumn("coverage", F.when(F.col("failed") == 0, "complete").when(2 * F.col("failed") >= F.col("asked"), "none").otherwise("partial"))


@query("a34_run_summary", sql("candidates", f"WITH {_FEATS} SELECT query_id, count(*) AS top, round(avg(CAST(money AS DOUBLE)), 6) AS money_share, count(DISTINCT round(confidence, 6)) AS confidences, median(players) AS players FROM o WHERE place <= 15 GROUP BY query_id"))
def a34(spark, d) -> DataFrame:
    t = _scored(spark, d).filter("place <= 15")
    return t.groupBy("query_id").agg(F.count(F.lit(1)).alias("top"), F.round(F.avg(F.col("money").cast("double")), 6).alias("money_share"), F.countDistinct(F.round("confidence", 6)).alias("confidences"), F.median("players").alias("players"))
