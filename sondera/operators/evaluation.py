"""Outcomes, ranks, AUC, intervals and comparisons of backtests."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.lineage import cut, small

#: Outcomes in a row of labels, and rows that share a slice of a shuffle's digests, about.
PAGE = 8192


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 in which ties share the mean."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / F.lit(2.0)


def value_ranks(rows: DataFrame, value: str, *more: Column) -> DataFrame:
    """(value, n, before, rank, and ``more`` aggregates): each distinct value, its rows, those below, its mean rank from 1.

    Exact, without a window over everything: values are counted, dealt to tasks by ranges whose borders Spark samples,
    and summed up within each; the sums of the ranges before, one number a task, are then added. A value is one row, so
    ties lie in one range.
    """
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), *more)
    ranged = cut(counted.repartitionByRange(value).withColumn("_task", F.spark_partition_id()))
    sums = sorted(ranged.groupBy("_task").agg(F.min(value).alias("least"), F.sum("n").alias("n")).collect(), key=lambda r: r["least"])
    begins, at = {}, 0
    for r in sums:
        begins[r["_task"]], at = at, at + r["n"]
    w = W.partitionBy("_task").orderBy(value)
    begin = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in begins.items() for x in pair)), F.col("_task").cast("long")) if begins else F.lit(0).cast("long")
    out = ranged.withColumn("before", begin + F.sum("n").over(w) - F.col("n"))
    return out.withColumn("rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)).drop("_task")


def auc(rows: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """(by, auc, pos, neg): Mann-Whitney; ties count half; null where one side is empty."""
    own = rows.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    if not by:
        ranked = value_ranks(own, score, F.count_if(F.col(positive)).alias("_pos"))
        pos, neg, of_pos = F.coalesce(F.sum("_pos"), F.lit(0)), F.coalesce(F.sum(F.col("n") - F.col("_pos")), F.lit(0)), F.sum(F.col("rank") * F.col("_pos"))
    else:
        ranked = own.withColumn("_r", average_rank(score, *by))
        pos, neg, of_pos = F.count_if(F.col(positive)), F.count_if(~F.col(positive)), F.sum(F.when(F.col(positive), F.col("_r")))
    u = of_pos - pos * (pos + 1) / F.lit(2.0)
    return ranked.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), u / (pos * neg)).alias("auc"), pos.alias("pos"), neg.alias("neg"))


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    own = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if by:
        ranked = own.withColumns({"_x": average_rank(x, *by), "_y": average_rank(y, *by)})
    else:  # equal pairs count together, then each side's rank is looked up by its value
        pairs = cut(own.groupBy(F.col(x).alias("_vx"), F.col(y).alias("_vy")).agg(F.count(F.lit(1)).alias("_n")))
        rank_x = value_ranks(own.select(F.col(x).alias("_vx")), "_vx").select("_vx", F.col("rank").alias("_x"))
        rank_y = value_ranks(own.select(F.col(y).alias("_vy")), "_vy").select("_vy", F.col("rank").alias("_y"))
        ranked = pairs.join(rank_x, "_vx").join(rank_y, "_vy")
        n = F.sum("_n")
        over = lambda c: F.sum(F.col("_n") * c)
        a, b = F.col("_x"), F.col("_y")
        sums = ranked.agg(n.alias("n"), (over(a) / n).alias("mx"), (over(b) / n).alias("my"))
        centred = ranked.join(F.broadcast(sums), F.lit(True)).withColumns({"_x": a - F.col("mx"), "_y": b - F.col("my")})  # sums is one row
        rho = over(a * b) / F.sqrt(over(a * a) * over(b * b))
        return centred.agg(F.when(over(a * a) * over(b * b) > 0, rho).alias("rho"), F.coalesce(n, F.lit(0)).alias("n"))
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def permutation_floor(rows: DataFrame, score: str, positive: str, key: str, *by: str, shuffles: int = 200, share: float = 0.95, seed: int = 7) -> DataFrame:
    """(by, floor): the AUC at place ``int(share * shuffles)`` of as many AUCs of outcomes shuffled by a seeded digest.

    The ranks of the scores stay; a shuffle deals the outcomes to other rows, in the order of the digest of seed, its number
    and the row's key. Null where one side is empty.

    A shuffle's rows are dealt to slices of the digests and ordered within these; a slice begins where the counts of those
    before it end. Outcomes lie in pages of ``PAGE``, so no task holds one group's all.
    """
    own = rows.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*by, F.col(score).alias("_s"), F.col(positive).alias("_y"), F.col(key).alias("_k"))
    own = cut(own)
    place = lambda c: F.struct(*by, c)
    ranked = _within(value_ranks(own.select(place("_s").alias("_at")), "_at"), by)
    ranked = ranked.select(*(F.col("_at")[b].alias(b) for b in by), F.col("_at")["_s"].alias("_s"), (F.col("rank") - F.col("_first")).alias("_r"))
    order = _within(value_ranks(own.select(place("_k").alias("_at"), "_y"), "_at", F.collect_list("_y").alias("_ys")), by)
    labels = order.select(*(F.col("_at")[b].alias(b) for b in by), F.posexplode("_ys").alias("_j", "_y"), (F.col("before") - F.col("_first")).alias("_i"))
    labels = labels.select(*by, (F.col("_i") + F.col("_j")).alias("_i"), "_y")
    pages = labels.groupBy(*by, F.floor(F.col("_i") / PAGE).alias("_page")).agg(F.array_sort(F.collect_list(F.struct("_i", "_y"))).alias("_ys"))
    pages = cut(pages.select(*by, "_page", F.array_join(F.transform("_ys", lambda x: F.when(x["_y"], "1").otherwise("0")), "").cast("binary").alias("_ys")))
    totals = cut(own.groupBy(*by).agg(F.count_if("_y").alias("_pos"), F.count_if(~F.col("_y")).alias("_neg")))
    largest, n = (x or 1 for x in totals.agg(F.max(F.col("_pos") + F.col("_neg")), F.sum(F.col("_pos") + F.col("_neg"))).first())
    digits = next(d for d in range(33) if PAGE << 4 * d >= largest)  # so many hex digits name a slice
    # few rows become many: they are dealt out to all cores first, in a number that is not made less
    parts = max(own.sparkSession.sparkContext.defaultParallelism, -(-n * shuffles // 2_000_000))
    ranked = cut(own.select(*by, "_s", "_k").join(small(ranked), [*by, "_s"]).select(*by, "_k", "_r").repartition(parts))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_t").cast("string"), F.col("_k").cast("string")))
    tries = ranked.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(shuffles)))).withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, digits))
    sizes = tries.groupBy(*by, "_t", "_b").agg(F.count(F.lit(1)).alias("_n"))
    begin = F.sum("_n").over(W.partitionBy(*by, "_t").orderBy("_b")) - F.col("_n")
    begins = cut(sizes.withColumn("_begin", begin).drop("_n"))
    dealt = tries.withColumn("_d", F.unhex("_d")).withColumn("_at", F.row_number().over(W.partitionBy(*by, "_t", "_b").orderBy("_d", "_k")) - 1)
    dealt = dealt.join(small(begins), [*by, "_t", "_b"]).withColumn("_i", F.col("_begin") + F.col("_at")).withColumn("_page", F.floor(F.col("_i") / PAGE))
    dealt = dealt.join(small(pages, 1000), [*by, "_page"])
    won = F.substr("_ys", (F.col("_i") % PAGE + 1).cast("int"), F.lit(1)) == F.lit(b"1")
    sums = dealt.groupBy(*by, "_t").agg(F.sum(F.when(won, F.col("_r"))).alias("_u"))
    pos, neg = F.col("_pos"), F.col("_neg")
    each = sums.join(F.broadcast(totals), list(by)) if by else sums.join(F.broadcast(totals), F.lit(True))  # one row a group
    each = each.select(*by, F.when((pos > 0) & (neg > 0), (F.col("_u") - pos * (pos + 1) / F.lit(2.0)) / (pos * neg)).alias("auc"))
    place = F.element_at(F.array_sort(F.collect_list("auc")), int(share * shuffles) + 1)
    return each.groupBy(*by).agg(F.when(F.count("auc") == shuffles, place).alias("floor"))


def _within(places: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``value_ranks`` of structs _at that begin with ``by``, with the rows before the group as ``_first``."""
    if not by:
        return places.withColumn("_first", F.lit(0))
    places = cut(places)
    first = places.groupBy(*(F.col("_at")[b].alias(f"_by_{b}") for b in by)).agg(F.min("before").alias("_first"))
    same = [F.col("_at")[b].eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return places.join(small(first), same).drop(*(f"_by_{b}" for b in by))


def agreement(a: DataFrame, b: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """How far two measures (key, works, first_year, last_year_works) of the same names agree, in one row.

    Rank correlations of works and of last year's works, where a name that one of them hasn't got has none; among names
    that both have the share of equal first years and the median of b's works to a's; names that only one has. Passed
    where correlation and share reach ``least``.
    """
    named = lambda rows, p: rows.select(key, *(F.col(c).alias(f"{p}_{c}") for c in ("works", "first_year", "last_year_works")))
    none = dict.fromkeys(("a_works", "b_works", "a_last_year_works", "b_last_year_works"), 0)
    pairs = cut(named(a, "a").join(named(b, "b"), key, "full").fillna(none))
    has_a, has_b = F.col("a_works") > 0, F.col("b_works") > 0
    both = has_a & has_b
    same = F.count_if(both & F.col("a_first_year").eqNullSafe(F.col("b_first_year"))) / F.count_if(both)
    sums = pairs.agg(
        same.alias("same_year"), F.median(F.when(both, F.col("b_works") / F.col("a_works"))).alias("median_ratio"), F.count_if(both).alias("both"),
        F.count_if(has_a & ~has_b).alias("only_a"), F.count_if(has_b & ~has_a).alias("only_b"),
    )
    rho = spearman(pairs, "a_works", "b_works")
    last = spearman(pairs, "a_last_year_works", "b_last_year_works").select(F.col("rho").alias("rho_last_year"))
    out = rho.join(last, F.lit(True)).join(sums, F.lit(True))  # one row each
    return out.withColumn("passed", (F.col("rho") >= least) & (F.col("same_year") >= least))


def ladder(rows: DataFrame, scorers: dict[str, Column], longest: str, name: str = "name") -> DataFrame:
    """(horizon, scorer, n, pos, growing, rho, auc, floor, reached) of ``rows`` (name, horizon, v, excess, top)."""
    rows = cut(rows)
    far = rows.filter(F.col("horizon") == longest).select(name, F.col("excess").alias("_far"))
    rho = spearman(rows.join(far, name), "excess", "_far", "horizon").select("horizon", "rho")
    growing = rows.groupBy("horizon").agg((F.count_if(F.col("v") > 0) / F.count(F.lit(1))).alias("growing"))
    scored = rows.select("horizon", name, "top", *(c.cast("double").alias(k) for k, c in scorers.items())).unpivot(["horizon", name, "top"], list(scorers), "scorer", "score")
    area = auc(scored, "score", "top", "horizon", "scorer").withColumn("n", F.col("pos") + F.col("neg"))
    out = area.join(permutation_floor(scored, "score", "top", name, "horizon", "scorer"), ["horizon", "scorer"]).join(rho, "horizon").join(growing, "horizon")
    return out.withColumn("reached", F.round("auc", 9) >= F.round("floor", 9))


def skew(sides: dict[str, DataFrame], features: list[str]) -> DataFrame:
    """(side, feature, n, missing, q1, q2, q3): the same features of several sets of rows, as of training and serving."""
    out = None
    for side, rows in sides.items():
        each = rows.select(*(F.col(f).cast("double").alias(f) for f in features)).unpivot([], features, "feature", "v")
        found = each.groupBy(F.lit(side).alias("side"), "feature").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.percentile("v", [0.25, 0.5, 0.75]).alias("q"))
        out = found if out is None else out.unionByName(found)
    return out.select("side", "feature", "n", "missing", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)))


def growth_ratio(before: Column, after: Column) -> Column:
    """after / before; from nothing: 2 if there is any, else 0."""
    return F.when(before > 0, after / before).when(after > 0, 2.0).otherwise(0.0)


def excess(rows: DataFrame, value: str, thin: str | None = None, above_zero: bool = False, by: str = "domain") -> DataFrame:
    """``rows`` with excess over the domain's median, above (the median) and top (upper third); thin rows have none of it."""
    fit = F.lit(True) if thin is None else ~F.col(thin)
    used = F.when(fit, F.col(value))
    out = rows.withColumn("_v", used)
    w = W.partitionBy(by)
    n = F.count("_v").over(w)
    place = F.row_number().over(W.partitionBy(by).orderBy(F.col("_v").desc_nulls_last()))
    out = out.withColumns({"_n": n, "_place": place, "_med": F.median("_v").over(w)})
    cutoff = F.max(F.when(F.col("_place") == F.greatest(F.floor(F.col("_n") / 3), F.lit(1)), F.col("_v"))).over(w)
    top = (F.col("_v") >= F.col("_cut")) & (F.col("_v") > 0 if above_zero else F.lit(True))
    out = out.withColumn("_cut", cutoff)
    return out.withColumns({"excess": F.col("_v") - F.col("_med"), "above": F.col("_v") > F.col("_med"), "top": top}).drop("_v", "_n", "_place", "_med", "_cut")


def confusion(rows: DataFrame, expected: str, got: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy, specificity; a share of nothing is null."""
    e, g = F.col(expected), F.col(got)
    out = rows.groupBy(*by).agg(F.count_if(e & g).alias("tp"), F.count_if(~e & g).alias("fp"), F.count_if(e & ~g).alias("fn"), F.count_if(~e & ~g).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns(
        {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": share(tp + tn, tp + fp + fn + tn), "specificity": share(tn, tn + fp)}
    )


def reliability(rows: DataFrame, probability: str, outcome: str, bins: int = 5) -> DataFrame:
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_p"), F.avg(F.col(outcome).cast("double")).alias("share"))


def holm(rows: DataFrame, p: str = "p") -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - i + 1) p, at most 1. Over a table of tests, which is small."""
    w = W.orderBy(p, *[c for c in rows.columns if c != p])
    m = F.count(F.lit(1)).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    step = rows.withColumn("_s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return step.withColumn("adjusted", F.max("_s").over(w)).drop("_s")


def platt(rows: DataFrame, margin: str, outcome: str, tol: float = 1e-10, most: int = 200) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), of greatest likelihood; rows without a margin or an outcome don't count."""
    own = rows.filter(F.col(margin).isNotNull() & F.col(outcome).isNotNull())
    own = own.select(array_to_vector(F.array(F.col(margin).cast("double"))).alias("features"), F.col(outcome).cast("double").alias("label"))
    fitted = LogisticRegression(regParam=0.0, tol=tol, maxIter=most).fit(own)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def t_two_sided(t: Column, df: Column) -> Column:
    """Chance of a Student t of ``df`` (whole) degrees of freedom as far from zero: a finite sum in the angle."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    sine, square = F.sin(angle), F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    # 1 + (1/2) c2 + (1*3)/(2*4) c2^2 ... for even degrees; cos * (1 + (2/3) c2 + ...) for odd ones above 1
    steps = F.when(odd, F.floor((df - 3) / 2)).otherwise(F.floor((df - 2) / 2)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * square * F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        return F.struct(term.alias("term"), (acc["all"] + term).alias("all"))

    places = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(places, start, add, lambda acc: acc["all"])
    inside = F.when(df == 1, 2 * angle / math.pi).when(odd, 2 / math.pi * (angle + sine * F.cos(angle) * series)).otherwise(sine * series)
    return F.greatest(F.lit(0.0), 1 - inside)


def corrected_t(folds: DataFrame, difference: str, n_train: Column, n_test: Column, *by: str) -> DataFrame:
    """(by, folds, t, p) of differences by resampled fold: their variance grows by n_test / n_train for shared training rows.

    Equal differences have no variance: t is infinite (0 where they are zero), p is 0 (1).
    """
    k, mean, var = F.count(difference), F.avg(difference), F.var_samp(difference)
    out = folds.groupBy(*by).agg(k.alias("folds"), mean.alias("_m"), var.alias("_v"), F.avg(n_test / n_train).alias("_r"))
    t = F.when(F.col("_v") > 0, F.col("_m") / F.sqrt(F.col("_v") * (1 / F.col("folds") + F.col("_r"))))
    flat = F.when(F.col("_m") > 0, float("inf")).when(F.col("_m") < 0, float("-inf")).otherwise(0.0)
    out = out.withColumn("t", F.when(F.col("folds") > 1, F.coalesce(t, flat)))
    p = F.when(F.col("_v") > 0, t_two_sided(F.col("t"), F.col("folds") - 1)).otherwise(F.when(F.col("_m") == 0, 1.0).otherwise(0.0))
    return out.withColumn("p", F.when(F.col("folds") > 1, p)).select(*by, "folds", "t", "p")


def _log_factorial(n: Column) -> Column:
    """Stirling's series at n + 10, brought back down: good to some 1e-12."""
    x = n.cast("double") + 10
    up = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return up - sum((F.log(n.cast("double") + k) for k in range(1, 11)), F.lit(0.0))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact chance of a fair coin's k of n or anything as far out. From the nearer side down, terms fall like a bell:

    beyond 12 root(n) of them nothing is left of a double.
    """
    low = F.least(k, n - k).cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(low) - _log_factorial(n - low) - n * math.log(2))
    steps = F.least(low, F.ceil(12 * F.sqrt(n.cast("double"))) + 50).cast("int")

    def add(acc: Column, i: Column) -> Column:
        at = low - i + 1  # C(n, at - 1) = C(n, at) * at / (n - at + 1)
        term = acc["term"] * at / (n - at + 1)
        return F.struct(term.alias("term"), (acc["all"] + term).alias("all"))

    places = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(places, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all")), add, lambda acc: acc["all"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * first * tail)).otherwise(1.0)


def mcnemar(rows: DataFrame, outcome: str, a: str, b: str, *by: str) -> DataFrame:
    """(by, only_a, only_b, p): rows that only one of two models has right, and the exact chance of so uneven a split."""
    right = lambda m: F.col(m) == F.col(outcome)
    out = rows.groupBy(*by).agg(F.count_if(right(a) & ~right(b)).alias("only_a"), F.count_if(~right(a) & right(b)).alias("only_b"))
    return out.withColumn("p", binomial_two_sided(F.col("only_a"), F.col("only_a") + F.col("only_b")))


def choose(models: DataFrame, score: str = "auc", sparse: str = "sparse", slack: float = 0.02) -> DataFrame:
    """The best sparse model if it comes within ``slack`` of the best dense one, else the best. ``models``: one row each."""
    rest = models.agg(F.max(F.when(~F.col(sparse), F.col(score))).alias("_top"))
    near = F.col(sparse) & (F.col(score) >= F.coalesce(F.col("_top"), F.lit(float("-inf"))) - slack)
    return models.join(F.broadcast(rest)).orderBy(near.desc(), F.desc(score), "model").limit(1).drop("_top")


#: From best to worst.
STAGES = ("top", "watch", "beyond", "excluded", "missing")


def locate(items: DataFrame, reports: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, report, cut, pool, stage, place): the best place of a target in each report, ``missing`` where it is in none.

    ``items``: report, stage, place, label; ``reports``: report, cut, and what else is carried; ``targets``: target, alias
    (lower case), any number of aliases each, with the reports that they are looked up in.
    """
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    pool = items.groupBy("report").agg(F.count(F.lit(1)).alias("pool"))
    hits = items.withColumn("alias", F.lower("label")).join(targets.select("target", "report", "alias"), ["report", "alias"])
    best = hits.groupBy("target", "report").agg(F.min(F.struct(order.alias("o"), F.coalesce("place", F.lit(0)).alias("p"), "stage", "place")).alias("x"))
    asked = targets.select("target", "report").distinct().join(reports, "report").join(pool, "report", "left").join(best, ["target", "report"], "left")
    return asked.select("target", *reports.columns, F.coalesce("pool", F.lit(0)).alias("pool"), F.coalesce("x.stage", F.lit("missing")).alias("stage"), F.col("x.place").alias("place"))


def retro(places: DataFrame, top: int = 15) -> DataFrame:
    """(n, in_top, seen, in_pool, chance): what reports said of targets, and how many a random order would put on top."""
    found = F.col("stage") != "missing"
    chance = F.sum(F.when(found & (F.col("pool") > 0), F.least(F.lit(1.0), F.lit(top) / F.col("pool"))).otherwise(0.0))
    return places.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stage") == "top").alias("in_top"), F.count_if(F.col("stage").isin("top", "watch")).alias("seen"), F.count_if(found).alias("in_pool"), chance.alias("chance"))


def lead_time(places: DataFrame, known: DataFrame) -> DataFrame:
    """(target, first_top, first_seen, lead_days): first cuts on top and on top or watched, and days until ``known.day``."""
    on = lambda *s: F.min(F.when(F.col("stage").isin(*s), F.col("cut")))
    first = places.groupBy("target").agg(on("top").alias("first_top"), on("top", "watch").alias("first_seen"))
    return first.join(known, "target", "left").select("target", "first_top", "first_seen", F.datediff("day", "first_seen").alias("lead_days"))


def report_blocks(blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """(block, key, measure, value): the result tables of an evaluation, collected in one long table."""
    out = None
    for name, rows in blocks.items():
        measures = [c for c in rows.columns if c != key]
        wide = rows.select(F.col(key).cast("string").alias("key"), *(F.col(m).cast("double").alias(m) for m in measures))
        own = wide.unpivot(["key"], measures, "measure", "value").select(F.lit(name).alias("block"), "key", "measure", "value")
        out = own if out is None else out.unionByName(own)
    return out
