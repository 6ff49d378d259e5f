"""Runs, reports and logs: what earlier runs said, how long stages take, where a collection has holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.operators.grouping import NEAR, same_direction, words_of


def folded_query(query: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))


def latest_report(reports: DataFrame) -> DataFrame:
    """(query, name): the newest report of each query; ties go to the later name."""
    return reports.groupBy(folded_query(F.col("query")).alias("query")).agg(F.max_by("name", F.struct("started", "name")).alias("name"))


def prior_runs(reports: DataFrame, most: int = 5, back: int = 32) -> DataFrame:
    """(name, prior, rank): for each report the last ``most`` different label sets of earlier runs of its query.

    The ``back`` runs before a report nearly always hold so many different sets. Only where they do not, though there
    are more runs, all earlier runs are joined.
    """
    shown = F.xxhash64(F.array_sort(F.transform("labels", lambda x: F.lower(x))))
    r = reports.select("name", folded_query(F.col("query")).alias("q"), "started", shown.alias("print"))
    # a run speaks for its labels until the next run of the same labels has begun
    r = r.withColumn("until", F.lead("started").over(W.partitionBy("q", "print").orderBy("started", "name")))
    w = W.partitionBy("q").orderBy("started", "name")
    one = F.struct("started", F.col("name").alias("prior"), "until")
    near = r.withColumns({"seen": F.collect_list(one).over(w.rowsBetween(-back, -1)), "before": F.row_number().over(w) - 1})
    speaks = lambda x: (x["started"] < F.col("started")) & (x["until"].isNull() | (x["until"] >= F.col("started")))
    near = near.withColumn("last", F.slice(F.reverse(F.filter("seen", speaks)), 1, most))
    enough = (F.size("last") == most) | (F.col("before") <= back)
    got = near.filter(enough).select("name", F.posexplode("last").alias("at", "x")).select("name", F.col("x.prior").alias("prior"), (F.col("at") + 1).alias("rank"))
    own, other = near.filter(~enough).select("name", "q", "started").alias("o"), r.alias("p")
    until = F.col("p.until").isNull() | (F.col("p.until") >= F.col("o.started"))
    pairs = own.join(other, (F.col("o.q") == F.col("p.q")) & (F.col("p.started") < F.col("o.started")) & until)
    pairs = pairs.select(F.col("o.name").alias("name"), F.col("p.name").alias("prior"), F.col("p.started").alias("t"))
    far = pairs.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("t"), F.desc("prior")))).filter(F.col("rank") <= most)
    return got.unionByName(far.select("name", "prior", "rank"))


def stability(reports: DataFrame, most: int = 5, threshold: float = NEAR) -> DataFrame:
    """(name, runs, stable): labels of a report whose direction at least half of its earlier runs held too.

    A run holds a direction if one of its labels is the label but for case, or shares ``threshold`` of the words.
    """
    # a report has few labels and earlier runs, so they are compared in its row
    said = reports.select("name", F.transform("labels", lambda x: F.struct(F.lower(F.trim(x)).alias("low"), words_of(x).alias("words"))).alias("said"))
    before = prior_runs(reports, most).select("name", "prior").join(said.select(F.col("name").alias("prior"), "said"), "prior", "left")
    before = before.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.collect_list("said").alias("held"))
    alike = lambda x, y: same_direction(x["low"], x["words"], y["low"], y["words"]) >= threshold
    holding = lambda x: F.size(F.filter("held", lambda run: F.exists(run, lambda y: F.coalesce(alike(x, y), F.lit(False)))))
    stable = F.size(F.filter(F.coalesce("said", F.array().cast(said.schema["said"].dataType)), lambda x: holding(x) >= F.ceil(F.col("runs") / 2)))
    return before.join(said, "name").select("name", "runs", stable.cast("long").alias("stable"))


def stage_durations(events: DataFrame) -> DataFrame:
    """``events`` (job_id, seq, at_s, kind) with seconds until the run's next event; null for its last."""
    return events.withColumn("seconds", F.lead("at_s").over(W.partitionBy("job_id").orderBy("seq")) - F.col("at_s"))


def stage_typical(events: DataFrame, last_runs: int = 20) -> DataFrame:
    """(kind, typical, runs): median of the first time of each kind over the last runs."""
    start = events.groupBy("job_id").agg(F.min("ts").alias("t"))
    last = start.orderBy(F.desc("t"), "job_id").limit(last_runs).select("job_id")
    first = events.join(F.broadcast(last), "job_id").groupBy("job_id", "kind").agg(F.min("at_s").alias("at_s"))
    return first.groupBy("kind").agg(F.median("at_s").alias("typical"), F.count(F.lit(1)).alias("runs"))


def keep_last_runs(events: DataFrame, last_runs: int = 20) -> DataFrame:
    """Events of the last runs only."""
    start = events.groupBy("job_id").agg(F.min("ts").alias("t"))
    last = start.orderBy(F.desc("t"), "job_id").limit(last_runs).select("job_id")
    return events.join(last, "job_id", "left_semi")


def holes(days: DataFrame, most: int = 300, touch: int = 1) -> DataFrame:
    """(first_day, last_day, days): missing days (column ``day``) merged where they touch, cut to ``most`` days each."""
    w = W.orderBy("day")
    broke = (F.datediff("day", F.lag("day").over(w)) > touch).cast("int")
    island = F.sum(F.coalesce(broke, F.lit(1))).over(w)
    span = days.withColumn("_i", island).groupBy("_i").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    starts = F.sequence("a", "b", F.expr(f"interval {most} days"))
    cut = span.select("b", F.explode(starts).alias("first_day"))
    last = F.least("b", F.date_add("first_day", most - 1))
    return cut.select("first_day", last.alias("last_day"), (F.datediff(last, "first_day") + 1).alias("days"))


def queue(jobs: DataFrame, typical: float, floor: float = 60.0) -> DataFrame:
    """``jobs`` (job_id, status, queued_at, elapsed) with position and expected seconds to start."""
    waiting = F.col("status") == "queued"
    ahead = F.count_if(waiting).over(W.orderBy("queued_at", "job_id").rowsBetween(W.unboundedPreceding, -1))
    left = F.max(F.when(F.col("status") == "running", F.greatest(F.lit(typical) - F.col("elapsed"), F.lit(floor)))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = jobs.withColumns({"position": F.when(waiting, ahead + 1), "eta": F.when(waiting, F.coalesce(left, F.lit(0.0)) + typical * ahead)})
    return out


def search(reports: DataFrame, text: str, page: int = 20, offset: int = 0) -> DataFrame:
    """A page of the reports whose query holds ``text``, whatever the case, newest first, with the number of all."""
    hit = reports.filter(F.contains(F.lower("query"), F.lit(text.lower())))
    total = F.count(F.lit(1)).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return hit.withColumn("total", total).orderBy(F.desc("started"), "name").offset(offset).limit(page)
