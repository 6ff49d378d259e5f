"""How often and since when a corpus names something, always as of a date.

``scan`` is the definition: each name against each text. ``footprint`` gives the same by postings: of a persisted index
(``Postings``), for repeated questions, or of works read for this once, whose tokens are joined with the names' tokens, so
that a name meets the works that hold its first token, and only those.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions.text import SHORT_CORE, core_matches, loose_tokens, loose_words, padded, tokens
from sondera.lineage import cut, small
from sondera.operators.postings import Postings


def visible(works: DataFrame | Postings, as_of: str) -> DataFrame | Postings:
    """Works with content that were out by the date."""
    return works.filter((F.col("observed_at") <= F.lit(as_of).cast("date")) & ~F.col("junk"))


def slice_filter(works: DataFrame, as_of: str, always: tuple = ("arxiv",)) -> DataFrame:
    """Works of the sources that always count, and of the fields whose first work is not after the date."""
    begun = works.groupBy("field").agg(F.min("observed_at").alias("first")).filter(F.col("first") <= F.lit(as_of).cast("date")).select("field")
    return works.filter(F.col("source").isin(*always)).unionByName(works.filter(~F.col("source").isin(*always)).join(begun, "field", "left_semi").select(works.columns))


def measures(as_of: str, days: int = 365) -> list[Column]:
    day = F.col("observed_at")
    dated = ~((F.month(day) == 1) & (F.dayofmonth(day) == 1))  # 1 January stands for an unknown date
    return [
        F.count(F.lit(1)).alias("works"),
        F.min(F.when(dated, F.year(day))).alias("first_year"),
        F.count_if(day >= F.date_sub(F.lit(as_of).cast("date"), days)).alias("last_year_works"),
    ]


def scan(works: DataFrame, names: DataFrame, as_of: str) -> DataFrame:
    """(name, works, first_year, last_year_works) by trying every name on every text: for few names."""
    return names.join(visible(works, as_of), core_matches(F.col("tok"), F.col("name"))).groupBy("name").agg(*measures(as_of))


def core_postings(works: DataFrame | Postings, names: DataFrame) -> DataFrame:
    """(name, id, observed_at): distinct works that name a core, of an index or joined on tokens.

    Without an index the works are read once for names of one token and once for longer ones. Few names are looked up in
    a broadcast, and only what matches is shuffled.
    """
    if isinstance(works, Postings):
        return works.core_works(names).select("name", "id", "observed_at")
    want = names.select("name").distinct().withColumn("w", tokens("name")).filter(F.size("w") > 0)
    short = (F.length(F.trim("name")) < SHORT_CORE) & (F.size("w") == 1)
    want = cut(want.select("name", "w", short.alias("short"), (F.size("w") == 1).alias("single"), F.get("w", F.lit(0)).alias("first")))
    held = works.select("id", "observed_at", tokens("term_raw").alias("t"))
    long_names = want.filter(~F.col("single"))
    most = long_names.agg(F.max(F.size("w"))).first()[0] or 1
    found = held.select(F.lit("").alias("name"), "id", "observed_at").limit(0)
    single = want.filter("single")
    sizes = {(r["short"], r["n"]) for r in single.select("short", F.length("first").alias("n")).distinct().collect()}
    if sizes:  # names of one token: a token has a key for each length of a name that it may begin with
        each = held.select("id", "observed_at", F.explode(F.array_distinct("t")).alias("token"))
        keys = [F.when(F.length("token") >= n, F.concat(F.lit("p "), F.substring("token", 1, n))) for n in sorted(n for is_short, n in sizes if not is_short)]
        if any(is_short for is_short, _ in sizes):
            keys.append(F.concat(F.lit("w "), "token"))
        own = F.when(F.col("short"), F.array(F.concat(F.lit("w "), "first"), F.concat(F.lit("w "), "first", F.lit("s")))).otherwise(F.array(F.concat(F.lit("p "), "first")))
        ways = single.select("name", F.explode(own).alias("key"))
        each = each.select("id", "observed_at", F.explode(F.array(*keys)).alias("key")).filter("key is not null")
        found = each.join(small(ways), "key").select("name", "id", "observed_at")
    if most > 1:  # names of several tokens: places where their first token and the next one's first letter stand, then the rest from there
        parts = [F.get("w", F.lit(k)).alias(f"x{k}") for k in range(1, most)]
        begun = long_names.select("name", "first", F.size("w").alias("n"), *parts).withColumn("letter", F.substring("x1", 1, 1))
        places = [F.slice("t", k + 1, F.greatest(F.size("t"), F.lit(1))).alias(f"w{k}") for k in range(most)]
        ahead = held.select("id", "observed_at", F.inline(F.arrays_zip(*places))).filter("w1 is not null")
        ahead = ahead.withColumnRenamed("w0", "first").withColumn("letter", F.substring("w1", 1, 1))
        fits = [(F.col("n") <= k) | F.when(F.col("n") == k + 1, F.startswith(f"w{k}", f"x{k}")).otherwise(F.col(f"w{k}") == F.col(f"x{k}")) for k in range(1, most)]
        found = found.unionByName(ahead.join(small(begun), ["first", "letter"]).filter(reduce(and_, fits)).select("name", "id", "observed_at"))
    return found.distinct()


def footprint(works: DataFrame | Postings, names: DataFrame, as_of: str) -> DataFrame:
    """As ``scan``, by postings. Names without a work have no row."""
    return core_postings(visible(works, as_of), names).groupBy("name").agg(*measures(as_of))


def label_footprint(works: DataFrame | Postings, labels: DataFrame, as_of: str) -> DataFrame:
    """Footprint of labels (column ``name``) of two words or more: works that hold all their words, in any order.

    A label meets the works of its rarest word only; there its other words are looked up.
    """
    if isinstance(works, Postings):
        return visible(works, as_of).label_works(labels).groupBy("name").agg(*measures(as_of))
    held = visible(works, as_of).select("id", "observed_at", F.explode(F.array_distinct(tokens("term_raw"))).alias("token"))
    want = cut(labels.select("name").distinct().filter(F.size(loose_words("name")) > 1).select("name", F.explode(F.array_distinct(loose_tokens(F.col("name")))).alias("word")))
    n_words = want.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    words = want.select("word").distinct()
    sizes = sorted(r[0] for r in words.filter(F.length("word") > 2).select(F.length("word")).distinct().collect())
    ways = F.array_compact(F.array(*(F.when(F.length("token") >= n, F.substring("token", 1, n)) for n in sizes))) if sizes else F.array().cast("array<string>")
    vocabulary = cut(held.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    by_prefix = vocabulary.select("token", F.explode(ways).alias("word")).join(small(words), "word")
    whole = words.filter(F.length("word") <= 2).select(F.explode(F.array("word", F.concat("word", F.lit("s")))).alias("token"), "word")
    ways_to = small(cut(by_prefix.select("token", "word").unionByName(whole)))
    frequency = vocabulary.join(ways_to, "token").groupBy("word").agg(F.sum("df").alias("df"))
    # a label without a work for one of its words has none at all; of the others the rarest word leads to the works
    ranked = want.join(frequency, "word").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("ws")).join(n_words, "name").filter(F.size("ws") == F.col("n"))
    led = small(cut(ranked.select("name", F.col("ws.word").alias("ws"), F.col("ws")[0]["word"].alias("word"))))
    # a work's rows lie in one task, so they become one row there, before the shuffle
    of_work = held.join(ways_to, "token").groupBy("id", "observed_at").agg(F.collect_set("word").alias("has"))
    near = of_work.select("*", F.explode("has").alias("word")).join(led, "word")
    full = near.filter(F.forall("ws", lambda w: F.array_contains("has", w)))
    return full.groupBy("name").agg(*measures(as_of))


def grown(works: DataFrame | Postings, names: DataFrame, cut: str, horizons: tuple = (90, 180, 365, 730)) -> DataFrame:
    """Works of each name in (cut, cut + h] for every horizon in days, in one pass; 1 January dates don't count."""
    day, at = F.col("observed_at"), F.lit(cut).cast("date")
    dated = ~((F.month(day) == 1) & (F.dayofmonth(day) == 1))
    cols = [F.count_if(dated & (day > at) & (day <= F.date_add(at, h))).alias(f"h{h}") for h in horizons]
    return core_postings(works.filter(~F.col("junk")), names).groupBy("name").agg(*cols)


def at_dates(works: DataFrame | Postings, names: DataFrame, dates: dict[str, str]) -> DataFrame:
    """Works of each name up to each date, side by side: a column for each key of ``dates``."""
    cols = [F.count_if(F.col("observed_at") <= F.lit(d).cast("date")).alias(k) for k, d in dates.items()]
    return core_postings(works.filter(~F.col("junk")), names).groupBy("name").agg(*cols)


def dated_facets(facets: DataFrame, prints: DataFrame, bursts: DataFrame, n: int = 6, least: int = 3) -> DataFrame:
    """(query, facet, place) of ``facets`` (query, facet, place) that had ``least`` works at the cut, in their order.

    ``prints`` (facet, works) is a footprint at the cut. A facet below that was named with knowledge of what came later.
    Where fewer than ``n`` are left, ``bursts`` (query, facet, place) that are not among them fill up, in their order.
    """
    order = W.partitionBy("query").orderBy("place", "facet")
    kept = facets.join(prints.filter(F.col("works") >= least).select("facet"), "facet").select("query", "facet", F.row_number().over(order).alias("place"))
    more = bursts.join(kept.select("query", "facet"), ["query", "facet"], "left_anti").withColumn("place", F.row_number().over(order))
    more = more.filter(F.col("place") <= n).join(kept.groupBy("query").agg(F.count(F.lit(1)).alias("_n")), "query", "left")
    more = more.withColumn("place", F.col("place") + F.coalesce("_n", F.lit(0))).filter(F.col("place") <= n)
    return kept.unionByName(more.select("query", "facet", "place"))


def patent_activity(patents: DataFrame | Postings, phrases: DataFrame, as_of: str, days: int = 730, newest: int = 3) -> DataFrame:
    """(name, recent, before, newest ids): documents of the last ``days`` and of as many before; asked but not found is 0."""
    day, at = F.col("observed_at"), F.lit(as_of).cast("date")
    place = F.row_number().over(W.partitionBy("name").orderBy(F.desc("observed_at"), "id"))
    hits = cut(core_postings(patents.filter(day <= at), phrases))
    found = hits.groupBy("name").agg(
        F.count_if(day > F.date_sub(at, days)).alias("recent"),
        F.count_if((day <= F.date_sub(at, days)) & (day > F.date_sub(at, 2 * days))).alias("before"),
    )
    first = hits.withColumn("place", place).filter(F.col("place") <= newest)  # cut before anything is collected
    first = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("newest"))
    found = found.join(first, "name")
    asked = phrases.select("name").distinct().join(found, "name", "left")
    return asked.select("name", F.coalesce("recent", F.lit(0)).alias("recent"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("newest", F.array().cast("array<bigint>")).alias("newest"))


__all__ = ["at_dates", "core_postings", "footprint", "grown", "label_footprint", "padded", "patent_activity", "scan", "slice_filter", "visible"]
