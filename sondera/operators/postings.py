"""A persisted positional index of works: which works hold a token, where, and since when.

Names are answered from it alone, without reading a text again. It is a folder that all executors share:

- ``postings``: token, its place in the work, the token after it, the work's id, date, source, field and junk flag; one
  row for each occurrence, in files sorted by token, under a folder for each bucket of tokens.
- ``vocabulary``: token and the number of works that hold it; each append adds its own counts.

Works are appended and never changed. A lookup reads the vocabulary for the tokens that a name may begin with, then the
buckets of its tokens only: of a name of several tokens, those of its rarest token lead, together with the token after
it, and further ones are looked up at the places where they have to stand. Conditions on date, source, field and junk are set by ``filter``, as on the works.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.text import SHORT_CORE, loose_tokens, loose_words, tokens
from sondera.lineage import exists, held, spread

ATTRIBUTES = ["id", "observed_at", "source", "field", "junk"]
#: Occurrences to a bucket when an index is made; buckets at most; tokens that a scan filter names one by one.
BUCKET_ROWS, MOST_BUCKETS, FEW = 4_000_000, 1024, 64
#: Changes when the files of an index do: a folder made before is not read.
LAYOUT = 2


class Postings:
    """The index in a folder, or its rows that meet a condition."""

    def __init__(self, spark: SparkSession, folder: str, where: Column | None = None):
        self.spark, self.folder, self.where = spark, folder.rstrip("/"), where
        self._buckets: int | None = None

    def exists(self) -> bool:
        """Whether a first append has ended."""
        return exists(self.spark, f"{self.folder}/made/_SUCCESS")

    def filter(self, condition: Column | str) -> Postings:
        """The index of the works that meet ``condition`` on their id, date, source, field or junk flag."""
        condition = F.expr(condition) if isinstance(condition, str) else condition
        return Postings(self.spark, self.folder, condition if self.where is None else self.where & condition)

    def append(self, works: DataFrame) -> None:
        """Add ``works`` (the attributes and ``term_raw``). Their ids must be new; the first append sets the buckets."""
        held = spread(works).select(*ATTRIBUTES, tokens("term_raw").alias("t"))
        df = held.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        mode = "append" if self.exists() else "overwrite"  # what a broken first append has left goes
        if mode == "overwrite":
            occurrences = held.agg(F.sum(F.size("t"))).first()[0] or 0
            cores = self.spark.sparkContext.defaultParallelism
            made = min(MOST_BUCKETS, max(cores, occurrences // BUCKET_ROWS))
            self.spark.range(1).select(F.lit(made).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/buckets")
        after = F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))
        each = held.select(*ATTRIBUTES, F.posexplode(F.arrays_zip(F.col("t").alias("token"), after.alias("after"))).alias("at", "x"))
        each = each.select(*ATTRIBUTES, "at", "x.token", "x.after")
        # rebalance deals a bucket that one token fills out to several tasks, each with its own sorted file
        each = each.withColumn("bucket", self._bucket(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "id", "at")
        each.write.mode(mode).partitionBy("bucket").parquet(f"{self.folder}/postings")
        df.sortWithinPartitions("token").write.mode(mode).parquet(f"{self.folder}/vocabulary")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/made")

    def _bucket(self, token: Column) -> Column:
        if self._buckets is None:
            self._buckets = self.spark.read.parquet(f"{self.folder}/buckets").first()[0]
        return F.pmod(F.xxhash64(token), F.lit(self._buckets)).cast("int")

    def vocabulary(self) -> DataFrame:
        """(token, df) over all appends and whatever the filter: how common a token is."""
        return self.spark.read.parquet(f"{self.folder}/vocabulary").groupBy("token").agg(F.sum("df").alias("df"))

    def postings(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/postings")
        return rows if self.where is None else rows.filter(self.where)

    def of_tokens(self, ways: DataFrame) -> DataFrame:
        """The postings of the tokens of ``ways`` (token, ...), with its other columns. Only their buckets are read."""
        ways, few = held(ways.withColumn("_bucket", self._bucket(F.col("token"))))
        rows = self.postings()
        if few is not None:
            buckets = {r["_bucket"] for r in few}
            if len(buckets) < self._buckets:
                rows = rows.filter(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
            asked = {r["token"] for r in few}
            if len(asked) <= FEW:
                rows = rows.filter(F.col("token").isin(*asked) if asked else F.lit(False))
        return rows.join(ways.drop("_bucket"), "token")

    def ways(self, words: DataFrame) -> DataFrame:
        """(word, mode, token, df): the tokens of the vocabulary that ``words`` (word, mode) may stand for.

        Mode ``whole`` is the token itself, ``plural`` also with s, ``begins`` any token that begins with the word.
        """
        words, few = held(words.distinct())
        vocabulary = self.vocabulary()
        begins, exact = words.filter("mode = 'begins'"), words.filter("mode <> 'begins'")
        if few is not None:
            prefixes = {r["word"] for r in few if r["mode"] == "begins"}
            sizes, most = {len(w) for w in prefixes}, len(prefixes)
        else:
            sizes, most = {r[0] for r in begins.select(F.length("word")).distinct().collect()}, FEW + 1
        if most <= FEW:  # the scan itself looks for them
            begun = [F.col("token").startswith(w) for w in prefixes]
            vocabulary_of = vocabulary.filter(reduce(or_, begun) if begun else F.lit(False))
        else:
            vocabulary_of = vocabulary
        parts = [F.when(F.length("token") >= n, F.substring("token", 1, n)) for n in sorted(sizes)]
        prefix = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
        found = vocabulary_of.select("token", "df", F.explode(prefix).alias("word")).join(_few(begins, few), "word")
        forms = F.when(F.col("mode") == "plural", F.array("word", F.concat("word", F.lit("s")))).otherwise(F.array("word"))
        exact = exact.select("word", "mode", F.explode(forms).alias("token"))
        return found.select("word", "mode", "token", "df").unionByName(vocabulary.join(_few(exact, few), "token").select("word", "mode", "token", "df"))

    def core_works(self, names: DataFrame) -> DataFrame:
        """(name, and the attributes of a work): distinct works that name a core, as ``core_matches`` says."""
        own = names.select("name").distinct().withColumn("w", tokens("name")).filter(F.size("w") > 0)
        single = F.size("w") == 1
        short = (F.length(F.trim("name")) < SHORT_CORE) & single
        mode = F.when(short, "plural").when(F.col("at") == F.size("w") - 1, "begins").otherwise("whole")
        words, few = held(own.select("name", "w", short.alias("short"), F.posexplode("w").alias("at", "word")).withColumns({"mode": mode, "single": single}).drop("w", "short"))
        has = {True, False} if few is None else {r["single"] for r in few}
        found = self._none()
        if True in has:
            asked = _few(words.filter("single"), few)
            ways = self.ways(asked.select("word", "mode")).join(asked, ["word", "mode"]).select("token", "name")
            found = self.of_tokens(ways).select("name", *ATTRIBUTES)
        if False in has:
            found = found.unionByName(self._runs(_few(words.filter("not single"), few), placed=True))
        return found.distinct()

    def label_works(self, labels: DataFrame) -> DataFrame:
        """As ``core_works`` for labels of two loose words or more: works that hold all their words, in any order."""
        many = labels.select("name").distinct().filter(F.size(loose_words("name")) > 1)
        words = many.select("name", F.posexplode(F.array_distinct(loose_tokens(F.col("name")))).alias("at", "word"))
        words, few = held(words.withColumn("mode", F.when(F.length("word") <= 2, "plural").otherwise("begins")))
        return self._runs(_few(words, few), placed=False).distinct()

    def _none(self) -> DataFrame:
        return self.postings().limit(0).select(F.lit("").alias("name"), *ATTRIBUTES)

    def _runs(self, words: DataFrame, placed: bool) -> DataFrame:
        """Works that hold all words of a name, of ``words`` (name, at, word, mode): at places in a row if ``placed``.

        The name's rarest word leads; a name of which a word is in no work is dropped.
        """
        numbered, _ = held(words.select("word", "mode").distinct().withColumn("n", F.monotonically_increasing_id()))
        ways, few = held(self.ways(numbered.select("word", "mode")).join(numbered, ["word", "mode"]).select("n", "token", "df"))
        df = ways.groupBy("n").agg(F.sum("df").alias("df"))
        last = F.col("mode") == "begins" if placed else F.lit(False)  # led to by the token before it
        part = F.struct(last.alias("last"), "df", "at", "n", "word", "mode")
        parts = words.join(numbered, ["word", "mode"]).join(_few(df, few), "n", "left").groupBy("name").agg(F.sort_array(F.collect_list(part)).alias("parts"))
        parts = parts.filter(~F.exists("parts", lambda p: p["df"].isNull()))
        lead = F.col("parts")[0]
        if not placed:  # a work's words side by side: each is looked up among them
            led, few_led = held(parts.select("name", F.transform("parts", lambda p: p["n"]).alias("ns"), lead["n"].alias("n")))
            of_work = self.of_tokens(ways.select("token", "n")).groupBy(*ATTRIBUTES).agg(F.collect_set("n").alias("has"))
            near = of_work.select("*", F.explode("has").alias("n")).join(_few(led, few_led), "n")
            return near.filter(F.forall("ns", lambda n: F.array_contains("has", n))).select("name", *ATTRIBUTES)
        second = F.filter("parts", lambda p: p["at"] == lead["at"] + 1)[0]
        rest = F.filter("parts", lambda p: ~p["at"].isin(lead["at"], lead["at"] + 1))
        led, few_led = held(parts.select("name", lead["n"].alias("n"), lead["at"].alias("lead_at"), second["word"].alias("next"), second["mode"].alias("next_mode"), rest.alias("rest")))
        most = max((len(r["rest"]) for r in few_led), default=0) if few_led is not None else led.agg(F.max(F.size("rest"))).first()[0] or 0
        leads = ways.join(_few(led.select("n").distinct(), few_led), "n", "left_semi")
        fits = lambda token, word, mode: F.when(mode == "begins", token.startswith(word)).otherwise(token == word)
        runs = self.of_tokens(leads.select("token", "n")).join(_few(led, few_led), "n").filter(fits(F.col("after"), F.col("next"), F.col("next_mode")))
        runs = runs.select("name", "rest", *ATTRIBUTES, (F.col("at") - F.col("lead_at")).alias("begin"))
        if most:
            wanted = led.select(F.explode("rest.n").alias("n")).distinct()
            others = self.of_tokens(ways.join(_few(wanted, few_led), "n", "left_semi").select("token").distinct())
            others = others.select(F.col("token").alias("_token"), F.col("id").alias("_id"), F.col("at").alias("_at"))
        for k in range(most):  # the token that stands where the next rarest word has to
            one = F.get("rest", F.lit(k))
            same = (F.col("id") == F.col("_id")) & (F.col("begin") + one["at"] == F.col("_at")) & fits(F.col("_token"), one["word"], one["mode"])
            runs = runs.filter(F.size("rest") <= k).unionByName(runs.filter(F.size("rest") > k).join(others, same, "left_semi"))
        return runs.select("name", *ATTRIBUTES)


def _few(df: DataFrame, rows: list | None) -> DataFrame:
    """``df`` to be broadcast if it comes of few rows that have been fetched."""
    return df if rows is None else F.broadcast(df)
