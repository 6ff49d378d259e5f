"""URL filter: given rules by host and path, and association rules mined from labels.

Spark's FP-growth mines the token combinations of labelled urls together with their label. Tokens that stand in just the
same urls are mined as one, and tokens of all urls are left out: both change no verdict. Rules that lead to a label are
pruned by support, confidence and lift, and a rule goes where part of its tokens says the same with no less confidence:
whatever it fits, the shorter one fits too. All other rules are kept, as a table.

A url is matched by inverted index: each rule is listed under its rarest token, urls meet the rules that are listed under
their tokens, and a rule fits if all its tokens are there. Different urls with the same tokens are matched once.

Only DataFrame, SQL and spark.ml functions run here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.llm.common import UPPER, cut, table, with_hot_apart

#: Fixed values: (verdict, host and path) of the given rules.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: A rule needs this share of the labelled urls and so many of them, this confidence and this lift; it has so many tokens at most.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT, MOST_TOKENS = 0.002, 5, 0.6, 1.2, 4
BLOCK, ALLOW = "label:block", "label:allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? or #. Else empty."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, whole.substr(at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def first_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null. A rule fits its host, all subdomains, and path prefixes."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(slash + of_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, parts of the host, its last two labels, path words, file ending, query names.

    Numbers are left out: they name single pages. A null url, and one without ://, has no tokens.
    """
    whole = F.coalesce(url, F.lit(""))

    def named(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(prefix), F.lower(v)))

    labels = F.split(host, r"\.")
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    every = F.concat(
        named("scheme:", F.array(F.substring_index(whole, "://", 1))),
        named("host:", F.split(host, r"[.\-_]")),
        named("site:", F.array(F.array_join(F.slice(F.concat(F.array(F.lit("")), labels), -2, 2), "."))),
        named("path:", F.regexp_extract_all(path, F.lit(r"[^/.\-_]+"), 0)),
        named("query:", F.regexp_extract_all(query, F.lit(r"([^&=]+)(?:=[^&]*)?"), 1)),
        named("fragment:", F.regexp_extract_all(whole, F.lit(r"#(.+)$"), 1)),
    )
    return F.when(F.instr(whole, "://") > 0, F.array_sort(F.array_distinct(F.filter(every, lambda t: ~t.rlike(r"^\w+:\d*$"))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class MinedRules:
    """The model, as tables.

    ``classes``: (token, class) of the tokens that occur in rules; ``rules``: (key, need, strength, verdict), the classes
    that a rule needs and the rarest of them, the smallest strength first; ``default``: what is said without a rule.
    """

    classes: DataFrame
    rules: DataFrame
    default: str

    def verdicts(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with tokens) and the ``mined`` verdict of the strongest rule whose tokens are all there, or null."""
        sets = cut(urls.groupBy("tokens").agg(F.count(F.lit(1)).alias("urls")))
        known = sets.select("tokens", F.explode("tokens").alias("token")).join(self.classes, "token").groupBy("tokens").agg(F.collect_set("class").alias("has"))
        met = known.withColumn("key", F.explode("has")).join(self.rules, "key").filter(F.forall("need", lambda t: F.array_contains("has", t)))
        best = met.groupBy("tokens").agg(F.min(F.struct("strength", "verdict")).alias("best"))
        judged = cut(sets.join(best.select("tokens", F.col("best.verdict").alias("mined")), "tokens"))
        return with_hot_apart(urls, judged, "tokens", "urls").drop("urls")


def _token_classes(labelled: DataFrame, rows: int, least: int) -> DataFrame:
    """(token, class, urls) of the tokens in ``least`` or more labelled urls, not in all: tokens of the same urls are one class.

    There are no more than the mean number of tokens of a url, divided by the least support.
    """
    mark = F.xxhash64("url_no").cast("decimal(38,0)")
    own = labelled.select(F.explode("tokens").alias("token"), mark.alias("mark")).groupBy("token").agg(F.count(F.lit(1)).alias("urls"), F.sum("mark").alias("mark"))
    own = own.filter((F.col("urls") >= least) & (F.col("urls") < rows))
    return own.withColumn("class", F.min("token").over(W.partitionBy("urls", "mark"))).select("token", "class", "urls")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> MinedRules:
    """Association rules of ``labelled`` (tokens array, blocked boolean) that lead to a label.

    Rows without a label don't count. Without a rule the label of more urls is said; where these tie, or there are none,
    urls are allowed.
    """
    spark = labelled.sparkSession
    labelled = cut(labelled.filter("blocked is not null").select("tokens", "blocked", F.monotonically_increasing_id().alias("url_no")))
    rates = {r[0]: r[1] for r in labelled.groupBy("blocked").count().collect()}
    rows = sum(rates.values())
    default = "block" if rates.get(True, 0) > rates.get(False, 0) else "allow"
    if not rows:
        return MinedRules(spark.createDataFrame([], "token string, class string"), spark.createDataFrame([], "key string, need array<string>, strength double, verdict string"), default)
    least = max(min_rows, min_support * rows)
    classes = cut(_token_classes(labelled, rows, least))
    named = labelled.select("url_no", "blocked", F.explode_outer("tokens").alias("token")).join(classes, "token", "left")
    baskets = named.groupBy("url_no", "blocked").agg(F.collect_set("class").alias("classes"))
    baskets = cut(baskets.select(F.concat("classes", F.array(F.when(F.col("blocked"), BLOCK).otherwise(ALLOW))).alias("items")))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / rows), minConfidence=min_confidence).fit(baskets).associationRules
    is_label = F.col("consequent")[0].isin(BLOCK, ALLOW)
    plain = F.forall("antecedent", lambda t: ~t.isin(BLOCK, ALLOW)) & (F.size("antecedent") <= MOST_TOKENS)
    said = F.when(F.col("consequent")[0] == BLOCK, "block").otherwise("allow")
    found = cut(found.filter(is_label & plain & (F.col("lift") >= MIN_LIFT)).select(F.array_sort("antecedent").alias("need"), said.alias("verdict"), "confidence", "support"))
    # a rule with a token too many: without it no less confident
    shorter = F.transform("need", lambda t: F.array_remove("need", t))
    parts = found.filter(F.size("need") > 1).select("need", "verdict", "confidence", F.explode(shorter).alias("part"))
    every = found.select(F.col("need").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    best_part = cut(_best_of_parts(parts, every))
    kept = found.join(best_part, ["need", "verdict"], "left").filter(F.col("of_part").isNull() | (F.col("of_part") < F.col("confidence") - 1e-12))
    urls = classes.groupBy("class").agg(F.first("urls").alias("urls"))
    rarest = kept.select("*", F.explode("need").alias("class")).join(urls, "class").groupBy("need", "verdict", "confidence", "support").agg(F.min_by("class", F.struct("urls", "class")).alias("key"))
    strength = F.struct(-F.col("confidence"), -F.col("support"), F.size("need"), F.col("verdict") != "block", F.array_join("need", " ")).alias("strength")
    return MinedRules(classes.select("token", "class"), cut(rarest.select("key", "need", strength, "verdict")), default)


def _best_of_parts(parts: DataFrame, every: DataFrame) -> DataFrame:
    """(need, verdict, of_part): the highest confidence among all rules of part of a rule's tokens, level by level."""
    found = None
    for _ in range(MOST_TOKENS - 1):
        met = parts.join(every, ["part", "verdict"]).select("need", "verdict", "of_part")
        found = met if found is None else found.unionByName(met)
        parts = parts.select("need", "verdict", "confidence", F.explode(F.transform("part", lambda t: F.array_remove("part", t))).alias("part")).filter(F.size("part") > 0).distinct()
    return found.groupBy("need", "verdict").agg(F.max("of_part").alias("of_part"))


def judge_urls(pages: DataFrame, mined: MinedRules, rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict. Columns of those names, and tokens and mined, are replaced.

    A null url, or one without ://, has empty host and path and no tokens: no rule fits, and it gets the default. Repeated
    rows get equal answers, an empty table gives no rows, urls are read whole. The longest given rule wins; of mined rules
    the most confident, then the one of more urls, fewer tokens, the one that blocks, and the first by its tokens.
    """
    pages = pages.drop("tokens", "mined")
    host, path = host_and_path(F.col("url"))
    with_parts = pages.withColumns({"host": host, "path": path})
    with_rule = with_parts.withColumn("_given", first_rule(F.col("host"), F.col("path"), rules))
    asked = with_rule.withColumn("tokens", F.when(F.col("_given").isNull(), tokens(F.col("url"), F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("_given.verdict"), F.col("mined"), F.lit(mined.default))
    judged = mined.verdicts(asked).withColumns({"rule": F.col("_given.rule"), "verdict": verdict})
    return judged.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, blocked): urls whose path names a labelled document; blocked if its quality is 0 or it is toxic."""
    host, path = host_and_path(F.col("url"))
    named = pages.select(tokens(F.col("url"), host, path).alias("tokens"), F.regexp_extract(path, r"^/[^/]+/([0-9]{1,18})(?:\D|$)", 1).try_cast("long").alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return named.filter("doc_id is not null").join(marks, "doc_id").select("tokens", "blocked")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    mined = mine(labelled_urls(pages, labels))
    return judge_urls(pages.select("page_id", "url"), mined).select("page_id", "host", "path", "rule", "verdict")
