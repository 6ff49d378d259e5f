"""Readers of raw source files: explicit schemas, one row per document, incomplete rows left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPENALEX = (
    "results array<struct<id string, title string, publication_date string, type string, language string, cited_by_count bigint, "
    "abstract_inverted_index map<string,array<int>>, primary_topic struct<display_name string, subfield struct<display_name string>, field struct<display_name string>>, "
    "authorships array<struct<institutions array<struct<id string, display_name string, type string>>, countries array<string>>>, "
    "awards array<struct<funder_display_name string>>, funders array<struct<display_name string>>>>"
)
ATOM = "id string, title string, summary string, published string, updated string, doi string, primary_category struct<_term string>"
RSS = "title string, link string, pubDate string, description string, source struct<_VALUE string, _url string>"
LIVE = ["source", "title", "url", "published", "publisher", "lang", "snippet", "domain"]


def inverted_abstract(index: Column) -> Column:
    """Text of a word -> positions map; null gives the empty text."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def word_positions(words: Column) -> Column:
    """Map of each of ``words`` to its places, ascending from 0; null for none. In the row: sorted, then cut where the word changes."""
    placed = F.array_sort(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    word = lambda s, i: F.get(s, i)["w"]
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (word(s, i) != word(s, i - 1)))
    entry = lambda s, b, i, k: F.struct(word(s, i).alias("w"), F.transform(F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i), lambda x: x["p"]).alias("ps"))
    # an array of one names what is used more than once
    entries = F.transform(F.array(placed), lambda s: F.transform(F.array(first(s)), lambda b: F.transform(b, lambda i, k: entry(s, b, i, k)))[0])[0]
    return F.when(F.size(words) > 0, F.map_from_entries(entries))


def affiliations(authorships: Column) -> Column:
    """struct(institutions, countries, authors): sorted distinct names and countries, number of authors."""
    names = F.flatten(F.transform(authorships, lambda a: F.coalesce(F.transform(a["institutions"], lambda i: i["display_name"]), F.array().cast("array<string>"))))
    countries = F.flatten(F.transform(authorships, lambda a: F.coalesce(a["countries"], F.array().cast("array<string>"))))
    tidy = lambda c: F.array_sort(F.array_distinct(F.array_compact(c)))
    return F.struct(tidy(names).alias("institutions"), tidy(countries).alias("countries"), F.size(authorships).alias("authors"))


def funders(awards: Column, funders_: Column) -> Column:
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce(F.transform(awards, lambda a: a["funder_display_name"]), none), F.coalesce(F.transform(funders_, lambda f: f["display_name"]), none))
    return F.array_sort(F.array_compact(both))


def openalex(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Works of OpenAlex pages, one in each file or each line: rows without id, title or date are left out."""
    r = spark.read.schema(OPENALEX).option("multiLine", multi_line).json(path).select(F.explode("results").alias("r")).select("r.*")
    day = F.col("publication_date").try_cast("date")
    out = r.filter(F.col("id").isNotNull() & (F.trim("title") != "") & day.isNotNull())
    return out.select(
        F.lit("openalex").alias("source"), F.element_at(F.split("id", "/"), -1).alias("external_id"), "title", day.alias("observed_at"), "type", "language", F.col("cited_by_count").alias("citations"),
        inverted_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.col("primary_topic.field.display_name").alias("field"),
        affiliations(F.coalesce("authorships", F.array().cast("array<struct<institutions:array<struct<id:string,display_name:string,type:string>>,countries:array<string>>>"))).alias("affiliations"),
        funders(F.col("awards"), F.col("funders")).alias("funders"),
    )


def _feed(spark: SparkSession, path: str, tag: str, schema: str, lines: bool, inside: str = "") -> DataFrame:
    """Rows of XML feeds, one feed in each file or, with ``lines``, in each line; ``inside`` names what holds the rows."""
    if not lines:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    rows = f"{tag} array<struct<{schema}>>"
    feed = F.from_xml("value", f"{inside} struct<{rows}>" if inside else rows)
    found = spark.read.text(path).select(feed.alias("f"))
    return found.select(F.explode(".".join(x for x in ("f", inside, tag) if x)).alias("e")).select("e.*")


def arxiv(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of Atom feeds: the id is all behind /abs/, the date that of the first version."""
    e = _feed(spark, path, "entry", ATOM, lines)
    day = F.substring("published", 1, 10).try_cast("date")
    key = F.regexp_extract("id", "/abs/(.+)$", 1)
    out = e.filter((key != "") & (F.trim("title") != "") & day.isNotNull())
    return out.select(F.lit("arxiv").alias("source"), key.alias("external_id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.trim(F.regexp_replace("summary", r"\s+", " ")).alias("abstract"), day.alias("observed_at"), F.col("primary_category._term").alias("field"), "doi")


def unescape(text: Column) -> Column:
    """Tags stripped, the common character references resolved, white space folded."""
    plain = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def news_rss(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Live documents of RSS feeds: the title without its publisher's tail, the RFC-822 date as ISO."""
    r = _feed(spark, path, "item", RSS, lines, "channel")
    publisher = F.col("source._VALUE")
    title = unescape(F.col("title"))
    tail = F.concat(F.lit(" - "), publisher)
    bare = F.when(publisher.isNotNull() & title.endswith(tail), F.left(title, F.length(title) - F.length(tail))).otherwise(title)
    day = F.to_date(F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4})", 1), F.lit("d MMM yyyy")))
    domain = F.regexp_replace(F.lower(F.regexp_extract(F.col("source._url"), "://([^/]+)", 1)), r"^www\.", "")
    return r.select(F.lit("news").alias("source"), bare.alias("title"), F.col("link").alias("url"), F.coalesce(day.cast("string"), F.lit("")).alias("published"), publisher.alias("publisher"), F.lit("en").alias("lang"), unescape(F.col("description")).alias("snippet"), domain.alias("domain"))


def live_json(spark: SparkSession, path: str, schema: str, rows: str, fields: dict[str, Column], multi_line: bool = True) -> DataFrame:
    """Live documents of a JSON source: ``rows`` names the array, ``fields`` gives each column of LIVE from its items."""
    items = spark.read.schema(schema).option("multiLine", multi_line).json(path).select(F.explode(rows).alias("r")).select("r.*")
    return items.select(*(fields.get(c, F.lit(None).cast("string")).alias(c) for c in LIVE))


def _told(column: str, most: int | None = None) -> Column:
    plain = unescape(F.coalesce(F.col(column), F.lit("")))
    return plain if most is None else F.substring(plain, 1, most)


def grants(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Grants: the amount, if there is one, is told in the snippet."""
    schema = "results array<struct<appl_id bigint, project_title string, award_amount bigint, award_notice_date string, organization struct<org_name string>>>"
    return live_json(spark, path, schema, "results", {
        "source": F.lit("grants"), "title": _told("project_title"), "url": F.concat(F.lit("https://reporter.nih.gov/project-details/"), F.col("appl_id").cast("string")),
        "published": F.substring("award_notice_date", 1, 10), "publisher": F.coalesce("organization.org_name", F.lit("")), "lang": F.lit("en"),
        "snippet": F.coalesce(F.concat(F.lit("grant $"), F.translate(F.format_number("award_amount", 0), ",", " ")), F.lit("")), "domain": F.lit("reporter.nih.gov"),
    }, multi_line)


def articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Articles of a journal search; the date may be a bare year."""
    schema = "articles array<struct<name string, link string, year int, journal string, annotation string>>"
    return live_json(spark, path, schema, "articles", {
        "source": F.lit("articles"), "title": _told("name"), "url": F.concat(F.lit("https://cyberleninka.ru"), F.col("link")), "published": F.coalesce(F.col("year").cast("string"), F.lit("")),
        "publisher": _told("journal"), "lang": F.lit("ru"), "snippet": _told("annotation", 400), "domain": F.lit("cyberleninka.ru"),
    }, multi_line)


def repositories(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Code repositories of a search; their stars stand for the publisher."""
    schema = "items array<struct<full_name string, html_url string, created_at string, stargazers_count bigint, description string>>"
    return live_json(spark, path, schema, "items", {
        "source": F.lit("code"), "title": F.col("full_name"), "url": F.col("html_url"), "published": F.coalesce(F.substring("created_at", 1, 10), F.lit("")),
        "publisher": F.concat(F.lit("★ "), F.coalesce("stargazers_count", F.lit(0)).cast("string")), "lang": F.lit("en"), "snippet": _told("description", 300), "domain": F.lit("github.com"),
    }, multi_line)


#: Domains of preprint servers by a part of the publisher's name, and that of all others.
PREPRINT_DOMAINS = {
    "biorxiv": "biorxiv.org",
    "medrxiv": "medrxiv.org",
    "chemrxiv": "chemrxiv.org",
    "research square": "researchsquare.com",
    "preprints.org": "preprints.org",
    "ssrn": "ssrn.com",
    "arxiv": "arxiv.org",
}
PREPRINT_OTHER = "europepmc.org"


def preprints(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Preprints: the link is that of the DOI if there is one, the domain that of the server."""
    schema = "resultList struct<result array<struct<id string, doi string, title string, firstPublicationDate string, authorString string, journalTitle string, bookOrReportDetails struct<publisher string>>>>"
    publisher = F.coalesce(F.nullif("bookOrReportDetails.publisher", F.lit("")), "journalTitle", F.lit(""))
    domain = F.coalesce(*(F.when(F.lower(publisher).contains(part), d) for part, d in PREPRINT_DOMAINS.items()), F.lit(PREPRINT_OTHER))
    doi = F.nullif("doi", F.lit(""))
    return live_json(spark, path, schema, "resultList.result", {
        "source": F.lit("preprints"), "title": _told("title"), "url": F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://europepmc.org/article/PPR/"), F.coalesce("id", F.lit("")))),
        "published": F.coalesce(F.substring("firstPublicationDate", 1, 10), F.lit("")), "publisher": publisher, "lang": F.lit("en"), "snippet": _told("authorString", 200), "domain": domain,
    }, multi_line)


def trials(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Clinical trials: the snippet tells phases and status."""
    schema = (
        "studies array<struct<protocolSection struct<identificationModule struct<nctId string, briefTitle string>, statusModule struct<overallStatus string, startDateStruct struct<date string>>, "
        "sponsorCollaboratorsModule struct<leadSponsor struct<name string>>, designModule struct<phases array<string>>>>>"
    )
    p = "protocolSection."
    phases = F.nullif(F.array_join(F.coalesce(p + "designModule.phases", F.array().cast("array<string>")), ", "), F.lit(""))
    return live_json(spark, path, schema, "studies", {
        "source": F.lit("trials"), "title": _told(p + "identificationModule.briefTitle"), "url": F.concat(F.lit("https://clinicaltrials.gov/study/"), F.coalesce(p + "identificationModule.nctId", F.lit(""))),
        "published": F.coalesce(F.substring(F.col(p + "statusModule.startDateStruct.date"), 1, 10), F.lit("")), "publisher": F.coalesce(p + "sponsorCollaboratorsModule.leadSponsor.name", F.lit("")), "lang": F.lit("en"),
        "snippet": F.concat_ws(" · ", phases, F.nullif(p + "statusModule.overallStatus", F.lit(""))), "domain": F.lit("clinicaltrials.gov"),
    }, multi_line)


def companies(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, name): institutions of type company, a dimension for joins."""
    r = spark.read.schema("results array<struct<id string, display_name string, type string>>").option("multiLine", multi_line).json(path).select(F.explode("results").alias("r"))
    return r.filter(F.col("r.type") == "company").select(F.element_at(F.split("r.id", "/"), -1).alias("id"), F.col("r.display_name").alias("name")).distinct()


def patents(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Patent records whose nodes are single or lists: read as VARIANT, the English title first, three applicants at most."""
    v = F.try_parse_json("value")
    many = lambda p, t: F.coalesce(F.try_variant_get("v", p, f"array<{t}>"), F.array_compact(F.array(F.try_variant_get("v", p, t))))
    raw = spark.read.text(path, wholetext=whole_files).select(v.alias("v"))
    titles = many("$.title", "struct<lang:string,text:string>")
    english = F.filter(titles, lambda t: t["lang"] == "en")
    title = F.coalesce(F.get(english, F.lit(0))["text"], F.get(titles, F.lit(0))["text"])
    day = F.try_variant_get("v", "$.date", "string")
    return raw.select(title.alias("title"), F.concat_ws("-", day.substr(1, 4), day.substr(5, 2), day.substr(7, 2)).alias("published"), F.slice(many("$.applicant", "string"), 1, 3).alias("applicants"), F.substring(F.try_variant_get("v", "$.abstract", "string"), 1, 600).alias("snippet"))


def dataset(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV, TSV or JSON table with columns found by alias, whatever their case; rows without a name are left out."""
    sep = "\t" if path.endswith((".tsv", ".txt")) else ","
    df = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.option("header", True).option("sep", sep).csv(path)
    by_low = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    picked = {k: next((by_low[a.lower()] for a in v if a.lower() in by_low), None) for k, v in aliases.items()}
    out = df.select(*((F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(k) for k, c in picked.items()))
    return out.filter(F.coalesce(F.col(next(iter(aliases))), F.lit("")) != "")


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of technologies with aliases (split by bar, lower case) and a cut date."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    return t.select("tech", F.transform(F.split("aliases", r"\|"), lambda a: F.lower(F.trim(a))).alias("aliases"), F.to_date("cut").alias("cut"))


def windows(now: str, days: int, n: int, skip: int = 0, spark: SparkSession | None = None) -> DataFrame:
    """(first_day, last_day) of n windows of ``days`` days, newest first, without gap or overlap; ``skip`` moves the edge."""
    end = F.date_sub(F.lit(now).cast("date"), skip)
    k = (spark or SparkSession.active()).range(n).withColumn("k", F.col("id").cast("int"))
    last = F.date_sub(end, F.col("k") * days)
    return k.select(F.date_sub(last, days - 1).alias("first_day"), last.alias("last_day"))


def to_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def evidence_for(ids: DataFrame, works: DataFrame) -> DataFrame:
    """Evidence of the ids asked for, by join: never by a list in the query."""
    return works.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("observed_at").alias("day"), F.col("term_raw").alias("text"), "source")


def paper_key(url: Column) -> Column:
    """arxiv:<id without version> or openalex:W...; null for other urls."""
    ax = F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([^?#]+?)(?:v\d+)?(?:\.pdf)?$", 1)
    oa = F.regexp_extract(url, r"openalex\.org/(W\d+)", 1)
    return F.when(ax != "", F.concat(F.lit("arxiv:"), ax)).when(oa != "", F.concat(F.lit("openalex:"), oa))
