"""How far the domain of a source is trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions.text import _col

#: Kind, level and domains. An exact domain comes first, then a suffix, then a zone.
EXACT = (
    ("patent", "high", "ops.epo.org worldwide.espacenet.com register.epo.org patents.google.com patentscope.wipo.int data.uspto.gov ppubs.uspto.gov fips.ru new.fips.ru"),
    ("preprint", "high", "arxiv.org export.arxiv.org biorxiv.org medrxiv.org chemrxiv.org researchsquare.com preprints.org ssrn.com alphaxiv.org"),
    ("science", "high", "europepmc.org openalex.org doi.org nature.com science.org sciencedirect.com springer.com link.springer.com ieeexplore.ieee.org dl.acm.org mdpi.com frontiersin.org ojs.aaai.org onlinelibrary.wiley.com advanced.onlinelibrary.wiley.com pubs.acs.org ahajournals.org cyberleninka.ru elibrary.ru"),
    ("association", "high", "ieee.org owasp.org oecd.org bis.org imf.org worldbank.org"),
    ("association", "medium", "weforum.org"),
    ("gov", "high", "nist.gov cbr.ru europa.eu"),
    ("media", "medium", "fortune.com cnbc.com forbes.com wsj.com businessinsider.com axios.com statnews.com calcalistech.com industrialcyber.co mobihealthnews.com genengnews.com fintech.global finovate.com fintechfutures.com thequantuminsider.com helpnetsecurity.com biopharmadive.com tomshardware.com techcrunch.com siliconangle.com theaiinsider.tech therobotreport.com roboticsandautomationnews.com eetimes.com datacenterdynamics.com geekwire.com reuters.com securityweek.com venturebeat.com theregister.com tadviser.ru cnews.ru rbc.ru kommersant.ru vedomosti.ru"),
    ("vendor", "medium", "aws.amazon.com developer.nvidia.com nvidianews.nvidia.com microsoft.com news.microsoft.com machinelearning.apple.com research.google ibm.com"),
    ("code", "medium", "github.com"),
    ("press", "low", "eurekalert.org prnewswire.com businesswire.com globenewswire.com einpresswire.com accessnewswire.com"),
    ("blog", "low", "app.dealroom.co startupfortune.com marktechpost.com finance.yahoo.com news.ycombinator.com habr.com medium.com substack.com reddit.com x.com twitter.com linkedin.com t.me vc.ru dzen.ru pulse2.com"),
)
SUFFIXES = (("blog", "low", ".substack.com"), ("blog", "low", ".medium.com"), ("blog", "low", ".blogspot.com"))
ZONES = (
    ("gov", "high", ".gov"), ("gov", "high", ".gov.ru"), ("gov", "high", ".gov.uk"), ("gov", "high", ".mil"), ("university", "high", ".edu"),
    ("university", "high", ".ac.uk"), ("university", "high", ".ac.jp"), ("association", "high", ".int"),
)


def domain_of(url: Column | str) -> Column:
    """The host of a url, or the text itself, lower-case and without www."""
    c = _col(url)
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")), c))
    return F.regexp_replace(host, r"^www\.", "")


def classify(url: Column | str) -> Column:
    """struct(kind, level) of a url's domain; unknown domains are media of unknown level."""
    host = domain_of(url)
    table = F.create_map(*(x for kind, level, domains in EXACT for d in domains.split() for x in (F.lit(d), F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level")))))
    found = F.try_element_at(table, host)
    for kind, level, end in (*SUFFIXES, *ZONES):
        found = F.coalesce(found, F.when(host.endswith(end), F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"))))
    return F.coalesce(found, F.struct(F.lit("media").alias("kind"), F.lit("unknown").alias("level")))


def corroborated(levels: Column) -> Column:
    """Whether a source of known level above low is among them; without sources there is nothing to doubt."""
    return (F.size(levels) == 0) | F.exists(levels, lambda x: x.isin("high", "medium"))


def with_trust(docs: DataFrame, url: str = "url") -> DataFrame:
    return docs.withColumn("_t", classify(url)).withColumns({"kind": F.col("_t.kind"), "level": F.col("_t.level")}).drop("_t")
