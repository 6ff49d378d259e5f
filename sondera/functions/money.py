"""Amounts and funding words in headlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondera.functions.text import _col

#: Words that make a headline one about money.
FUNDING_WORDS = "raises raised raise funding seed series round investment invests investors acquires acquisition acquired valuation backed".split()
#: What a word behind an amount multiplies it by.
SCALE = {"billion": 1e9, "bn": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}


def _amount(after: Column) -> Column:
    """struct(number, word, grouped) of what stands after a dollar sign: digits in well-formed groups, and the word behind."""
    body = F.when(F.substring(after, 1, 1).rlike(r"\s"), F.substring(after, F.lit(2), F.length(after))).otherwise(after)
    digits = F.rtrim(F.regexp_extract(body, "^[0-9.,]+", 0), F.lit(".,"))
    behind = F.substring(body, F.length(digits) + 1, F.length(body))
    whole, fraction = F.split(digits, "[.]")[0], F.coalesce(F.get(F.split(digits, "[.]"), F.lit(1)), F.lit("0"))
    groups = F.split(whole, ",")
    formed = F.length(groups[0]).between(1, 3) & F.forall(F.slice(groups, 2, F.greatest(F.size(groups), F.lit(1))), lambda g: F.length(g) == 3)
    number = F.when((F.size(groups) == 1) | formed, F.concat(F.replace(whole, F.lit(",")), F.lit("."), fraction).try_cast("double"))
    return F.struct(number.alias("number"), F.lower(F.regexp_extract(behind, r"^\s?(\w+)", 1)).alias("word"), (F.size(groups) > 1).alias("grouped"))


def parse_usd(title: Column | str) -> Column:
    """The first dollar amount: a number with a scale word, or one with groups of thousands. A bare $5 is none."""
    amounts = F.transform(F.split(_col(title), r"\$"), lambda part, at: F.when(at > 0, _amount(part)))
    scale = F.create_map(*(F.lit(x) for pair in SCALE.items() for x in pair))
    counts = F.filter(amounts, lambda a: a["number"].isNotNull() & (a["grouped"] | F.map_contains_key(scale, a["word"])))
    first = F.get(counts, F.lit(0))
    return first["number"] * F.coalesce(F.try_element_at(scale, first["word"]), F.lit(1.0))


def is_funding(title: Column | str) -> Column:
    """Whether a word of the title is a funding word; hyphens part words."""
    words = F.split(F.regexp_replace(F.lower(_col(title)), "-", " "), r"\s+")
    return F.arrays_overlap(words, F.array(*(F.lit(w) for w in FUNDING_WORDS)))


def folded_title(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(title)), r"\s+", " "))
