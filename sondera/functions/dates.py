"""Dates as sources write them, and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondera.functions.text import _col


def iso_of_compact(text: Column | str) -> Column:
    """yyyymmdd as yyyy-mm-dd; other texts as they are."""
    c = _col(text)
    return F.when(c.rlike(r"^\d{8}$"), F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), c.substr(7, 2))).otherwise(c)


def published_date(text: Column | str) -> Column:
    """An ISO date; a bare year is its 1 July; else null."""
    c = _col(text)
    year = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-07-01")))
    return F.coalesce(year, F.substring(c, 1, 10)).try_cast("date")


def too_late(text: Column | str, cut: Column) -> Column:
    """Whether a document is from after the cut. A bare year counts by year; what can't be read is not too late."""
    c = _col(text)
    bare = F.when(c.rlike(r"^\d{4}$"), c.try_cast("int") > F.year(cut))
    return F.coalesce(bare, F.substring(c, 1, 10).try_cast("date") > cut, F.lit(False))


def years_back(day: Column, years: int) -> Column:
    """The same day ``years`` before; 29 February becomes the 28th."""
    return F.add_months(day, -12 * years)
