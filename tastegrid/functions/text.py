"""Titles that end in a year, as in ``Heat (1995)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A four-digit year in parentheses at the end of the title.
YEAR_AT_END = r"\((\d{4})\)\s*$"
YEAR_SUFFIX = r"\s*\(\d{4}\)\s*$"


def release_year(title: str = "title") -> Column:
    """The year, or null for a title without one."""
    return F.regexp_extract(F.col(title), YEAR_AT_END, 1).try_cast("int")


def title_without_year(title: str = "title") -> Column:
    return F.regexp_replace(F.col(title), YEAR_SUFFIX, "")
