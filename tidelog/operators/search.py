"""Exact-pattern counts over texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: Column, pattern: str) -> Column:
    """Overlapping occurrences of a literal pattern."""
    return F.coalesce(F.regexp_count(text, F.lit(f"(?={re.escape(pattern)})")), F.lit(0)).cast("long")


def substring_count(texts: DataFrame, pattern: str, key: str, text: str = "text") -> DataFrame:
    return texts.select(key, occurrences(F.col(text), pattern).alias("n"))


def substring_total(texts: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    return texts.agg(F.sum(occurrences(F.col(text), pattern)).alias("n"))
