"""How alike an expected and an extracted value are, from 0 to 1."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions import text
from millrace.functions.presence import column, strip


def words(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(column(c)), r"[^a-z0-9]+"), lambda x: x != ""))


def token_f1(a: Column | str, b: Column | str) -> Column:
    """F1 of the sets of lower-case words; 1.0 if both are empty."""
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    f1 = F.coalesce(F.try_divide(2.0 * both, F.size(x) + F.size(y)), F.lit(0.0))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.round(f1, 6))


def numeric(a: Column | str, b: Column | str) -> Column:
    """1.0 for numbers within 1 %, else 0.0; everything but digits and points is dropped first."""
    x, y = (F.regexp_replace(column(c).cast("string"), "[^0-9.]", "").try_cast("double") for c in (a, b))
    return F.when(x.isNull() | y.isNull(), 0.0).when((x == 0) & (y == 0), 1.0).when(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y)) <= 0.01, 1.0).otherwise(0.0)


def url(a: Column | str, b: Column | str) -> Column:
    """1.0 if equal but for closing slashes, 0.9 if only the scheme differs, else 0.0."""
    x, y = (F.regexp_replace(F.lower(strip(c)), "/+$", "") for c in (a, b))
    bare = lambda c: F.regexp_replace(c, "^https?://", "")
    return F.when(x == y, 1.0).when(bare(x) == bare(y), 0.9).otherwise(0.0)


def boolean(a: Column | str, b: Column | str) -> Column:
    return F.when(text.truth(a) == text.truth(b), 1.0).otherwise(0.0)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which Spark has no function for; it isn't symmetric (T8)."""
    return pd.Series([round(SequenceMatcher(None, x or "", y or "").ratio(), 6) for x, y in zip(a, b, strict=True)])


def score(kind: str, expected: Column | str, extracted: Column | str) -> Column:
    """DQ-08: nothing expected is 1.0, nothing extracted 0.0, else by kind."""
    e, x = column(expected), column(extracted)
    by = {"exact": lambda: F.when(strip(e.cast("string")) == strip(x.cast("string")), 1.0).otherwise(0.0), "fuzzy": lambda: ratio(F.lower(e), F.lower(x)), "tokens": lambda: token_f1(e, x), "numeric": lambda: numeric(e, x), "url": lambda: url(e, x), "boolean": lambda: boolean(e, x)}[kind]
    return F.when(e.isNull(), 1.0).when(x.isNull(), 0.0).otherwise(by())


