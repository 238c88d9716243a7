"""Three notions of a value being there, kept apart on purpose (T1), and the two of a price (T15)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Removes white space of every kind at both ends (T11)."""
    return F.regexp_replace(column(c), r"^\s+|\s+$", "")


def filled(c: Column | str) -> Column:
    """For merging: text that isn't blank. Zero and false count as there."""
    return F.coalesce(F.length(strip(column(c).cast("string"))) > 0, F.lit(False))


def filled_array(c: Column | str) -> Column:
    return F.coalesce(F.size(column(c)) > 0, F.lit(False))


def scored(c: Column | str) -> Column:
    """For quality: as filled, but a number that is 0 and false count as missing; the text '0' is there."""
    c = column(c)
    return filled(c) & F.coalesce(F.typeof(c).isin("string") | (c.cast("string").try_cast("double") != 0) & (c.cast("string") != "false"), F.lit(False))


def truthy(c: Column | str) -> Column:
    """For `a or b`: text that isn't empty; white space counts as there."""
    return F.coalesce(F.length(column(c)) > 0, F.lit(False))


def first_truthy(*columns: Column | str) -> Column:
    """The first text that isn't empty, else null."""
    return F.coalesce(*(F.when(truthy(c), column(c)) for c in columns))


def price_is_zero(c: Column | str) -> Column:
    """For completeness: no usable number, or one that is zero ('0.00' too)."""
    return F.coalesce(column(c).try_cast("decimal(38,6)") == 0, F.lit(True))


def usable_price(c: Column | str) -> Column:
    """For extraction: the text, unless it is blank or exactly '0' ('0.00' is a price)."""
    text = strip(column(c).cast("string"))
    return F.when((text != "") & (text != "0"), text)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
