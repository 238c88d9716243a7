"""Data-quality scores, validation, audits and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"price": 0.15, "image": 0.15, "description": 0.15, "sku": 0.15}


def quality(title: Column, present: dict[str, Column]) -> Column:
    """DQ-01: 0 without a title, else 0.4 and 0.15 for each of price, image, description and sku."""
    return F.when(title, F.round(sum((F.when(p, WEIGHTS[k]).otherwise(0.0) for k, p in present.items()), F.lit(0.4)), 4)).otherwise(0.0)


def missing(present: dict[str, Column]) -> Column:
    """Names of the fields that aren't there, in the given order."""
    return F.array_compact(F.array(*(F.when(~p, F.lit(n)) for n, p in present.items())))


def completeness(critical: dict[str, Column], optional: dict[str, Column]) -> tuple[Column, Column, Column]:
    """DQ-02: score between 0 and 1 (0.3 less for each critical field missing, 0.1 for each other), missing names, and whether to extract again."""
    n = lambda fields: sum(((~p).cast("int") for p in fields.values()), F.lit(0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - 0.3 * n(critical) - 0.1 * n(optional), 4)))
    return score, F.array_sort(missing(critical | optional)), n(critical) > 0


def mandatory_score(present: dict[str, Column]) -> tuple[Column, Column]:
    """DQ-03: share of the fields that are there, to 2 places, and whether all are."""
    n = sum((p.cast("int") for p in present.values()), F.lit(0))
    return F.round(n / len(present), 2), n == len(present)


def batch_quality(df: DataFrame, score: str, *by: str) -> DataFrame:
    """AGG-09: mean score (0.0 of nothing)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("quality"))


def verdict(count: Column, score: Column, least: float = 0.3) -> Column:
    """DQ-04, FLT-14, DQ-07."""
    return F.when(count == 0, "zero_products").when(score < least, "low_quality").otherwise("passed")


def first_urls(df: DataFrame, where: Column, url: str, by: tuple[str, ...], most: int, name: str) -> DataFrame:
    """The first distinct urls of each group in order; ranks cut them down before they are gathered."""
    distinct = df.where(where).where(F.col(url).isNotNull()).select(*by, url).distinct()
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(url))).where(F.col("_rank") <= most)
    return ranked.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.array_sort(F.collect_list(url)).alias(name))


def outcome_audit(df: DataFrame, outcome: str, products: str, url: str, *by: str, most: int = 50) -> DataFrame:
    """AGG-10: counts of each outcome, products of successes, success rate in percent, and the first failed and incomplete urls in order."""
    is_ = lambda x: F.col(outcome) == x
    counts = df.groupBy(*by).agg(
        F.count("*").alias("attempted"),
        *(F.count_if(is_(x)).alias(x) for x in ("success", "error", "empty", "incomplete", "skipped")),
        F.coalesce(F.sum(F.when(is_("success"), F.col(products))), F.lit(0)).alias("products"),
        F.coalesce(F.round(100.0 * F.count_if(is_("success")) / F.count("*"), 2), F.lit(0.0)).alias("success_rate"),
    )
    for kind, name in (("error", "failed"), ("incomplete", "incomplete_urls")):
        some = first_urls(df, is_(kind), url, by, most, name)
        same = reduce(lambda a, b: a & b, (counts[c].eqNullSafe(some[f"_{c}"]) for c in by))
        counts = counts.join(some, same, "left").drop(*(f"_{c}" for c in by)).withColumn(name, F.coalesce(name, F.array()))
    return counts


def too_many_errors(attempted: Column, errors: Column) -> Column:
    """AGG-13: over three tries and over 70 % failed."""
    return (attempted > 3) & (errors / attempted > 0.7)


def reconciliation(df: DataFrame, discovered: Column, attempted: Column, ok: Column) -> DataFrame:
    """AGG-12: coverage (of what was discovered), success (of what was tried), both in percent, and the gap."""
    pct = lambda a, b: F.coalesce(F.round(100.0 * F.try_divide(a.cast("double"), b), 2), F.lit(0.0))
    return df.select("*", pct(ok, discovered).alias("coverage_pct"), pct(ok, attempted).alias("success_pct"), (discovered - ok).alias("gap"))


def reextraction_urls(df: DataFrame, url: str, gaps: dict[str, Column]) -> DataFrame:
    """AGG-11: field and url of the distinct urls that lack a field: the plan's lists, a row for each entry, so that none is gathered."""
    return df.select(F.explode(missing({n: ~g for n, g in gaps.items()})).alias("field"), url).distinct()


def reextraction_plan(df: DataFrame, url: str, gaps: dict[str, Column]) -> DataFrame:
    """AGG-11: for each field the number of distinct urls that lack it, how many rows lack any, and the share that lack none (1.0 of nothing)."""
    any_gap = sum((g.cast("int") for g in gaps.values()), F.lit(0)) > 0
    return df.agg(*(F.count_distinct(F.when(g, F.col(url))).alias(f"urls_{n}") for n, g in gaps.items()), F.count_if(any_gap).alias("incomplete"), F.coalesce(F.round(1 - F.try_divide(F.count_if(any_gap), F.count("*")), 4), F.lit(1.0)).alias("complete_rate"))
