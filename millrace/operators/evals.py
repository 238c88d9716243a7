"""Accuracy of extraction: matching, field scores, averages and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import matching
from millrace.operators.ranges import stored


def greedy_match(expected: DataFrame, extracted: DataFrame, group: str, least: float = 0.5, most: int = matching.MOST) -> DataFrame:
    """JOIN-15: each expected title in its order (T8) takes the best extracted one that is left, if it is similar enough; of equals the first.

    expected and extracted: group, pos (an integer that tells a group's rows apart), title. Rows without a group meet nobody."""
    side = lambda df: df.where(F.col(group).isNotNull()).select(matching.group_id(group).alias("_g"), F.col("pos").cast("bigint").alias("pos"), "title")
    taken = matching.assigned(side(expected), side(extracted), least, most)
    wanted = expected.select(group, F.col("pos").cast("bigint").alias("pos"), matching.group_id(group).alias("_own"))
    joined = wanted.join(taken, (F.col("_own") == F.col("_g")) & (F.col("pos") == F.col("e")), "left")
    return joined.select(group, "pos", F.col("x").alias("matched"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("similarity"))


def merge_chunks(records: DataFrame, group: str, fields: list[str], alike: float = 0.9, most: int = matching.MOST) -> DataFrame:
    """JOIN-16: of a page's records in order of pos (an integer that tells them apart), those whose titles are equal, prefixes or alike become one; the first is the base and gaps are filled.

    An untitled record stays if it is its page's only one. records: group, pos, title and more columns, in any order; rows without a group are a page."""
    rows = records.select(matching.group_id(group).alias("_g"), F.col("pos").cast("bigint").alias("_pos"), F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("row"))
    # Rows of one title repeat the same base, so the first of each title stands for all.
    titles = stored(rows.groupBy("_g", F.col("row.title").alias("title")).agg(F.min("_pos").alias("pos")).where("title is not null and pos is not null"), "titles")
    found = matching.bases(matching.blocked(titles, titles, lambda a, b, upto: matching.repeats(a, b, upto, alike), later=True), most).withColumnsRenamed({"_g": "_own", "x": "_x"})
    based = titles.join(found, (F.col("_g") == F.col("_own")) & (F.col("pos") == F.col("_x")), "left").select(F.col("_g").alias("_own"), F.col("title").alias("_title"), F.coalesce("e", "pos").alias("e"))
    alone = rows.groupBy(F.col("_g").alias("_page")).agg(F.count("*").alias("_n")).where("_n = 1").select("_page")
    placed = rows.withColumn("_called", F.col("row.title")).join(based, (F.col("_g") == F.col("_own")) & (F.col("_called") == F.col("_title")), "left").join(alone, F.col("_g") == F.col("_page"), "left")
    titled = F.coalesce(F.trim(F.col("row.title"), F.lit(matching.BLANK)) != "", F.lit(False))
    placed = placed.where(titled | F.col("_page").isNotNull()).withColumn("base", F.coalesce("e", "_pos"))
    filled = lambda f: F.min_by(F.when(F.col("row")[f].isNotNull() & (F.col("row")[f].cast("string") != ""), F.struct(F.col("row")[f].alias("value"))), F.when(F.col("row")[f].isNotNull() & (F.col("row")[f].cast("string") != ""), F.col("_pos")))["value"]
    merged = placed.groupBy("_g", "base").agg(F.min_by("row", "_pos").alias("first"), *(filled(f).alias(f"filled_{i}") for i, f in enumerate(fields)))
    column = lambda c: F.coalesce(F.col(f"filled_{fields.index(c)}"), F.col("first")[c]) if c in fields else F.col("first")[c]
    return merged.select(*(column(c).alias(c) for c in records.columns))


def averages(scores: DataFrame, *by: str) -> DataFrame:
    """AGG-17: mean score, and how many fields scored 0.8 or more."""
    return scores.groupBy(*by).agg(F.round(F.avg("score"), 4).alias("avg_score"), F.count_if(F.col("score") >= 0.8).alias("fields_matched"), F.count("*").alias("fields"))


def completeness(n: Column, least: Column) -> Column:
    return F.when(F.coalesce(least, F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), n / least))


def overall(accuracy: Column, complete: Column) -> Column:
    """AGG-17."""
    return F.round(0.6 * accuracy + 0.4 * complete, 4)


def best_tier(tiers: DataFrame, site: str, tier: str, score: str) -> DataFrame:
    """AGG-17, AGG-19: the best tier of each site; of equals the first by name."""
    ranked = tiers.groupBy(site).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(tier).alias("tier"))).alias("x"))
    return ranked.select(site, F.col("x.tier").alias("best_tier"), (-F.col("x.s")).alias("best_score"))


def with_best_tier(tiers: DataFrame, site: str, tier: str, score: str) -> DataFrame:
    """AGG-17: tiers with the best of their site beside them, in the pass that has made them; a site has a handful of tiers."""
    first = Window.partitionBy(site).orderBy(F.desc(score), tier)
    return tiers.withColumn("best_tier", F.first(tier).over(first))


def regressions(baseline: DataFrame, current: DataFrame, keys: list[str], threshold: float = 0.05, allowed: DataFrame | None = None) -> DataFrame:
    """JOIN-17, WIN-08: change of each score, and whether it got better or worse by more than the threshold; allowed keys never count as worse."""
    joined = baseline.withColumnRenamed("score", "before").join(current.withColumnRenamed("score", "after"), keys)
    delta = F.round(F.col("after") - F.col("before"), 4)
    out = joined.withColumn("delta", delta)
    free = F.lit(False)
    if allowed is not None:
        out = out.join(allowed.select(*keys).distinct().withColumn("_free", F.lit(True)), keys, "left")
        free = F.coalesce("_free", F.lit(False))
    kind = F.when((F.col("delta") < -threshold) & ~free, "regression").when(F.col("delta") > threshold, "improvement").otherwise("same")
    return out.withColumn("kind", kind).select(*keys, "before", "after", "delta", "kind")


def flat(products: DataFrame) -> DataFrame:
    """PRJ-15, PRJ-16: normalized products as the texts that are scored; what is missing is null and not ''."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    named = ("title", "currency", "description", "image_url", "vendor", "in_stock", "sku", "product_type", "product_url")
    return products.select("shop_id", *(text(c).alias(c) for c in named), F.when(F.col("price") > 0, text("price")).alias("price"))


def offer_price(offers: Column) -> Column:
    """PRJ-15: price of an offer, of the first of a list, or the low price of an aggregate."""
    get = lambda p: F.nullif(F.try_variant_get(offers, p, "string"), F.lit(""))
    return F.coalesce(get("$.price"), get("$.lowPrice"), get("$[0].price"), get("$.offers[0].price"))


def history(runs: DataFrame, scores: str = "scores") -> DataFrame:
    """AGG-18, SRC-15: rows of (timestamp, scores: map of site to map of tier to struct) as one row for each site and tier, ready for averages by run."""
    sites = runs.select("timestamp", F.explode(scores).alias("site", "tiers"))
    return sites.select("timestamp", "site", F.explode("tiers").alias("tier", "s")).select("timestamp", "site", "tier", F.col("s.avg_score").alias("avg_score"), F.col("s.overall_score").alias("overall_score"))


def run_averages(history: DataFrame, site: str | None = None, tier: str | None = None) -> DataFrame:
    """AGG-18: of each run (timestamp) how many sites it has and the mean overall score of all sites and tiers, or of one site or tier; and the change from the run before."""
    some = history.where((F.lit(site).isNull() | (F.col("site") == F.lit(site))) & (F.lit(tier).isNull() | (F.col("tier") == F.lit(tier))))
    by_run = some.groupBy("timestamp").agg(F.count_distinct("site").alias("sites"), F.avg("overall_score").alias("mean"))
    trend = F.col("mean") - F.lag("mean").over(Window.orderBy("timestamp"))  # a row for each run
    return by_run.select("timestamp", "sites", F.round("mean", 4).alias("mean"), F.round(trend, 4).alias("change"))


def best_of_sites(tiers: DataFrame, site: str, tier: str, score: str) -> DataFrame:
    """AGG-19: mean over sites of the score of each site's best tier, and how many sites each tier is best of."""
    best = best_tier(tiers, site, tier, score)
    return best.groupBy("best_tier").agg(F.count("*").alias("sites")).join(F.broadcast(best.agg(F.round(F.avg("best_score"), 4).alias("mean_best"))))  # one row
