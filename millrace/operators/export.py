"""Feeds and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from millrace.functions import text
from millrace.functions.presence import first_truthy, truthy

#: The feed's columns in order.
FEED_COLUMNS = ("sku", "brand", "title", "categoryPath", "url", "imageUrls", "eans", "hans", "price", "deliveryCosts", "delivery", "paymentCosts", "description", "conditionType")


def exportable(sku: str, external_id: str, title: str, price: str) -> Column:
    """FLT-17."""
    return (truthy(sku) | truthy(external_id)) & truthy(title) & F.coalesce(F.col(price) != 0, F.lit(False))


def feed_rows(df: DataFrame, brand: Column, delivery: str = "", delivery_costs: str = "", payment_costs: str = "") -> DataFrame:
    """PRJ-18: rows of the feed from products; brand stands in where a vendor is missing, the last three are the shop's settings."""
    path = F.coalesce(F.nullif(F.array_join("category_path", " > "), F.lit("")), F.col("product_type"), F.lit(""))
    images = F.array_join(F.filter(F.concat(F.array("image_url"), F.coalesce("additional_images", F.array().cast("array<string>"))), lambda x: truthy(x)), ";")
    plain = lambda c: F.coalesce(c, F.lit(""))
    columns = {
        "sku": first_truthy("sku", "external_id"), "brand": F.coalesce(first_truthy("vendor"), brand), "title": F.col("title"), "categoryPath": path, "url": plain("product_url"), "imageUrls": images, "eans": plain("gtin"), "hans": plain("mpn"),
        "price": F.format_string("%.2f", F.col("price").cast("double")), "deliveryCosts": F.lit(delivery_costs), "delivery": F.lit(delivery), "paymentCosts": F.lit(payment_costs), "description": text.feed_text(plain("description")), "conditionType": F.upper(plain("condition")),
    }
    return df.where(exportable("sku", "external_id", "title", "price")).select(*(columns[c].alias(c) for c in FEED_COLUMNS))


def write_feed(rows: DataFrame, path: str) -> None:
    """SNK-07, T17: comma CSV with a head; one part for each partition, since a feed grows with the catalog."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def offers(rows: DataFrame) -> DataFrame:
    """SNK-08: sku and the offer as JSON; keys without a value are left out."""
    return rows.select("sku", F.to_json(F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("sku", "title", "price", "url", "brand", "description", "categoryPath", "eans", "imageUrls")))).alias("offer"))


def readiness(df: DataFrame, *by: str) -> DataFrame:
    """AGG-20, DQ-05: rows, what they lack and how many lack nothing."""
    gaps = {"brand": ~truthy("vendor"), "gtin": ~truthy("gtin"), "id": ~(truthy("sku") | truthy("external_id"))}
    none = ~gaps["brand"] & ~gaps["gtin"] & ~gaps["id"]
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(g).alias(f"missing_{n}") for n, g in gaps.items()), F.count_if(none).alias("ready"))


def as_json(reports: DataFrame, *keys: str) -> DataFrame:
    """SNK-09: each report as one JSON document beside its keys."""
    return reports.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def row_documents(rows: DataFrame, json_fields: tuple[str, ...] = ("variants", "tags", "raw_data", "additional_images", "category_path")) -> DataFrame:
    """PRJ-22: each row as one JSON document (`json`) beside its columns: decimals are numbers, times ISO text, and json_fields are what they hold where that is JSON, else text. Nulls stay."""

    def safe(f: StructField) -> Column:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "decimal":
            return c.cast("double")
        if kind in ("timestamp", "timestamp_ntz"):
            text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            return F.regexp_replace(text, r"\.000000$", "")
        if kind == "string" and f.name in json_fields:
            scalar = r'^\s*(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|"(?:[^"\\]|\\.)*+")\s*$'
            whole = F.when(c.rlike(r"[}\]]\s*$") | c.rlike(scalar), F.try_parse_json(c))  # the parser stops behind the first value
            return F.coalesce(whole, F.when(c.isNotNull(), F.try_variant_get(F.parse_json(F.to_json(F.array(c))), "$[0]", "variant")))
        return c

    return rows.withColumn("json", F.to_json(F.struct(*(safe(f).alias(f.name) for f in rows.schema.fields)), {"ignoreNullFields": "false"}))


def save_run(reports: DataFrame, path: str) -> None:
    """SNK-10: a run is added to the history, as JSON lines."""
    reports.write.mode("append").json(path)


def save_baseline(reports: DataFrame, path: str) -> None:
    """SNK-10: the baseline is replaced."""
    reports.write.mode("overwrite").json(path)


def dead_letters(letters: DataFrame, failures: DataFrame, url: str, error: str, at: Column, keep_days: int = 30) -> DataFrame:
    """SNK-14, SRC-22: the queue of failed jobs after new ones: each under a key of its own, those past their time gone."""
    new = failures.select(F.uuid().alias("entry"), F.col(url).alias("url"), F.col(error).alias("error"), at.alias("failed_at"))
    return letters.unionByName(new).where(F.col("failed_at") > at - F.make_dt_interval(F.lit(keep_days)))


def retried(letters: DataFrame, entries: DataFrame) -> DataFrame:
    """SNK-14: the queue without the entries that are tried again."""
    return letters.join(entries.select("entry").distinct(), "entry", "left_anti")
