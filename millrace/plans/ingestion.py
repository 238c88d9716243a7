"""From fetched bodies to a catalog: the flow of one ingestion as a chain of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.presence import filled, truthy
from millrace.operators import catalog, extract, normalize, quality
from millrace.sinks.buckets import BucketTable
from millrace.sources import feeds

#: Fields of the catalog's table beside those of a product.
STORED = ("shop_id", "platform", *normalize.FIELDS, "idempotency_key", "created_at", "updated_at")
#: Where a record comes from: the place of its body, whether that is a page, and the record's place in it.
PLACE = ("body_at", "from_page", "record_at")
#: What an upsert leaves as it was.
KEPT = ("external_id", "shop_id", "platform", "created_at")


def raw_records(bodies: DataFrame) -> DataFrame:
    """SET-01: raw records of bodies (shop_id, platform, shop_url, url, body, content_type): feeds by kind, pages by their JSON-LD; with PLACE.

    Bodies come in the order of their column `seq`; without one, in the order in which they are read."""
    keep = ("shop_id", "platform", "shop_url", "body_at")
    bodies = bodies.withColumn("body_at", F.col("seq").cast("bigint") if "seq" in bodies.columns else F.monotonically_increasing_id())
    is_page = F.coalesce(F.lower("content_type").startswith("text/html"), F.lit(False))
    from_feeds = feeds.feeds(bodies.where(~is_page), "body", "content_type", *keep).select(*keep, F.lit(False).alias("from_page"), F.struct(F.col("pos").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("record_at"), "raw")
    nodes = extract.products(bodies.where(is_page), "body", *keep)
    at = F.struct(F.col("script").alias("a"), F.col("place").alias("b"), F.col("inner").alias("c")).alias("record_at")
    return from_feeds.unionByName(nodes.select(*keep, F.lit(True).alias("from_page"), at, F.col("node").alias("raw")))


def accepted(records: DataFrame, as_of: Column) -> DataFrame:
    """Valid products, one for each idempotency key: that of the last body that has it (WIN-01), and there of a feed the last record, of a page the richest and of equals the first (WIN-02)."""
    good = normalize.normalize(records, *PLACE).where("is_valid").drop("raw", "reject_reason", "is_valid")
    stamped = good.withColumn("created_at", as_of).withColumn("updated_at", as_of)
    rich = sum((filled(c).cast("int") for c in ("image_url", "description", "gtin", "vendor", "mpn")), F.lit(0))
    way = F.when(F.col("from_page"), -1).otherwise(1)
    order = ["body_at", F.when(F.col("from_page"), rich).otherwise(0).alias("_rich"), *((way * F.col(f"record_at.{x}")).alias(f"_{x}") for x in "abc")]
    return catalog.last_by_key(stamped, ["idempotency_key"], order).select(*STORED)


def ingest(target: DataFrame, bodies: DataFrame, as_of: Column) -> DataFrame:
    """SNK-01: the catalog after one batch; ids and the time of creation stay as they were."""
    return catalog.upsert(target, accepted(raw_records(bodies), as_of), "idempotency_key", keep=list(KEPT))


def into(target: BucketTable, products: DataFrame, source: str = "", batch: int | None = None) -> dict[str, int]:
    """SNK-01: accepted products into a table in place: only their buckets are written, and a batch that came before changes nothing."""
    return target.upsert(products, keep=KEPT, source=source, batch=batch)


def report(records: DataFrame) -> DataFrame:
    """AGG-09, AGG-14, DQ-01, DQ-04: for each shop the rows read, rejected, the share dropped, mean quality and the verdict."""
    rows = normalize.normalize(records)
    score = quality.quality(filled("title"), {"price": F.col("price") > 0, "image": truthy("image_url"), "description": filled("description"), "sku": truthy("sku")})
    by = rows.groupBy("shop_id").agg(F.count("*").alias("n"), F.count_if(~F.col("is_valid")).alias("rejected"), F.round(F.coalesce(F.avg(F.when(F.col("is_valid"), score)), F.lit(0.0)), 4).alias("quality"))
    return by.withColumn("dropped", F.round(F.col("rejected") / F.col("n"), 4)).withColumn("verdict", quality.verdict(F.col("n") - F.col("rejected"), F.col("quality")))


def gaps_filled(products: DataFrame, fills: DataFrame, key: str, columns: list[str], from_api: Column) -> DataFrame:
    """JOIN-10, JOIN-13, FLT-23: columns that are blank take the value that was fetched again; rows from an API take images alone.

    fills has one row for each key (extract.layered makes one)."""
    other = fills.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = products.join(other, products[key] == other["_key"], "left")
    fill = lambda c: F.when(~filled(c) & (F.lit(c.startswith("image")) | ~from_api), F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c))
    return joined.select(*((fill(c) if c in columns else F.col(c)).alias(c) for c in products.columns))
