"""Products of crawled pages from four layers: JSON-LD, OpenGraph, the page as Markdown, and its images (EXT-05, JOIN-09, JOIN-12 to JOIN-14, FLT-15, SORT-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import money
from millrace.functions.presence import column, first_truthy, strip
from millrace.operators import catalog, extract


#: The marks of a title in Markdown, the best first.
TITLE_MARKS = (r"#\s+(.+)$", r"##\s+(.+)$", r"\*\*(.+?)\*\*")


def markdown_title(c: Column | str) -> Column:
    """The first heading, else the first of the second order, else bold words at the beginning of a line; of 3 to 300 characters."""
    found = (strip(F.regexp_extract(column(c), rf"(?md)^{mark}", 1)) for mark in TITLE_MARKS)
    return F.coalesce(*(F.when(F.length(t).between(3, 300), t) for t in found))


def usable(price: Column) -> Column:
    """A price as text, null where it is blank or 0."""
    return F.when(F.coalesce(extract.usable(price), F.lit(False)), price)


def node_products(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Each page's JSON-LD products: of those with one name (in any case), price and number the one with most that isn't empty, of equals the first."""
    get = lambda p: F.nullif(F.try_variant_get("node", p, "string"), F.lit(""))
    of = lambda p: F.nullif(F.try_variant_get("offers", p, "string"), F.lit(""))
    listed = F.filter(F.transform(F.try_variant_get("offers", "$", "array<variant>"), lambda o: F.try_variant_get(o, "$.price", "string")), lambda p: F.coalesce(extract.usable(p), F.lit(False)))
    entries = F.map_values(F.try_variant_get("node", "$", "map<string,variant>"))
    full = F.size(F.filter(entries, lambda v: ~F.to_json(v).isin("null", '""', "0", "false", "[]", "{}")))
    image = F.coalesce(get("$.image.url"), get("$.image[0].url"), get("$.image[0]"), get("$.image"))
    rows = extract.products(pages, html, key).select(
        F.col(key).alias("_page"), "script", "place", "inner", full.alias("full"), strip(get("$.name")).alias("name"), F.coalesce(usable(get("$.price")), usable(of("$.price")), F.get(listed, F.lit(0))).alias("price"),
        F.coalesce(get("$.priceCurrency"), of("$.priceCurrency"), of("$[0].priceCurrency")).alias("currency"), F.coalesce(get("$.sku"), get("$.productID")).alias("sku"), image.alias("image"), get("$.description").alias("description"),
    )
    same = F.concat_ws("\x1f", F.lower(F.coalesce("name", F.lit(""))), F.coalesce("price", F.lit("")), F.coalesce("sku", F.lit("")))
    return catalog.last_by_key(rows.withColumn("_same", same), ["_page", "_same"], ["full", *((-F.col(c)).alias(f"_{c}") for c in ("script", "place", "inner"))]).drop("_same", "full")


def crawled_products(pages: DataFrame, key: str, html: str = "html", metadata: str = "metadata", markdown: str = "markdown", images: str = "images") -> DataFrame:
    """key, name, price, currency, sku, image and description of the products of crawled pages: html, metadata (map of text), markdown and images (array of struct src, score), all of which may be null.

    A layer fills what those before left empty and overwrites nothing: a page's JSON-LD products, OpenGraph (metadata before HTML), Markdown, the best image. A currency of Markdown comes with its price only. A
    page without JSON-LD is one product if something tells that it is: its OpenGraph type or a price. key must tell pages apart."""
    read = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html"), extract.opengraph(html).alias("_tags"), extract.open_graph_of(metadata).alias("_meta"), money.text_price(markdown).alias("_md"), markdown_title(markdown).alias("_title"), extract.best_image(images).alias("_best"))
    og = lambda name: F.coalesce(F.nullif(F.try_element_at("_meta", F.lit(name)), F.lit("")), F.nullif(F.try_element_at("_tags", F.lit(name)), F.lit("")))
    tags = {c: og(name) for c, name in (("type", "og:type"), ("name", "og:title"), ("image", "og:image"), ("description", "og:description"), ("og_price", "og:price:amount"), ("product_price", "product:price:amount"), ("currency", "product:price:currency"))}
    read = read.select("_key", "_md", "_title", "_best", *(v.alias(f"_og_{c}") for c, v in tags.items()))
    joined = read.join(node_products(pages, key, html).withColumn("_found", F.lit(True)), F.col("_key") == F.col("_page"), "left")
    told = F.contains(F.lower(F.coalesce("_og_type", F.lit(""))), F.lit("product")) | F.coalesce(usable(F.col("_og_og_price")), usable(F.col("_og_product_price")), F.col("_md.amount")).isNotNull()
    own = F.coalesce(F.col("price"), usable(F.col("_og_og_price")), usable(F.col("_og_product_price")))
    currency = F.coalesce(F.col("currency"), F.col("_og_currency"), F.when(own.isNull(), F.col("_md.currency")))
    return joined.where(F.coalesce("_found", told)).select(F.col("_key").alias(key), first_truthy(F.col("name"), F.col("_og_name"), F.col("_title")).alias("name"), F.coalesce(own, F.col("_md.amount")).alias("price"), currency.alias("currency"), "sku", F.coalesce("image", "_og_image", "_best").alias("image"), F.coalesce("description", "_og_description").alias("description"))
