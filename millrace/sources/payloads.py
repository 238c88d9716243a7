"""API payloads, fixtures and logs: JSON documents to raw records, and the maps of administration APIs to the shapes that normalizing knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.presence import first_truthy, truthy
from millrace.operators.normalize import Raw, behind_first, item, texts


def parsed(bodies: DataFrame, body: str) -> DataFrame:
    """Objects and arrays; the parser stops behind the first value, so a body that goes on with something else is refused here."""
    return bodies.where(F.col(body).rlike(r"[}\]]\s*$")).withColumn("doc", F.try_parse_json(body)).where("doc is not null")


def records(bodies: DataFrame, body: str, path: str, *keep: str) -> DataFrame:
    """SRC-05 to SRC-12: a row for each member of the array at path ('$.products', '$.items', '$.data' or '$'). Broken documents give none (DQ-06)."""
    return parsed(bodies, body).select(*keep, F.explode(F.try_variant_get("doc", path, "array<variant>")).alias("raw"))


def paging(pages: DataFrame, job: str, page: str, n: str, total: str, size: int, most_pages: int) -> DataFrame:
    """SRC-05 to SRC-07, WIN-05: for each job the pages read and expected, and whether it is complete: the total was reached or a page wasn't full, within most_pages."""
    return pages.groupBy(job).agg(
        F.count("*").alias("pages_completed"), F.ceil(F.max(total) / size).alias("pages_expected"), F.sum(n).alias("products"),
        ((F.coalesce(F.sum(n) >= F.max(total), F.lit(False)) | (F.min(n) < size)) & (F.max(page) <= most_pages)).alias("complete"),
    )


def fetched(responses: DataFrame, job: str, path: str, size: int, most_pages: int = 100) -> tuple[DataFrame, DataFrame]:
    """SRC-05, SRC-06: records (job, page, raw) of public APIs that are read page by page, and the outcome of each job: products, pages_completed, complete and error.

    responses: job, page (from 1 on), attempt, status, body, currency (of the shop's cookie, may be null). Of a page the last attempt counts. A job ends at the first page that isn't there, fails, holds
    nothing or isn't full; what came before stays. A missing page behind others ends it well (404), one that was refused, broken or no list doesn't. The first currency of a job goes into
    its records. A job has no more than most_pages pages.
    """
    last = responses.where(F.col("page").between(1, most_pages)).groupBy(job, "page").agg(F.max_by(F.struct("status", "body"), "attempt").alias("x"), F.min_by("currency", "attempt").alias("currency")).select(job, "page", "x.status", "x.body", "currency")
    doc = F.when(F.col("body").rlike(r"[}\]]\s*$"), F.try_parse_json("body"))
    read = last.withColumn("doc", F.when(F.col("status") == 200, doc)).withColumn("items", F.coalesce(F.try_variant_get("doc", path, "array<variant>"), F.when(F.lit(path != "$") & F.try_variant_get("doc", path, "variant").isNull(), F.array().cast("array<variant>"))))
    status = F.col("status")
    read = read.withColumn(
        "failed",
        F.when(status == 429, "rate limited").when(status == 404, "not found").when(status >= 500, "server error").when(status != 200, "refused").when(F.col("doc").isNull(), "invalid JSON").when(F.col("items").isNull(), "unexpected format"),
    )
    n = F.coalesce(F.size("items"), F.lit(0))
    seen = Window.partitionBy(job).orderBy("page")  # most_pages rows at the most
    read = read.withColumn("gap", F.row_number().over(seen) != F.col("page")).withColumn("n", F.when(F.col("failed").isNull(), n).otherwise(0))
    ended = F.min(F.when(F.col("failed").isNotNull() | F.col("gap") | (F.col("n") < size), F.col("page"))).over(Window.partitionBy(job))
    read = read.withColumn("ended", ended).withColumn("shop_currency", F.first("currency", ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = read.where((F.col("ended").isNull() | (F.col("page") <= F.col("ended"))) & F.col("failed").isNull() & ~F.col("gap"))
    item = F.when(F.col("shop_currency").isNull(), F.col("raw")).otherwise(F.parse_json(F.regexp_replace(F.to_json("raw"), r"\}$", F.concat(F.lit(',"_shop_currency":"'), F.regexp_replace("shop_currency", "[^A-Za-z]", ""), F.lit('"}')))))
    rows = kept.select(job, "page", "shop_currency", F.explode("items").alias("raw")).select(job, "page", item.alias("raw"))
    at_end = lambda c: F.max(F.when((F.col("page") == F.col("ended")) & ~F.col("gap"), c))
    inside = F.sum(F.when((F.col("ended").isNull() | (F.col("page") <= F.col("ended"))) & ~F.col("gap"), F.col("n")).otherwise(0))
    done = read.groupBy(job).agg(inside.alias("products"), F.max("ended").alias("_ended"), F.max("page").alias("_last"), at_end(F.col("failed")).alias("_failed"))
    until = F.coalesce("_ended", F.col("_last") + 1)
    error = F.when((F.col("_failed") == "not found") & (F.col("products") > 0), None).otherwise(F.concat("_failed", F.lit(" on page "), F.col("_ended").cast("string")))
    jobs = done.select(job, "products", F.when(until > 1, until - 1).otherwise(F.when(F.col("products") > 0, 1).otherwise(0)).cast("bigint").alias("pages_completed"), error.isNull().alias("complete"), error.alias("error"))
    return rows, jobs


def keep_fields(raw: Column, fields: dict[str, Column]) -> Column:
    return F.parse_json(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))))


def bigcommerce(rows: DataFrame, brands: DataFrame, currency: str = "USD") -> DataFrame:
    """SRC-09, PRJ-11, JOIN-07: brand names by id ('' where unknown), images by their order, stock from availability and inventory."""
    r = Raw(F.col("raw"))
    images = F.array_sort(r.items("images"), lambda a, b: F.coalesce(item(a, "sort_order", "int"), F.lit(0)) - F.coalesce(item(b, "sort_order", "int"), F.lit(0)))
    named = rows.withColumn("_brand", r.at("brand_id", "bigint")).join(brands.select(F.col("id").alias("_brand"), F.col("name").alias("_name")), "_brand", "left")
    fields = {
        "id": r.at("id"), "title": r.at("name"), "description": r.at("description"), "price": r.at("price"), "sku": r.at("sku"), "gtin": first_truthy(r.at("upc"), r.at("gtin"), r.at("variants/[0]/upc")), "mpn": r.at("mpn"), "vendor": F.coalesce("_name", F.lit("")),
        "image": item(F.get(images, F.lit(0)), "url_standard"), "additional_images": texts(behind_first(images), "url_standard"), "url": r.at("custom_url/url"), "in_stock": (r.at("availability") != "disabled") & (r.at("inventory_level", "int") > 0), "tags": texts(r.items("categories")), "currency": F.lit(currency),
    }
    return named.withColumn("raw", keep_fields(F.col("raw"), fields)).drop("_brand", "_name")


#: Meta keys under which plugins keep identifiers.
IDENTIFIER_KEYS = ("_wpm_gtin_code", "_alg_ean", "_ean", "hwp_product_gtin", "hwp_var_gtin", "_yith_barcode_value", "_barcode", "_ts_gtin", "_gtin", "gtin", "ean", "upc", "barcode", "isbn", "_upc", "_isbn")


def meta_identifier(meta: Column) -> Column:
    """FN-07: of an item's meta data the first value of eight digits or more under a known key, else under a key that looks like one."""
    value = lambda m: F.trim(item(m, "value"))
    digits = lambda m: F.length(F.regexp_replace(value(m), "[^0-9]", "")) >= 8
    known = F.filter(meta, lambda m: item(m, "key").isin(*IDENTIFIER_KEYS) & digits(m))
    likely = F.filter(meta, lambda m: F.lower(item(m, "key")).rlike("gtin|ean|upc|barcode|isbn") & digits(m))
    return F.coalesce(value(F.get(known, F.lit(0))), value(F.get(likely, F.lit(0))))


def variation_rows(variations: DataFrame) -> DataFrame:
    """SRC-10: _product and _variants: the variations (product_id, seq, raw) of each product in order, as variants; the API serves no more than a thousand of a product."""
    r = Raw(F.col("raw"))
    title = F.array_join(F.transform(r.items("attributes"), lambda x: F.coalesce(item(x, "option"), F.lit(""))), " / ")
    one = F.struct(
        F.col("seq").alias("seq"), F.coalesce(r.at("id"), F.lit("")).alias("id"), title.alias("title"), F.coalesce(r.at("price"), F.lit("")).alias("price"), F.coalesce(r.at("sku"), F.lit("")).alias("sku"),
        F.coalesce(meta_identifier(r.items("meta_data")), F.lit("")).alias("barcode"), F.coalesce(r.at("stock_quantity", "bigint"), F.lit(0)).alias("inventory_quantity"),
    )
    packed = variations.groupBy(F.col("product_id").alias("_product")).agg(F.array_sort(F.collect_list(one)).alias("_variants"))
    return packed.withColumn("_variants", F.transform("_variants", lambda v: F.struct(*(v[c].alias(c) for c in ("id", "title", "price", "sku", "barcode", "inventory_quantity")))))


def woocommerce_admin(rows: DataFrame, variations: DataFrame | None = None) -> DataFrame:
    """SRC-10, PRJ-12, FN-07: compare-at only beside a sale price; GTINs from known meta keys, then from keys that look like one; variable products get their variations (product_id, seq, raw) as variants."""
    r = Raw(F.col("raw"))
    columns = rows.columns
    if variations is not None:
        rows = rows.withColumn("_id", r.at("id", "bigint")).join(variation_rows(variations), F.col("_id") == F.col("_product"), "left")
    fields = {
        "_source": F.lit("woocommerce_admin_api"), "id": r.at("id"), "title": r.at("name"), "description": first_truthy(r.at("description"), r.at("short_description")), "price": first_truthy(r.at("price"), r.at("regular_price")),
        "compare_at_price": F.when(truthy(r.at("sale_price")), r.at("regular_price")), "sku": r.at("sku"), "gtin": meta_identifier(r.items("meta_data")), "permalink": r.at("permalink"), "in_stock": r.at("stock_status") == "instock",
        "image_url": r.at("images/[0]/src"), "additional_images": texts(behind_first(r.items("images")), "src"), "tags": texts(r.items("tags"), "name"), "categories": texts(r.items("categories"), "name"), "currency": F.coalesce(r.at("currency"), F.lit("USD")),
    }
    if variations is not None:
        fields["variants"] = F.when(r.at("type") == "variable", F.col("_variants"))
    return rows.withColumn("raw", keep_fields(F.col("raw"), fields)).select(columns)


GTIN_CODES = ("ean", "gtin", "gtin13", "barcode", "upc", "ean13")


def magento_admin(rows: DataFrame) -> DataFrame:
    """SRC-11, PRJ-13, FN-08: visible, enabled products; GTIN by the order of attribute codes."""
    r = Raw(F.col("raw"))
    attributes = r.items("custom_attributes")
    value = lambda code: first_truthy(item(F.try_element_at(F.filter(attributes, lambda a: item(a, "attribute_code") == code), F.lit(-1)), "value"))
    shown = (F.coalesce(r.at("visibility", "int"), F.lit(4)) == 4) & (F.coalesce(r.at("status", "int"), F.lit(1)) == 1)
    fields = {"id": r.at("id"), "title": r.at("name"), "sku": r.at("sku"), "price": r.at("price"), "description": value("description"), "gtin": F.coalesce(*map(value, GTIN_CODES)), "vendor": value("manufacturer"), "in_stock": F.coalesce(r.at("extension_attributes/stock_item/is_in_stock", "boolean"), F.lit(True)), "currency": F.coalesce(r.at("currency"), F.lit("USD"))}
    return rows.where(shown).withColumn("raw", keep_fields(F.col("raw"), fields))


def shopware_admin(rows: DataFrame, shop_url: str) -> DataFrame:
    """SRC-12, PRJ-14: active parents; gross prices, cover and other media, children as variants."""
    r = Raw(F.col("raw"))
    cover = first_truthy(r.at("cover/media/url"), r.at("media/[0]/media/url"))
    others = F.filter(F.transform(r.items("media"), lambda m: item(m, "media/url")), lambda u: truthy(u) & ~u.eqNullSafe(cover))
    child = lambda c: F.struct(item(c, "id").alias("variant_id"), F.coalesce(item(c, "translated/name"), item(c, "name")).alias("title"), item(c, "price/[0]/gross").alias("price"), item(c, "productNumber").alias("sku"), (F.coalesce(item(c, "stock", "int"), F.lit(0)) > 0).alias("in_stock"))
    fields = {
        "id": r.at("id"), "title": F.coalesce(r.at("translated/name"), r.at("name")), "description": F.coalesce(r.at("translated/description"), r.at("description")), "price": r.at("price/[0]/gross"), "compare_at_price": r.at("price/[0]/listPrice/gross"), "sku": r.at("productNumber"), "ean": r.at("ean"),
        "vendor": F.coalesce(r.at("manufacturer/translated/name"), r.at("manufacturer/name")), "in_stock": (F.coalesce(r.at("stock", "int"), F.lit(0)) > 0) & F.coalesce(r.at("active", "boolean"), F.lit(False)), "image_url": cover, "additional_images": others, "tags": texts(r.items("tags"), "name"),
        "variants": F.transform(r.items("children"), child), "product_url": F.concat(F.lit(shop_url.rstrip("/") + "/detail/"), r.at("id")), "currency": F.lit("EUR"),
    }
    return rows.where(r.at("parentId").isNull() & F.coalesce(r.at("active", "boolean"), F.lit(True))).withColumn("raw", keep_fields(F.col("raw"), fields))


def benchmark_records(rows: DataFrame) -> DataFrame:
    """PRJ-17: expected products of benchmark records; an attribute wins over the column of its name, the last of a key counts."""
    r = Raw(F.col("raw"))
    attributes = r.items("attributes")
    value = lambda key: first_truthy(item(F.try_element_at(F.filter(attributes, lambda a: F.lower(item(a, "key")) == key), F.lit(-1)), "value"))
    field = lambda name: F.coalesce(value(name), r.at(name))
    return rows.where(truthy(r.at("title"))).select(r.at("title").alias("title"), field("brand").alias("vendor"), field("price").alias("price"), r.at("currency").alias("currency"), r.at("category").alias("product_type"), r.at("url").alias("product_url"), r.at("description").alias("description"))


def profile(pages: DataFrame) -> DataFrame:
    """PRJ-20: merchant profiles from raw (VARIANT): fallbacks and lengths of each field (T4)."""
    r = Raw(F.col("raw"))
    name = first_truthy(r.at("jsonld_company_name"), r.at("og_site_name"), r.at("title_tag"))
    logo = first_truthy(r.at("jsonld_logo/url"), r.at("jsonld_logo/[0]"), r.at("jsonld_logo"), r.at("favicon_url"))
    told = first_truthy(r.at("jsonld_description"), r.at("meta_description"), r.at("og_description"))
    country = F.coalesce(r.at("address_country/name"), r.at("address_country"))
    return pages.where(truthy(name)).select("shop_id", F.trim(name).alias("company_name"), logo.alias("logo_url"), F.substring(told, 1, 2000).alias("description"), F.substring(r.at("about_text"), 1, 5000).alias("about_text"), F.substring(country, 1, 100).alias("country"), F.substring(r.at("currency"), 1, 3).alias("currency"), F.substring(r.at("language"), 1, 10).alias("language"), text.founding_year(r.at("founding_date")).alias("founding_year"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16, SRC-17: one document a file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("file"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: blank lines are skipped."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("raw")).where("raw is not null")
