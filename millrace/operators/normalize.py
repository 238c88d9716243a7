"""Raw records of several shapes, as VARIANT, to one product row. Each shape is a struct of candidate columns; the router takes the first that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import money, text
from millrace.functions.presence import first_truthy, once, strip, truthy

VARIANT_ITEM = "struct<variant_id:string,title:string,price:decimal(12,2),sku:string,in_stock:boolean>"
FIELDS = {
    "external_id": "string", "title": "string", "description": "string", "price": "decimal(38,6)", "compare_at_price": "decimal(38,6)", "currency": "string",
    "image_url": "string", "product_url": "string", "sku": "string", "gtin": "string", "mpn": "string", "vendor": "string", "product_type": "string",
    "in_stock": "boolean", "condition": "string", "variants": f"array<{VARIANT_ITEM}>", "tags": "array<string>", "additional_images": "array<string>", "category_path": "array<string>",
}


class Raw:
    """Paths of one VARIANT column."""

    def __init__(self, column: Column) -> None:
        self.column = column

    def at(self, path: str, kind: str = "string") -> Column:
        """The value at a path below the root, null if it isn't there or doesn't fit."""
        keys = "".join(k if k.startswith("[") else f"['{k}']" for k in path.split("/"))
        return F.try_variant_get(self.column, f"${keys}", kind)

    def items(self, path: str) -> Column:
        return F.coalesce(self.at(path, "array<variant>"), F.array().cast("array<variant>"))

    def number(self, path: str) -> Column:
        """0 if it isn't a number."""
        return F.coalesce(self.at(path).try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))


def item(x: Column, path: str, kind: str = "string") -> Column:
    return Raw(x).at(path, kind)


def texts(items: Column, path: str | None = None) -> Column:
    """Texts of an array of VARIANT (or of one key of each), without empty ones."""
    got = F.transform(items, lambda x: item(x, path) if path else x.try_cast("string"))
    return F.filter(got, lambda x: truthy(x))


def behind_first(items: Column) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))


def product(**columns: Column) -> Column:
    """A struct of all fields; those not given are null, arrays empty, in_stock true."""
    fill = {"in_stock": F.lit(True), **{k: F.array() for k, t in FIELDS.items() if t.startswith("array")}}
    return F.struct(*(columns.get(k, fill.get(k, F.lit(None))).cast(t).alias(k) for k, t in FIELDS.items()))


def differs(price: Column, other: Column) -> Column:
    return F.when(other != price, other)


def variant_rows(items: Column, id_: str, stock: Column | None = None) -> Column:
    """Children of a product; those whose price isn't a number of at most two places are left out (T3)."""
    def one(v: Column) -> Column:
        price = F.coalesce(item(v, "price"), F.lit("0")).try_cast("decimal(38,6)")
        quantity = item(v, "inventory_quantity").try_cast("bigint")
        in_stock = F.coalesce(quantity > 0, item(v, "in_stock", "boolean"), F.lit(True))
        return F.struct(F.coalesce(item(v, id_), item(v, "id"), F.lit("")).alias("variant_id"), F.coalesce(item(v, "title"), item(v, "name"), F.lit("")).alias("title"), F.when(money.two_places(price), price).cast("decimal(12,2)").alias("price"), item(v, "sku").alias("sku"), in_stock.alias("in_stock"))

    return F.filter(F.transform(items, one), lambda v: v["price"].isNotNull())


def shopify(raw: Raw, shop_url: Column) -> Column:
    """PRJ-02."""
    variants, images = raw.items("variants"), raw.items("images")
    tags = F.coalesce(texts(raw.at("tags", "array<variant>")), F.filter(F.transform(F.split(F.coalesce(raw.at("tags"), F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != ""))
    stocked = F.exists(variants, lambda v: F.coalesce(item(v, "inventory_quantity").try_cast("bigint") > 0, F.lit(True)))
    kind = raw.at("product_type")
    return product(
        external_id=F.coalesce(raw.at("id"), F.lit("")), title=strip(raw.at("title")), description=text.sanitized(F.coalesce(raw.at("body_html"), F.lit(""))),
        price=raw.number("variants/[0]/price"), compare_at_price=raw.at("variants/[0]/compare_at_price").try_cast("decimal(38,6)"), currency=F.coalesce(raw.at("_shop_currency"), F.lit("USD")),
        image_url=F.coalesce(raw.at("images/[0]/src"), F.lit("")), product_url=F.when(truthy(raw.at("handle")), F.concat(F.regexp_replace(shop_url, "/+$", ""), F.lit("/products/"), raw.at("handle"))).otherwise(shop_url),
        sku=raw.at("variants/[0]/sku"), gtin=text.valid_gtin(raw.at("variants/[0]/barcode")), vendor=raw.at("vendor"), product_type=kind, in_stock=(F.size(variants) == 0) | stocked,
        variants=variant_rows(variants, "id"), tags=tags, additional_images=texts(behind_first(images), "src"), category_path=F.when(truthy(kind), F.array(kind)).otherwise(F.array().cast("array<string>")),
    )


def woocommerce(raw: Raw, shop_url: Column) -> Column:
    """PRJ-03: minor units in the store's shape, a plain text in the administration's. Stock and vendor are not taken over (T6)."""
    admin = F.coalesce(raw.at("_source") == "woocommerce_admin_api", F.lit(False)) | raw.at("price").isNotNull() & raw.at("prices", "variant").isNull()
    unit = F.pow(F.lit(10), F.coalesce(raw.at("prices/currency_minor_unit", "int"), F.lit(2))).cast("decimal(20,0)")
    minor = lambda path: F.try_divide(raw.at(path).try_cast("decimal(20,0)"), unit).cast("decimal(38,6)")
    price = F.when(admin, raw.number("price")).otherwise(F.coalesce(minor("prices/price"), F.lit(0)))
    other = F.when(admin, raw.at("compare_at_price").try_cast("decimal(38,6)")).otherwise(minor("prices/regular_price"))
    images = raw.items("images")
    named = lambda path: F.when(raw.at(f"{path}/[0]/name").isNotNull(), texts(raw.items(path), "name")).otherwise(texts(raw.items(path)))
    return product(
        external_id=F.coalesce(raw.at("id"), F.lit("")), title=strip(first_truthy(raw.at("title"), raw.at("name"))), description=text.sanitized(F.coalesce(raw.at("description"), F.lit(""))),
        price=price, compare_at_price=differs(price, other), currency=F.when(admin, F.coalesce(raw.at("currency"), F.lit("USD"))).otherwise(F.coalesce(raw.at("prices/currency_code"), F.lit("USD"))),
        image_url=F.coalesce(raw.at("images/[0]/src"), raw.at("image_url"), F.lit("")), product_url=F.coalesce(first_truthy(raw.at("permalink"), raw.at("product_url")), F.lit("")), sku=raw.at("sku"),
        gtin=text.valid_gtin(first_truthy(raw.at("gtin"), raw.at("ean"), raw.at("barcode"))), mpn=first_truthy(raw.at("mpn")), tags=named("tags"),
        additional_images=F.when(F.size(images) > 0, texts(behind_first(images), "src")).otherwise(texts(raw.items("additional_images"))), category_path=named("categories"),
    )


def magento(raw: Raw, shop_url: Column) -> Column:
    """PRJ-04: custom attributes by code, the last of a code counts (T9). GTINs are not checked here (T5)."""
    attributes = raw.items("custom_attributes")

    def value(*codes: str) -> Column:
        return first_truthy(item(F.try_element_at(F.filter(attributes, lambda a: item(a, "attribute_code").isin(*codes)), F.lit(-1)), "value"))

    base = F.regexp_replace(shop_url, "/+$", "")
    media = lambda file: F.concat(base, F.lit("/media/catalog/product"), file)
    image = value("image")
    gallery = F.filter(raw.items("media_gallery_entries"), lambda g: truthy(item(g, "file")) & ~F.coalesce(item(g, "disabled", "boolean"), F.lit(False)) & ~item(g, "file").eqNullSafe(image))
    return product(
        external_id=F.coalesce(raw.at("sku"), raw.at("id"), F.lit("")), title=strip(raw.at("name")), description=text.sanitized(F.coalesce(value("description"), F.lit(""))), price=raw.number("price"),
        currency=F.coalesce(raw.at("currency"), F.lit("USD")), image_url=F.coalesce(media(image), F.lit("")), product_url=F.coalesce(F.concat(base, F.lit("/"), value("url_key"), F.lit(".html")), shop_url), sku=raw.at("sku"),
        gtin=value("ean", "gtin", "barcode"), mpn=value("mpn"), vendor=value("manufacturer"), additional_images=F.transform(gallery, lambda g: media(item(g, "file"))),
    )


def shopware(raw: Raw, shop_url: Column) -> Column:
    """PRJ-05: tags are the category path too, and a condition keeps its spelling (T6)."""
    price = raw.number("price")
    tags = texts(raw.items("tags"))
    return product(
        external_id=F.coalesce(first_truthy(raw.at("id"), raw.at("sku")), F.lit("")), title=strip(first_truthy(raw.at("title"), raw.at("name"))), description=text.sanitized(F.coalesce(raw.at("description"), F.lit(""))),
        price=price, compare_at_price=differs(price, raw.at("compare_at_price").try_cast("decimal(38,6)")), currency=F.coalesce(first_truthy(raw.at("currency")), F.lit("EUR")), image_url=F.coalesce(raw.at("image_url"), F.lit("")),
        product_url=F.coalesce(first_truthy(raw.at("product_url")), shop_url), sku=raw.at("sku"), gtin=text.valid_gtin(first_truthy(raw.at("gtin"), raw.at("barcode"), raw.at("ean"))), vendor=first_truthy(raw.at("vendor")),
        in_stock=F.coalesce(raw.at("in_stock", "boolean"), F.lit(True)), condition=first_truthy(raw.at("condition")), variants=variant_rows(raw.items("variants"), "variant_id"), tags=tags,
        additional_images=texts(raw.items("additional_images")), category_path=tags,
    )


def feed(raw: Raw, shop_url: Column) -> Column:
    """PRJ-06: a sale price under the price becomes the price."""
    full, sale = raw.number("price"), raw.number("sale_price")
    on_sale = (sale > 0) & (sale < full)
    there = F.lower(F.replace(F.coalesce(raw.at("availability"), F.lit("")), F.lit(" "), F.lit("_")))
    state = F.lower(F.coalesce(raw.at("condition"), F.lit("")))
    path = F.filter(F.transform(F.split(F.coalesce(raw.at("product_type"), F.lit("")), ">"), lambda x: strip(x)), lambda x: x != "")
    return product(
        external_id=F.coalesce(raw.at("id"), F.lit("")), title=strip(raw.at("title")), description=text.sanitized(F.coalesce(raw.at("description"), F.lit(""))), price=F.when(on_sale, sale).otherwise(full), compare_at_price=F.when(on_sale, full),
        currency=F.coalesce(first_truthy(raw.at("currency")), F.lit("EUR")), image_url=F.coalesce(raw.at("image_link"), F.lit("")), product_url=F.coalesce(first_truthy(raw.at("link")), shop_url), sku=F.coalesce(raw.at("id"), F.lit("")),
        gtin=text.valid_gtin(raw.at("gtin")), mpn=first_truthy(raw.at("mpn")), vendor=first_truthy(raw.at("brand")), product_type=F.get(path, F.lit(0)), in_stock=(there == "") | F.contains(there, F.lit("in_stock")),
        condition=F.when(F.contains(state, F.lit("new")), "NEW").when(F.contains(state, F.lit("refurbished")), "REFURBISHED").when(F.contains(state, F.lit("used")), "USED"), additional_images=texts(raw.items("additional_image_link")), category_path=path,
    )


def schema_org(raw: Raw, shop_url: Column) -> Column:
    """PRJ-08: the first offer; images as text, list or object; GTINs from the product, its offer or its properties."""
    offer = F.coalesce(raw.at("offers/[0]", "variant"), raw.at("offers", "variant"))
    own = Raw(offer)
    one = lambda v: first_truthy(item(v, "url"), item(v, "contentUrl"), F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), v.try_cast("string")))
    images = F.coalesce(raw.at("image", "array<variant>"), F.when(raw.at("image", "variant").isNotNull(), F.array(raw.at("image", "variant"))), F.array().cast("array<variant>"))
    pictures = F.transform(images, one)
    properties = raw.items("additionalProperty")

    def extra(name: str) -> Column:
        same = lambda p: F.lower(first_truthy(item(p, "propertyID"), item(p, "name"))) == name
        return item(F.try_element_at(F.filter(properties, same), F.lit(-1)), "value")

    ids = ("gtin13", "gtin", "gtin14", "gtin12", "gtin8")
    gtin = text.valid_gtin(first_truthy(*(raw.at(i) for i in (*ids, "isbn")), *(own.at(i) for i in ids), *(extra(i) for i in ("gtin13", "gtin12", "gtin14", "gtin8", "gtin", "ean", "isbn"))))
    category = raw.at("category", "array<variant>")
    path = F.when(category.isNotNull(), texts(category)).otherwise(F.filter(F.transform(F.split(F.coalesce(raw.at("category"), F.lit("")), "[>/]"), lambda x: strip(x)), lambda x: x != ""))
    available = F.coalesce(own.at("availability"), F.lit(""))
    return product(
        external_id=F.coalesce(first_truthy(raw.at("sku"), raw.at("productID"), gtin), F.lit("")), title=strip(raw.at("name")), description=text.sanitized(F.coalesce(raw.at("description"), F.lit(""))), price=own.number("price"),
        currency=F.coalesce(own.at("priceCurrency"), F.lit("USD")), image_url=F.coalesce(first_truthy(F.get(pictures, F.lit(0)), raw.at("thumbnailUrl"), raw.at("og:image")), F.lit("")), product_url=F.coalesce(raw.at("url"), shop_url),
        sku=first_truthy(raw.at("sku"), extra("mpn")), gtin=gtin, mpn=first_truthy(raw.at("mpn"), own.at("mpn")), vendor=F.coalesce(raw.at("brand/name"), F.when(~F.coalesce(F.schema_of_variant(raw.at("brand", "variant")).startswith("OBJECT"), F.lit(False)), raw.at("brand"))),
        in_stock=(available == "") | F.contains(available, F.lit("InStock")), condition=text.schema_condition(own.at("itemCondition")), additional_images=F.filter(behind_first(pictures), lambda x: truthy(x)), category_path=path,
    )


def opengraph(raw: Raw, shop_url: Column) -> Column:
    """PRJ-09."""
    category = raw.at("product:category")
    return product(
        external_id=F.coalesce(raw.at("og:product_id"), raw.at("product:retailer_item_id"), F.lit("")), title=strip(raw.at("og:title")), description=text.sanitized(F.coalesce(raw.at("og:description"), F.lit(""))),
        price=F.coalesce(first_truthy(raw.at("og:price:amount"), raw.at("product:price:amount")).try_cast("decimal(38,6)"), F.lit(0)), currency=F.coalesce(first_truthy(raw.at("og:price:currency")), raw.at("product:price:currency"), F.lit("USD")),
        image_url=F.coalesce(raw.at("og:image"), F.lit("")), product_url=F.coalesce(raw.at("og:url"), shop_url), condition=first_truthy(raw.at("product:condition")), category_path=F.when(truthy(category), F.array(category)).otherwise(F.array().cast("array<string>")),
    )


def by_selectors(raw: Raw, shop_url: Column) -> Column:
    """PRJ-10: vendor null, in stock, no variants."""
    any_of = lambda *names: first_truthy(*map(raw.at, names))
    return product(
        external_id=F.coalesce(raw.at("sku"), raw.at("id"), F.lit("")), title=strip(any_of("title", "name", "product_name", "heading")), description=text.sanitized(F.coalesce(raw.at("description"), F.lit(""))), price=money.loose_price(raw.at("price")),
        currency=F.coalesce(any_of("currency", "price_currency"), F.lit("USD")), image_url=F.coalesce(any_of("image", "image_url", "src"), F.lit("")), product_url=F.coalesce(any_of("product_url", "url", "canonical"), shop_url), sku=raw.at("sku"),
        gtin=text.valid_gtin(any_of("gtin", "ean", "barcode")), mpn=any_of("mpn"),
    )


def shape(raw: Raw) -> Column:
    """PRJ-07: what a record of no known platform looks like."""
    kind = F.coalesce(raw.at("@type"), F.lit(""))
    has = lambda key: raw.at(key, "variant").isNotNull()
    return F.when(raw.at("_source") == "google_feed", "feed").when(has("name") & (has("offers") | F.contains(kind, F.lit("Product"))), "schema_org").when(has("og:title") | has("product:price:amount"), "opengraph").otherwise("selectors")


def normalize(records: DataFrame, *carry: str) -> DataFrame:
    """PRJ-01, FLT-05: columns raw (VARIANT), shop_id, platform, shop_url to products with is_valid and reject_reason. carry: further columns that stay.

    A platform's own mapping goes first and the generic ones follow where it finds no title. Prices of more than two places and
    currencies of more than three letters reject the row (T3, T4); so does having no price, image and identifier.
    """
    raw, url = Raw(F.col("raw")), F.col("shop_url")
    own = {"shopify": shopify, "woocommerce": woocommerce, "magento": magento, "shopware": shopware}
    generic = {"feed": feed, "schema_org": schema_org, "opengraph": opengraph, "selectors": by_selectors}
    titled = lambda p: once(p, lambda x: F.when(truthy(x["title"]), x))
    special, fallback = None, None
    for name, make in own.items():
        special = F.when(F.col("platform") == name, titled(make(raw, url))) if special is None else special.when(F.col("platform") == name, titled(make(raw, url)))
    for name, make in generic.items():
        fallback = F.when(F.col("_shape") == name, titled(make(raw, url))) if fallback is None else fallback.when(F.col("_shape") == name, titled(make(raw, url)))
    # A generated row is a barrier: what follows reads columns, so the optimizer can't repeat the mapping for each of them.
    out = records.withColumn("_shape", shape(raw)).select("shop_id", "platform", "raw", *carry, F.inline(F.array(F.coalesce(special, fallback, product()))))
    has_id = truthy("sku") | truthy(strip("external_id"))
    reason = (
        F.when(F.col("title").isNull(), "no_title")
        .when(~money.two_places("price") | ~F.coalesce(money.two_places("compare_at_price"), F.lit(True)), "price_places")
        .when(F.length("currency") > 3, "currency")
        .when(~(F.col("price") > 0) & ~truthy(strip("image_url")) & ~has_id, "nothing_to_identify")
    )
    cast = {"price": "decimal(12,2)", "compare_at_price": "decimal(12,2)"}
    special_columns = {"currency": F.upper("currency"), "condition": F.coalesce("condition", F.lit("NEW"))}
    columns = [special_columns.get(c, F.col(c).try_cast(cast[c]) if c in cast else F.col(c)).alias(c) for c in FIELDS]
    done = out.withColumn("reject_reason", reason).select("shop_id", "platform", "raw", *carry, *columns, "reject_reason", F.col("reject_reason").isNull().alias("is_valid"))
    return done.withColumn("idempotency_key", text.idempotency_key(F.col("external_id"), F.col("platform"), F.col("shop_id"), F.col("sku"), F.col("title")))
