"""Sources and normalizing: bodies shaped from the driver's tables are read back to records and products, each with SQL that reads the same columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import presence, text, urls
from millrace.operators import access, catalog, export, extract, normalize, substrings
from millrace.plans import ingestion
from millrace.session import fresh_dir, table
from millrace.sinks.buckets import BucketTable
from millrace.sources import feeds, payloads


def text_of(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def part(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"))


def joined(df, pieces: Column, between: str, size: int = 5):
    """Bodies of `size` pieces each, in the order of k: no body grows with the table."""
    body = F.array_sort(F.collect_list(F.struct("k", pieces.alias("piece"))))
    return df.groupBy(F.floor(F.col("k") / size).alias("body_no")).agg(F.array_join(F.transform(body, lambda x: x["piece"]), between).alias("body"))


def feed_xml(s, d):
    """SRC-01, SRC-03, SRC-04: items with CDATA, entities and character references; an empty title drops the item."""
    k = F.col("k")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    title = F.when(k % 7 == 0, "").otherwise(F.concat("name", F.lit(" &amp; &#233;&#x20AC; "), text_of(k)))
    item = tag("item", F.concat(tag("g:id", text_of(k)), tag("title", title), tag("g:price", F.format_string("%.2f EUR", "price")), F.when(k % 3 == 0, tag("g:sale_price", F.lit("1.50 EUR"))).otherwise(""), tag("g:ean", F.lpad(text_of(k + 1), 13, "4")), tag("g:brand", F.concat(F.lit("<![CDATA["), "brand", F.lit("]]>"))), tag("link", F.concat(F.lit("https://x.test/p/"), text_of(k)))))
    bodies = joined(part(s, d), item, "\n").withColumn("body", F.concat(F.lit('<?xml version="1.0"?><rss xmlns:g="x"><channel>'), "body", F.lit("</channel></rss>")))
    bodies = bodies.withColumn("type", F.when(F.col("body_no") % 2 == 0, "application/xml"))
    rows = feeds.xml_feed(bodies.where(feeds.is_xml("body", "type")), "body", "body_no")
    return rows.select("body_no", "id", "title", "price", "currency", "sale_price", "gtin", "brand", "link")


def feed_delimited(s, d):
    """SRC-02, SRC-03: commas or tabs; cells in quotes hold separators, doubled quotes and line ends; short records end in nulls."""
    k = F.col("k")
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    whole = lambda sep: F.concat_ws(sep, text_of(k), quoted("name", F.lit(f'{sep} ""big""')), quoted(F.lit("line one\nline two "), text_of(k)), F.format_string("%.2f USD", "price"), "brand", quoted(F.lit("a.jpg,b.jpg")))
    row = lambda sep: F.when(k % 5 == 0, F.concat_ws(sep, text_of(k), "name")).otherwise(whole(sep))
    names = ("id", "title", "description", "price", "brand", "additional_image_link")
    tabs, commas = ((joined(part(s, d).where(F.floor(k / 5) % 2 == n), row(sep), end).withColumn("body", F.concat(F.lit(sep.join(names) + end), "body", F.lit(end)))) for n, sep, end in ((0, "\t", "\n"), (1, ",", "\r\n")))
    rows = feeds.delimited_feed(tabs.union(commas).where(~feeds.is_xml("body", F.lit(None).cast("string"))), "body", "body_no")
    return rows.select("body_no", "id", "title", "description", "price", "currency", "brand", F.size("additional_image_link").alias("n_images"))


def feed_products(s, d):
    """SRC-01, SRC-02, SET-01, PRJ-06, SNK-01, AGG-14: XML feeds ingested into an empty table, the batch twice. Every fourth item comes twice in its feed, every fifth again in a later body; the last counts. Some have nothing to be told by and are refused."""
    k = F.col("k")
    item = lambda name, price: F.concat(F.lit("<item><g:id>"), text_of(k), F.lit("</g:id><title>"), name, F.lit("</title>"), price, F.lit("<g:availability>"), F.when(k % 4 == 0, "out of stock").otherwise("in stock"), F.lit("</g:availability></item>"))
    priced = lambda times: F.concat(F.lit("<g:price>"), F.format_string("%.2f EUR", F.col("price") * times), F.lit("</g:price>"))
    nameless = F.replace(item("name", F.lit("")), F.concat(F.lit("<g:id>"), text_of(k), F.lit("</g:id>")), F.lit(""))
    first = F.concat(item(F.concat(F.lit("old "), "name"), F.concat(F.lit("<g:description>long</g:description>"), priced(F.lit(3)))), item("name", priced(F.lit(1))))
    once = F.when(k % 9 == 0, nameless).when(k % 4 == 0, first).otherwise(item("name", priced(F.lit(1))))
    shape = lambda df, seq: df.select(F.lit("shop").alias("shop_id"), F.lit("generic").alias("platform"), F.lit("https://x.test").alias("shop_url"), F.concat(F.lit("<rss>"), "body", F.lit("</rss>")).alias("body"), F.lit("text/xml").alias("content_type"), seq.alias("seq"))
    p = part(s, d)
    bodies = shape(joined(p, once, ""), F.col("body_no")).union(shape(joined(p.where(k % 5 == 0), item("name", priced(F.lit(2))), ""), F.col("body_no") + F.lit(1 << 40)))
    as_of = F.expr("timestamp_ntz'2024-01-10 12:00:00'")
    batch = ingestion.accepted(ingestion.raw_records(bodies), as_of)
    made = BucketTable(s, fresh_dir(s, "catalog"), ["idempotency_key"], batch.schema, buckets=16)
    for _ in range(2):
        ingestion.into(made, batch, "feeds", 0)
    return made.rows().select("external_id", "title", "description", F.col("price").cast("double").alias("price"), "currency", "in_stock", "condition", "product_url")


def sitemap_urls(s, d):
    """SRC-13: addresses of sitemaps with escaped signs; an index of sitemaps gives none."""
    p = table(s, d, "pages").select(F.col("page_id").alias("k"), "url")
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = joined(p, loc, "", 10).withColumn("root", F.when(F.col("body_no") % 5 == 4, "sitemapindex").otherwise("urlset"))
    maps = maps.select("body_no", F.concat(F.lit("<"), "root", F.lit(">"), "body", F.lit("</"), "root", F.lit(">")).alias("body"))
    return feeds.sitemap(maps, "body", "body_no").select("body_no", F.col("pos").cast("int").alias("pos"), "url")


def one(**fields: Column) -> Column:
    return F.struct(*(v.alias(n) for n, v in fields.items()))


def raw_shapes() -> dict[str, dict]:
    """What the shops of each kind tell of a part."""
    k, name, brand = F.col("k"), F.col("name"), F.col("brand")
    price, code = F.format_string("%.2f", "price"), F.lpad(text_of(k + 1), 13, "4")
    pictures = F.array(one(src=F.lit("i1")), one(src=F.lit("i2")))
    return {
        "shopify": {"id": k, "title": F.concat(F.lit(" "), name, F.lit(" ")), "handle": F.concat(F.lit("h-"), text_of(k)), "body_html": F.lit("<p onclick='x'>d</p>"), "vendor": brand, "product_type": F.col("kind"), "tags": F.lit("a, b"), "images": pictures, "variants": F.array(one(id=k, price=price, sku=F.concat(F.lit("S-"), text_of(k)), barcode=code, inventory_quantity=k % 3))},
        "woocommerce": {"id": k, "name": name, "permalink": F.concat(F.lit("https://w.test/"), text_of(k)), "sku": text_of(k), "ean": code, "prices": one(price=F.round(F.col("price") * 100).cast("bigint").cast("string"), regular_price=F.lit("99999999"), currency_code=F.lit("GBP"), currency_minor_unit=F.lit(2)), "images": pictures, "tags": F.array(one(name=F.lit("t")))},
        "magento": {"id": k, "sku": F.concat(F.lit("m"), text_of(k)), "name": name, "price": price.cast("double"), "custom_attributes": F.array(one(attribute_code=F.lit("ean"), value=F.lit("first")), one(attribute_code=F.lit("url_key"), value=F.concat(F.lit("u"), text_of(k))), one(attribute_code=F.lit("ean"), value=code), one(attribute_code=F.lit("manufacturer"), value=brand))},
        "shopware": {"id": text_of(k), "name": name, "price": price, "compare_at_price": price, "ean": code, "vendor": brand, "in_stock": k % 2 == 0, "condition": F.lit("New"), "tags": F.array(F.lit("x"), F.lit("")), "image_url": F.lit("i.jpg")},
        "feed": {"_source": F.lit("google_feed"), "id": text_of(k), "title": name, "price": price, "sale_price": F.when(k % 2 == 0, "1.25"), "gtin": code, "brand": brand, "availability": F.lit("out of stock"), "condition": F.lit("Refurbished item")},
        "schema_org": {"@type": F.array(F.lit("Product")), "name": name, "sku": text_of(k), "gtin13": code, "brand": one(name=brand), "image": F.array(F.lit("p1"), F.lit("p2")), "url": F.lit("https://s.test/p"), "offers": F.array(one(price=price, priceCurrency=F.lit("usd"), availability=F.lit("https://schema.org/InStock"), itemCondition=F.lit("https://schema.org/UsedCondition")))},
        "opengraph": {"og:title": name, "og:image": F.lit("o.jpg"), "product:price:amount": price, "product:price:currency": F.lit("CHF"), "og:product_id": text_of(k)},
        "selectors": {"product_name": name, "price": F.concat(F.lit("$"), F.format_number("price", 2)), "sku": F.when(k % 2 == 0, text_of(k)), "barcode": code},
    }


#: Kinds that a platform names; the others are told from their shape.
PLATFORMS = ("shopify", "woocommerce", "magento", "shopware")


def normalized_products(s, d):
    """PRJ-01 to PRJ-10, FLT-05, FN-06, FN-10, FN-13: parts as raw records of eight kinds, by turns."""
    shapes = raw_shapes()
    raw = F.coalesce(*(F.when(F.col("k") % len(shapes) == i, F.to_json(one(**fields))) for i, fields in enumerate(shapes.values())))
    platform = F.coalesce(*(F.when(F.col("k") % len(shapes) == i, name) for i, name in enumerate(shapes) if name in PLATFORMS), F.lit("generic"))
    records = part(s, d).select(F.lit("s").alias("shop_id"), platform.alias("platform"), F.lit("https://shop.test/").alias("shop_url"), F.parse_json(raw).alias("raw"))
    n = lambda c: F.size(c).alias(f"n_{c}")
    amount = lambda c: F.col(c).cast("double").alias(c)
    return normalize.normalize(records).select("platform", "external_id", "title", "description", amount("price"), amount("compare_at_price"), "currency", "image_url", "product_url", "sku", "gtin", "vendor", "in_stock", "condition", n("tags"), n("additional_images"), n("variants"), "is_valid")


def admin_payloads(s, d):
    """SRC-05 to SRC-12, PRJ-11 to PRJ-14, JOIN-07, FN-07, FN-08, DQ-06: pages of administration APIs to raw records; every ninth page is broken."""
    k, name, brand = F.col("k"), F.col("name"), F.col("brand")
    price, code = F.format_string("%.2f", "price"), F.lpad(text_of(k + 1), 13, "4")
    shapes = {
        "$.data": one(id=k, name=name, price=price, sku=text_of(k), upc=code, brand_id=k % 5, availability=F.lit("available"), inventory_level=k % 2, images=F.array(one(url_standard=F.lit("b"), sort_order=F.lit(2)), one(url_standard=F.lit("a"), sort_order=F.lit(1)))),
        "$": one(id=k, name=name, price=F.lit(""), regular_price=price, sku=text_of(k), stock_status=F.when(k % 2 == 1, "instock").otherwise("outofstock"), meta_data=F.when(F.col("k") % 8 == 5, F.array(one(key=F.lit("_global_unique_id"), value=code))).otherwise(F.array(one(key=F.lit("my_ean"), value=F.lit("11111111")), one(key=F.lit("_ts_gtin"), value=code))), images=F.array(one(src=F.lit("a")))),
        "$.items": one(id=k, name=name, price=price, sku=text_of(k), visibility=F.when(k % 3 == 0, 1).otherwise(4), custom_attributes=F.array(one(attribute_code=F.lit("barcode"), value=F.lit("x")), one(attribute_code=F.lit("gtin"), value=code)), extension_attributes=one(stock_item=one(is_in_stock=k % 2 == 1))),
        "$.products": one(id=text_of(k), name=name, price=F.array(one(gross=price)), productNumber=text_of(k), ean=code, stock=k % 2, active=F.lit(True), media=F.array(one(media=one(url=F.lit("a"))), one(media=one(url=F.lit("b"))))),
    }
    brands = part(s, d).where("k between 0 and 3").select(F.col("k").alias("id"), F.concat(F.lit("B"), text_of(k)).alias("name"))
    maps = (lambda r: payloads.bigcommerce(r, brands), payloads.woocommerce_admin, payloads.magento_admin, lambda r: payloads.shopware_admin(r, "https://s.test/"))
    out = None
    for i, ((path, shape), mapped) in enumerate(zip(shapes.items(), maps, strict=True)):
        bodies = joined(part(s, d).where(k % 4 == i), F.to_json(shape), ",", 20)
        list_ = F.concat(F.lit("["), "body", F.lit("]"))
        whole = list_ if path == "$" else F.concat(F.lit('{"' + path[2:] + '":'), list_, F.lit("}"))
        bodies = bodies.withColumn("body", F.when(F.col("body_no") % 9 == 8, F.concat(whole, F.lit("]broken"))).otherwise(whole))
        rows = mapped(payloads.records(bodies, "body", path))
        get = lambda p: F.try_variant_get("raw", f"$.{p}", "string")
        picked = rows.select(F.lit(path).alias("api"), get("id").alias("id"), get("title").alias("title"), get("price").try_cast("double").alias("price"), get("sku").alias("sku"), F.coalesce(get("gtin"), get("ean")).alias("gtin"), get("in_stock").alias("in_stock"), get("vendor").alias("vendor"), F.coalesce(get("image"), get("image_url")).alias("image"))
        out = picked if out is None else out.unionByName(picked)
    return out


def public_payloads(s, d):
    """SRC-05, SRC-06, SRC-08: jobs that read a shop's public API in pages of four products: whole ones, refused, broken and missing pages, a limit that passes and one that stays, a short page; records with the shop's currency."""
    k = F.col("k")
    item = one(id=k, title=F.col("name"), variants=F.array(one(price=F.format_string("%.2f", "price"))))
    p = part(s, d).select(F.floor(k / 12).alias("job"), (F.floor(k / 4) % 3 + 1).alias("page"), k, F.to_json(item).alias("item")).where(~((k % 12 == 11) & (F.floor(k / 12) % 3 == 0)))
    bodies = p.groupBy("job", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), ",").alias("items"))
    kind, second = F.col("job") % 6, F.col("page") == 2
    status = F.when(second & (kind == 1), 503).when(second & (kind == 3), 429).when((F.col("page") == 3) & (kind == 4), 404).when((F.col("page") == 1) & (F.col("job") % 35 == 20), 404).when(second & (kind == 5) & (F.col("job") % 2 == 1), 403).otherwise(200)
    body = F.when(second & (kind == 2), '{"products":[').otherwise(F.concat(F.lit('{"products":['), "items", F.lit("]}")))
    rows = bodies.select("job", "page", F.lit(1).alias("attempt"), status.alias("status"), body.alias("body"), F.when((F.col("page") == 1) & (F.col("job") % 2 == 0), "EUR").alias("currency"))
    again = rows.where(second & (kind == 3) & (F.col("job") % 2 == 1)).select("job", "page", F.lit(2).alias("attempt"), F.when(F.col("job") % 4 == 1, 200).otherwise(429).alias("status"), "body", "currency")
    found, jobs = payloads.fetched(rows.union(again), "job", "$.products", 4)
    told = found.groupBy("job").agg(F.sum(F.try_variant_get("raw", "$.id", "bigint")).alias("id_sum"), F.count_if(F.try_variant_get("raw", "$._shop_currency", "string") == "EUR").alias("in_eur"))
    return jobs.join(told, "job", "left").select("job", "products", "pages_completed", "complete", "error", F.coalesce("id_sum", F.lit(0)).alias("id_sum"), F.coalesce("in_eur", F.lit(0)).alias("in_eur"))


def link_cursors(s, d):
    """SRC-08: the next page's address of Link headers with one, without one, with another order of parts."""
    n = F.col("page_id")
    to = lambda rel, c: F.concat(F.lit("<"), c, F.lit(f'>; rel="{rel}"'))
    link = F.when(n % 4 == 0, to("previous", F.lit("https://x/p"))).when(n % 4 == 1, F.concat(to("previous", F.lit("https://x/p")), F.lit(", "), to("next", F.concat("url", F.lit("?page_info=n&limit=250"))))).when(n % 4 == 2, F.concat(to("next", F.col("url")), F.lit(","), to("last", F.lit("https://x/z"))))
    return table(s, d, "pages").select("page_id", urls.next_page(link).alias("next"))


def rejected_products(s, d):
    """PRJ-01, FLT-05, DQ-06: records that normalizing must refuse, and why; identifiers that aren't any become null, and a record may do without price or without identifier."""
    k = F.col("k")
    at = lambda *cases: F.element_at(F.array(*cases), (k % 8 + 1).cast("int"))
    none = F.lit(None).cast("string")
    price = F.format_string("%.2f", "price")
    record = one(_source=F.lit("google_feed"), id=at(text_of(k), text_of(k), text_of(k), text_of(k), none, text_of(k), none, text_of(k)), title=at(F.col("name"), F.lit("  "), F.col("name"), F.col("name"), F.col("name"), F.col("name"), F.col("name"), none), price=at(price, price, F.concat(price, F.lit("7")), price, none, none, price, price), currency=at(F.lit("usd"), F.lit("USD"), F.lit("USD"), F.lit("EURO"), F.lit("USD"), none, none, F.lit("USD")), gtin=F.when(k % 3 == 0, F.lpad(text_of(k), 13, "4")).otherwise("12"))
    rows = part(s, d).select(F.lit("s").alias("shop_id"), F.lit("generic").alias("platform"), F.lit("https://x.test").alias("shop_url"), F.parse_json(F.to_json(one(**{"_source": F.lit("google_feed"), "k": k, "r": record}))).alias("raw"))
    rows = rows.select("shop_id", "platform", "shop_url", F.try_variant_get("raw", "$.k", "bigint").alias("k"), F.try_variant_get("raw", "$.r", "variant").alias("raw"))
    return normalize.normalize(rows, "k").select("k", "is_valid", "reject_reason", "title", F.when(F.col("is_valid"), F.col("currency")).alias("currency"), "gtin")


def product_variations(s, d):
    """SRC-10, FN-07: orders as products, their lines as variations; only variable products get them, in order, with options, stock and identifiers."""
    o, n = F.col("o_orderkey"), F.col("l_linenumber")
    products = table(s, d, "orders").select(F.parse_json(F.to_json(one(id=o, name=F.col("o_orderpriority"), type=F.when(o % 2 == 0, "variable").otherwise("simple")))).alias("raw"))
    options = F.array(F.struct(F.col("l_returnflag").alias("option")), F.struct(F.when(n % 2 == 0, F.col("l_linestatus")).alias("option")))
    meta = F.when(n % 3 == 0, F.array(F.struct(F.lit("_ean").alias("key"), F.lit("123").alias("value")), F.struct(F.lit("my_upc").alias("key"), F.lpad(text_of("l_partkey"), 12, "4").alias("value"))))
    line = one(id=F.col("l_partkey"), price=F.format_string("%.2f", "l_extendedprice"), sku=F.when(n > 1, F.concat(F.lit("s"), text_of("l_partkey"))), stock_quantity=F.when(n % 4 > 0, F.col("l_quantity").cast("int")), attributes=options, meta_data=meta)
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("product_id"), F.struct(n, "l_partkey", "l_extendedprice", "l_tax").alias("seq"), F.parse_json(F.to_json(line)).alias("raw"))
    made = payloads.woocommerce_admin(products, lines)
    get = lambda p, kind="string": F.try_variant_get("raw", p, kind)
    joined = lambda c: F.array_join(F.transform(get("$.variants", f"array<struct<{c}: string>>"), lambda v: v[c]), ",")
    return made.select(get("$.id", "bigint").alias("id"), *(joined(c).alias(c + "s") for c in ("title", "sku", "barcode")), F.aggregate(get("$.variants", "array<struct<inventory_quantity: bigint>>"), F.lit(0).cast("bigint"), lambda a, v: a + v["inventory_quantity"]).alias("stock"))


def api_paging(s, d):
    """SRC-05 to SRC-07, WIN-05: orders as pages of jobs, the customers; how many pages were read and whether the job is complete."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("job")).agg(F.count("*").alias("total"))
    pages = o.select("job", "total", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / 4).cast("int"))).alias("page")).where("page <= 3")
    sized = pages.withColumn("n", F.least(F.lit(4), F.col("total") - (F.col("page") - 1) * 4).cast("bigint"))
    return payloads.paging(sized, "job", "page", "n", "total", 4, 10)


def benchmark_products(s, d):
    """PRJ-17, SRC-16, SRC-17: records with attributes that win over columns, the last of a key."""
    k = F.col("k")
    body = F.to_json(one(title=F.when(k % 6 != 0, F.col("name")), price=text_of("price"), currency=F.lit("EUR"), category=F.col("kind"), brand=F.lit("plain"), attributes=F.array(one(key=F.lit("Brand"), value=F.lit("early")), one(key=F.lit("brand"), value=F.when(k % 2 == 0, F.col("brand"))))))
    rows = part(s, d).select("k", F.parse_json(body).alias("raw"))
    return payloads.benchmark_records(rows).select("title", "vendor", "price", "currency", "product_type")


def merchant_profiles(s, d):
    """PRJ-20, FN-16, T4: customers as shops; names by fallback, lengths cut."""
    c = F.col("c_custkey")
    raw = one(jsonld_company_name=F.when(c % 3 == 0, F.col("c_name")), og_site_name=F.when(c % 3 == 1, F.concat(F.lit(" og "), text_of(c))), meta_description=F.repeat(F.lit("x"), 2500), currency=F.lit("EURO"), language=F.lit("german-austria"), address_country=one(name=F.lit("AT")), founding_date=F.concat(F.lit("in "), text_of(1950 + c % 60)), favicon_url=F.lit("f.ico"))
    rows = table(s, d, "customer").select(c.alias("shop_id"), F.parse_json(F.to_json(raw)).alias("raw"))
    return payloads.profile(rows).select("shop_id", "company_name", "logo_url", F.length("description").alias("n_description"), "country", "currency", "language", "founding_year")


def page_organizations(s, d):
    """EXT-07: of several organization nodes the last script's, within it one with a name."""
    n = text_of("page_id")
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    first = script(F.lit('{"@type":"Organization","name":"A'), n, F.lit('"}'))
    second = script(F.lit('[{"@type":"Store","description":"nameless"},{"@type":"LocalBusiness","name":"B'), n, F.lit('","logo":{"url":"l.png"},"address":{"addressCountry":"DE"}}]'))
    p = table(s, d, "pages").select("page_id", F.concat("html", first, F.when(F.col("page_id") % 2 == 0, second).otherwise("")).alias("html"))
    return extract.organizations(p, "html", "page_id")


def request_services(s, d):
    """JOIN-20: services behind the hosts that were requested; a host holds several patterns, one of which has two letters."""
    hosts = table(s, d, "supplier").select(F.when(F.col("s_suppkey") == 7, ".t").otherwise(F.concat(text_of("s_suppkey"), F.lit(".test"))).alias("pattern"), F.concat(F.lit("P"), text_of(F.col("s_suppkey") % 30)).alias("provider"), F.lit("cdn").alias("category"))
    requests = table(s, d, "events").select("user_id", F.concat(F.lit("https://A.m"), text_of(F.col("event_id") % 400), F.when(F.col("event_id") % 3 > 0, ".test").otherwise(".org"), F.lit("/x.js")).alias("url"))
    return substrings.services(requests, hosts, "user_id", "url")


def shop_patches(s, d):
    """JOIN-18, MUT-03: orders as products of shops; suppliers as rows of uploads: by shop and key, else by key and domain; some without a key or anything to change. The products that differ, with the counts."""
    k = F.col("o_orderkey")
    products = table(s, d, "orders").select(k.alias("id"), F.concat(F.when(F.col("o_custkey") % 3 == 0, "https://www.d").otherwise("https://d"), text_of(F.col("o_custkey") % 40), F.lit(".test")).alias("shop_id"), F.when(k % 11 > 0, F.concat(F.lit("s"), text_of(k % 50))).otherwise("").alias("match_key"), F.col("o_orderstatus").alias("vendor"), F.lit(None).cast("string").alias("mpn"))
    n = F.col("s_suppkey")
    changes = table(s, d, "supplier").select(n.alias("pos"), F.concat(F.lit("https://d"), text_of(n % 45), F.lit(".test")).alias("shop"), F.concat(F.lit("d"), text_of(n % 45), F.lit(".test")).alias("domain"), F.when(n % 9 > 0, F.concat(F.lit("s"), text_of(n * 7 % 60))).otherwise("").alias("match_key"), F.when(n % 2 == 0, F.concat(F.lit("V"), text_of(n))).alias("vendor"), F.when(n % 5 > 0, F.concat(F.lit("M"), text_of(n))).alias("mpn"))
    patched, counts = substrings.patch_shops(products, changes, "id", ["vendor", "mpn"])
    return patched.where("length(vendor) > 1 or mpn is not null").select("id", "vendor", "mpn").join(F.broadcast(counts))  # one row of counts


def url_scores(s, d):
    """EXT-18, URL-06, FN-25: share of shop words in a page's path, and domains that shops of two platforms may have."""
    p = table(s, d, "pages")
    shop = F.concat(F.lit("HTTPS://shop"), text_of("page_id"), F.when(F.col("page_id") % 3 == 0, ".myshopify.com/").when(F.col("page_id") % 3 == 1, ".example.com").otherwise("_x"))
    return p.select("page_id", extract.keyword_score("url").alias("score"), urls.handle(F.concat(F.lit("https://a.b/products/Item-"), text_of("page_id"), F.lit("?v=1"))).alias("handle"), urls.shop_domain(shop, "shopify").alias("shopify"), urls.shop_domain(shop, "magento").alias("magento"))


def text_rules(s, d):
    """FN-05, FN-10, FN-21: titles of Markdown, truth values and conditions of parts."""
    k = F.col("k")
    markdown = F.when(k % 3 == 0, F.concat(F.lit("intro\n# "), "name", F.lit("\nmore"))).when(k % 3 == 1, F.concat(F.lit("see **"), "name", F.lit("** now"))).otherwise("plain")
    word = F.element_at(F.array(*map(F.lit, (" TRUE ", "in stock", "no", "Available"))), (k % 4 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ("NewCondition", "DamagedCondition", "RefurbishedCondition", "other"))), (k % 4 + 1).cast("int"))
    return part(s, d).select("k", text.markdown_title(markdown).alias("title"), text.truth(word).alias("truth"), text.schema_condition(F.concat(F.lit("https://schema.org/"), state)).alias("condition"))


def presence_rules(s, d):
    """FN-22 to FN-24, T1: the notions of a value that is there, on values written in five ways."""
    v = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" \n"), F.lit("0"), F.lit("x")), (F.col("k") % 5 + 1).cast("int"))
    return part(s, d).select("k", v.alias("v")).select("k", presence.filled("v").alias("filled"), presence.scored("v").alias("scored"), presence.truthy("v").alias("truthy"))


def page_products(s, d):
    """FLT-15, FLT-16, EXT-04, SORT-09, FLT-22: orders as pages, their lines as products and images."""
    l = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 4 == 0, "0").otherwise(text_of("l_quantity")).alias("price"), F.when(F.col("l_tax") > 0, F.concat(F.lit("i"), text_of("l_linenumber"))).alias("src"), F.col("l_discount").alias("score"), "l_linenumber")  # noqa: E741
    images = l.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "src", "score"))).alias("images"))
    best = images.select("page", extract.best_image("images").alias("image"))
    tags = F.create_map(F.lit("og:type"), F.when(F.col("page") % 3 == 0, "product.item").otherwise("article"), F.lit("og:price:amount"), F.when(F.col("page") % 3 == 1, "0").otherwise(""), F.lit("author"), F.lit("x"))
    told = best.select("page", "image", extract.product_signal(tags, F.when(F.col("page") % 5 == 0, "9")).alias("is_product"), F.size(extract.open_graph_of(tags)).alias("n_tags"))
    node = F.parse_json(F.concat(F.lit('{"name":"n","author":{"name":"a"},"review":[1],"sku":"'), text_of("page"), F.lit('"}')))
    told = told.withColumn("kept", F.size(F.json_object_keys(F.to_json(extract.without_personal(node)))))
    return told.join(extract.all_priced_and_shown(l, "price", "src", "page"), "page")


def shop_connections(s, d):
    """JOIN-21, JOIN-04, PRJ-21: suppliers' shops with their connection and a role, listed without secrets."""
    shops = table(s, d, "supplier").select(F.col("s_suppkey").alias("shop"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("store-h"), text_of("s_suppkey"), F.lit(".mybigcommerce.com"))).otherwise(F.concat(F.lit("d"), text_of("s_suppkey"), F.lit(".test"))).alias("domain"))
    c, n = table(s, d, "customer"), text_of(F.col("c_custkey") % 60)
    domain = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h"), n)).otherwise(F.concat(F.lit("d"), n, F.lit(".test")))
    connections = c.select(F.when(F.col("c_custkey") % 3 == 0, "shopware").otherwise("bigcommerce").alias("platform"), domain.alias("domain"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("access_token"))
    roles = table(s, d, "region").select(F.col("r_regionkey").alias("role_id"), F.col("r_name").alias("name"))
    return access.with_role(access.connection_for(shops, access.listing(connections), "bigcommerce"), roles, "ASIA")


def catalog_gates(s, d):
    """AGG-15, AGG-23, MUT-08: which nations' customers lack identifiers, with the rows that an upsert of every third order affects."""
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("shop"), F.when(F.col("c_nationkey") % 5 == 0, "woocommerce").otherwise("magento").alias("platform"), F.when(F.col("c_acctbal") > 8500, "x").alias("gtin"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    rows = catalog.affected(o.where("o_custkey % 2 = 0"), o.where("key % 3 = 0").union(o.where("key % 9 = 0")), "key")
    gates = catalog.needs_gtins(c, "gtin", "platform", "shop").join(F.broadcast(rows))  # rows is one row
    return catalog.with_columns_added(gates, {"shop": "string", "retention": "string"})


def dead_letter_queue(s, d):
    """SNK-14, SRC-22, SNK-06: failed events join the queue, entries past 30 days leave it, tried ones too."""
    e = table(s, d, "events")
    old = e.where("event_type = 'click'").select(text_of("event_id").alias("entry"), text_of("user_id").alias("url"), F.lit("late").alias("error"), F.col("ts").alias("failed_at"))
    queue = export.dead_letters(old, e.where("event_type = 'error'").select("user_id", F.lit("bad").alias("why")), "user_id", "why", F.expr("timestamp_ntz'2024-02-05 00:00:00'"))
    left = export.retried(queue, e.where("event_id % 2 = 0").select(text_of("event_id").alias("entry")))
    return left.groupBy("error", text_of("url").alias("url")).agg(F.count("*").alias("n"))


def report_json(s, d):
    """SNK-09: reports as JSON documents, read back."""
    r = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("jobs"), F.max(F.when(F.col("o_orderkey") < 0, 1)).alias("none"))
    return export.as_json(r, "o_orderpriority").select("o_orderpriority", F.get_json_object("json", "$.jobs").cast("bigint").alias("jobs"), F.size(F.json_object_keys("json")).alias("keys"))


_P = "(select p_partkey as k, p_name as name, p_brand as brand, p_type as kind, p_retailprice as price, printf('%.2f', p_retailprice) as shown, lpad((p_partkey + 1)::varchar, 13, '4') as code from part)"
_PATH = r"lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''))"
QUERIES = {
    "feed_xml": (feed_xml, f"select k // 5 as body_no, k::varchar as id, name || ' & é€ ' || k as title, shown as price, 'EUR' as currency, case when k % 3 = 0 then '1.50' end as sale_price, code as gtin, brand, 'https://x.test/p/' || k as link from {_P} where k % 7 <> 0"),
    "feed_delimited": (feed_delimited, f"""select k // 5 as body_no, k::varchar as id, case when k % 5 = 0 then name else name || case when (k // 5) % 2 = 0 then chr(9) else ',' end || ' "big"' end as title, case when k % 5 <> 0 then 'line one' || chr(10) || 'line two ' || k end as description, case when k % 5 <> 0 then shown end as price, case when k % 5 <> 0 then 'USD' end as currency, case when k % 5 <> 0 then brand end as brand, case when k % 5 <> 0 then 2 else 0 end as n_images from {_P}"""),
    "feed_products": (feed_products, f"select k::varchar as external_id, name as title, '' as description, case when k % 5 = 0 then round(price * 2, 2) else price end as price, 'EUR' as currency, k % 4 <> 0 as in_stock, 'NEW' as condition, 'https://x.test' as product_url from {_P} where k % 5 = 0 or k % 9 <> 0"),
    "sitemap_urls": (sitemap_urls, "select page_id // 10 as body_no, (row_number() over (partition by page_id // 10 order by page_id) - 1)::int as pos, url from pages where (page_id // 10) % 5 <> 4"),
    "normalized_products": (normalized_products, f"""select case m when 0 then 'shopify' when 1 then 'woocommerce' when 2 then 'magento' when 3 then 'shopware' else 'generic' end as platform,
        case when m = 2 then 'm' || k when m = 7 and k % 2 = 1 then '' else k::varchar end as external_id, name as title, case m when 0 then '<p>d</p>' else '' end as description,
        case when m = 4 and k % 2 = 0 then 1.25 else shown::double end as price, case when m = 1 then 999999.99 when m = 4 and k % 2 = 0 then shown::double end as compare_at_price,
        case m when 1 then 'GBP' when 3 then 'EUR' when 4 then 'EUR' when 6 then 'CHF' else 'USD' end as currency, case m when 0 then 'i1' when 1 then 'i1' when 3 then 'i.jpg' when 5 then 'p1' when 6 then 'o.jpg' else '' end as image_url,
        case m when 0 then 'https://shop.test/products/h-' || k when 1 then 'https://w.test/' || k when 2 then 'https://shop.test/u' || k || '.html' when 5 then 'https://s.test/p' else 'https://shop.test/' end as product_url,
        case when m = 0 then 'S-' || k when m = 2 then 'm' || k when m in (3, 6) or m = 7 and k % 2 = 1 then null else k::varchar end as sku, case when m <> 6 then code end as gtin, case when m in (0, 2, 3, 4, 5) then brand end as vendor,
        case when m = 0 then k % 3 > 0 when m = 3 then k % 2 = 0 when m = 4 then false else true end as in_stock, case m when 3 then 'New' when 4 then 'REFURBISHED' when 5 then 'USED' else 'NEW' end as condition,
        case m when 0 then 2 when 1 then 1 when 3 then 1 else 0 end as n_tags, case when m in (0, 1, 5) then 1 else 0 end as n_additional_images, case when m = 0 then 1 else 0 end as n_variants, true as is_valid from (select *, k % 8 as m from {_P})"""),
    "admin_payloads": (admin_payloads, f"""select (['$.data', '$', '$.items', '$.products'])[k % 4 + 1] as api, k::varchar as id, name as title, shown::double as price, k::varchar as sku, case when k % 8 <> 5 then code end as gtin, case when k % 2 = 1 then 'true' else 'false' end as in_stock,
        case when k % 4 = 0 then case when k % 5 < 4 then 'B' || k % 5 else '' end end as vendor, case when k % 4 <> 2 then 'a' end as image from {_P} where (k // 20) % 9 <> 8 and not (k % 4 = 2 and k % 3 = 0)"""),
    "public_payloads": (public_payloads, f"""with p as (select k // 12 as job, (k // 4) % 3 + 1 as page, k from {_P} where not (k % 12 = 11 and (k // 12) % 3 = 0)),
        b as (select job, page, count(*) as n, sum(k) as ids from p group by all),
        r as (select *, case when page = 1 and job % 35 = 20 and not (page = 2) and not (page = 3 and job % 6 = 4) then 'not found' when page = 2 and job % 6 = 1 then 'server error' when page = 2 and job % 6 = 3 and (job % 2 = 0 or job % 4 <> 1) then 'rate limited'
            when page = 3 and job % 6 = 4 then 'not found' when page = 2 and job % 6 = 5 and job % 2 = 1 then 'refused' when page = 2 and job % 6 = 2 then 'invalid JSON' end as failed from b),
        g as (select *, row_number() over (partition by job order by page) <> page as gap from r),
        e as (select *, min(case when failed is not null or gap or n < 4 then page end) over (partition by job) as ended from g),
        j as (select job, coalesce(sum(n) filter (where failed is null and not gap and (ended is null or page <= ended)), 0)::bigint as products, coalesce(sum(ids) filter (where failed is null and not gap and (ended is null or page <= ended)), 0)::bigint as id_sum, max(ended) as ended, max(page) as last,
            max(failed) filter (where page = ended and not gap) as failed from e group by job)
        select job, products, (case when coalesce(ended, last + 1) > 1 then coalesce(ended, last + 1) - 1 when products > 0 then 1 else 0 end)::bigint as pages_completed, failed is null or failed = 'not found' and products > 0 as complete,
          case when failed = 'not found' and products > 0 then null else failed || ' on page ' || ended end as error, id_sum, case when job % 2 = 0 and exists (select 1 from b where b.job = j.job and page = 1) then products else 0 end as in_eur from j"""),
    "link_cursors": (link_cursors, "select page_id, case page_id % 4 when 1 then url || '?page_info=n&limit=250' when 2 then url end as next from pages"),
    "rejected_products": (rejected_products, f"""select k, k % 8 in (0, 5, 6) as is_valid, case k % 8 when 1 then 'no_title' when 7 then 'no_title' when 2 then 'price_places' when 3 then 'currency' when 4 then 'nothing_to_identify' end as reject_reason,
        case when k % 8 in (1, 7) then null else name end as title, case k % 8 when 0 then 'USD' when 5 then 'EUR' when 6 then 'EUR' end as currency, case when k % 8 not in (1, 7) and k % 3 = 0 then lpad(k::varchar, 13, '4') end as gtin from {_P}"""),
    "product_variations": (product_variations, """with v as (select l_orderkey as id, string_agg(l_returnflag || ' / ' || case when l_linenumber % 2 = 0 then l_linestatus else '' end, ',' order by l_linenumber, l_partkey, l_extendedprice, l_tax) as titles, string_agg(case when l_linenumber > 1 then 's' || l_partkey else '' end, ',' order by l_linenumber, l_partkey, l_extendedprice, l_tax) as skus,
          string_agg(case when l_linenumber % 3 = 0 then lpad(l_partkey::varchar, 12, '4') else '' end, ',' order by l_linenumber, l_partkey, l_extendedprice, l_tax) as barcodes, sum(case when l_linenumber % 4 > 0 then l_quantity::bigint else 0 end)::bigint as stock from lineitem group by 1)
        select o_orderkey as id, titles, skus, barcodes, stock from orders left join v on o_orderkey = id and o_orderkey % 2 = 0"""),
    "api_paging": (api_paging, "select job, least(3, ceil(total / 4.0))::bigint as pages_completed, ceil(total / 4.0)::bigint as pages_expected, least(12, total)::bigint as products, total <= 12 as complete from (select o_custkey as job, count(*) as total from orders group by 1)"),
    "benchmark_products": (benchmark_products, f"select name as title, case when k % 2 = 0 then brand else 'plain' end as vendor, price::varchar as price, 'EUR' as currency, kind as product_type from {_P} where k % 6 <> 0"),
    "merchant_profiles": (merchant_profiles, "select c_custkey as shop_id, case when c_custkey % 3 = 0 then c_name else 'og ' || c_custkey end as company_name, 'f.ico' as logo_url, 2000 as n_description, 'AT' as country, 'EUR' as currency, 'german-aus' as language, (1950 + c_custkey % 60)::int as founding_year from customer where c_custkey % 3 < 2"),
    "page_organizations": (page_organizations, "select page_id, case when page_id % 2 = 0 then 'B' else 'A' end || page_id as name, null as description, case when page_id % 2 = 0 then 'l.png' end as logo, case when page_id % 2 = 0 then 'DE' end as country from pages"),
    "request_services": (request_services, "select distinct user_id, 'P' || s_suppkey % 30 as provider, 'cdn' as category from (select distinct user_id, 'a.m' || event_id % 400 || case when event_id % 3 > 0 then '.test' else '.org' end as host from events) join supplier on contains(host, case when s_suppkey = 7 then '.t' else s_suppkey || '.test' end)"),
    "shop_patches": (shop_patches, """with p as (select o_orderkey as id, case when o_custkey % 3 = 0 then 'https://www.d' else 'https://d' end || o_custkey % 40 || '.test' as shop_id, case when o_orderkey % 11 > 0 then 's' || o_orderkey % 50 else '' end as match_key, o_orderstatus as vendor from orders),
        a as (select s_suppkey as pos, 'https://d' || s_suppkey % 45 || '.test' as shop, 'd' || s_suppkey % 45 || '.test' as domain, case when s_suppkey % 9 > 0 then 's' || s_suppkey * 7 % 60 else '' end as match_key, case when s_suppkey % 2 = 0 then 'V' || s_suppkey end as v, case when s_suppkey % 5 > 0 then 'M' || s_suppkey end as m from supplier),
        c as (select * from a where match_key <> '' and (v is not null or m is not null)),
        e as (select pos, id, v, m from c join p on shop = shop_id and c.match_key = p.match_key),
        h as (from e union all select pos, id, v, m from c join p on c.match_key = p.match_key and shop_id like '%' || domain || '%' where pos not in (select pos from e)),
        l as (select id, arg_max(v, pos) filter (where v is not null) as v, arg_max(m, pos) filter (where m is not null) as mpn from h group by id)
        select id, coalesce(v, vendor) as vendor, mpn, (select count(*) from h) as matched, (select count(*) from c) - (select count(distinct pos) from h) as not_found, (select count(*) from a) - (select count(*) from c) as invalid, (select count(*) from a) as total from l join p using (id)"""),
    "url_scores": (url_scores, f"select page_id, round(({' + '.join(f'contains({_PATH}, {chr(39)}{w}{chr(39)})::int' for w in ('product', 'shop', 'item', 'buy', 'store', 'p'))}) / 6, 4) as score, 'item-' || page_id as handle, case when page_id % 3 = 0 then 'shop' || page_id || '.myshopify.com' end as shopify, case page_id % 3 when 0 then 'shop' || page_id || '.myshopify.com' when 1 then 'shop' || page_id || '.example.com' end as magento from pages"),
    "text_rules": (text_rules, f"select k, case when k % 3 < 2 then name end as title, k % 4 <> 2 as truth, (['NEW', 'USED', 'REFURBISHED', null])[k % 4 + 1] as condition from {_P}"),
    "presence_rules": (presence_rules, f"select k, k % 5 > 2 as filled, k % 5 > 2 as scored, k % 5 > 1 as truthy from {_P}"),
    "page_products": (page_products, """select page, image, page % 3 = 0 or page % 5 = 0 as is_product, case page % 3 when 1 then 2 else 1 end as n_tags, 2 as kept, complete from (select l_orderkey as page, bool_and(l_linenumber % 4 <> 0 and l_tax > 0) as complete, arg_max('i' || l_linenumber, l_discount * 1000 - l_linenumber) filter (where l_tax > 0) as image from lineitem group by 1)"""),
    "shop_connections": (shop_connections, """with c as (select case when c_custkey % 3 = 0 then 'shopware' else 'bigcommerce' end as platform, case when c_custkey % 2 = 0 then 'h' || c_custkey % 60 else 'd' || c_custkey % 60 || '.test' end as domain, c_custkey as seq from customer),
        o as (select domain, max(seq) as seq from c where platform = 'bigcommerce' group by 1), a as (select domain, max(seq) as seq from c group by 1),
        s as (select s_suppkey as shop, case when s_suppkey % 4 = 0 then 'store-h' || s_suppkey || '.mybigcommerce.com' else 'd' || s_suppkey || '.test' end as domain, case when s_suppkey % 4 = 0 then 'h' || s_suppkey end as hash from supplier),
        f as (select s.shop, s.domain, coalesce(o.seq, p.seq, a.seq) as connection_seq from s left join o on s.domain = o.domain left join o p on s.hash = p.domain left join a on s.domain = a.domain)
        select shop, domain, case when connection_seq is not null then case when connection_seq % 3 = 0 then 'shopware' else 'bigcommerce' end end as connected_platform, connection_seq, r_regionkey as role_id from f, region where r_name = 'ASIA'"""),
    "catalog_gates": (catalog_gates, "select c_nationkey as shop, case when c_nationkey % 5 = 0 then 'woocommerce' else 'magento' end as platform, c_nationkey % 5 = 0 or count(*) filter (where c_acctbal > 8500) / count(*) < 0.1 as supplement, (select count(*) from orders where o_orderkey % 3 = 0) as affected, (select count(*) from orders where o_orderkey % 3 = 0 and o_custkey % 2 = 0) as replaced, null as retention from customer group by c_nationkey"),
    "dead_letter_queue": (dead_letter_queue, "select 'late' as error, user_id::varchar as url, count(*) as n from events where event_type = 'click' and event_id % 2 <> 0 and ts > timestamp '2024-01-06 00:00:00' group by all union all select 'bad', user_id::varchar, count(*) from events where event_type = 'error' group by all"),
    "report_json": (report_json, "select o_orderpriority, count(*) as jobs, 3 as keys from orders group by 1"),
}
