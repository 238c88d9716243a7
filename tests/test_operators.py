"""Rules that no table of the driver shows: raw shapes, feeds, pages, scores, breakers."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import money, presence, similarity, text, urls
from millrace.operators import access, catalog, evals, extract, normalize
from millrace.sources import feeds, payloads


def values(spark, rows, schema, **columns):
    got = spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in got]


def test_presence(spark):
    """T1: the three notions side by side."""
    rows = [(None,), ("",), (" \n",), ("0",), ("x",)]
    assert values(spark, rows, "v string", f=presence.filled("v"), s=presence.scored("v"), t=presence.truthy("v")) == [(False, False, False), (False, False, False), (False, False, True), (True, True, True), (True, True, True)]
    assert values(spark, [(0.0,), (2.0,), (None,)], "v double", f=presence.filled("v"), s=presence.scored("v")) == [(True, False), (True, True), (False, False)]
    assert values(spark, [("0.00",), ("0",), ("5",), (None,)], "v string", z=presence.price_is_zero("v"), u=presence.usable_price("v")) == [(True, "0.00"), (True, None), (False, "5"), (True, None)]


def test_money(spark):
    rows = [("1,299.99 USD",), ("49,99 EUR",), ("12",), ("",), ("1.299,90",)]
    assert values(spark, rows, "v string", a=money.feed_price("v")["amount"], c=money.feed_price("v")["currency"]) == [("1299.99", "USD"), ("49.99", "EUR"), ("12", None), (None, None), ("1.29990", None)]
    assert values(spark, [("$1,299.99",), ("49,99 €",), ("none",)], "v string", a=money.loose_price("v").cast("string")) == ["1299.990000", "49.990000", "0.000000"]
    assert values(spark, [("1.299,90",), ("29,90",), ("1,299",), ("0",), ("2000000",)], "v string", a=money.listed_amount("v")) == ["1299.90", "29.90", "1299.00", None, None]
    assert values(spark, [("Shipping $5.00\nNow €29,90 only",), ("EUR 12.50",), ("ABC 3",), ("no price",)], "v string", p=money.text_price("v")) == [("29.90", "EUR"), ("12.50", "EUR"), ("3.00", None), None]


def test_identifiers(spark):
    rows = [(" 4006381-333931 ",), ("123456789012",), ("00000000",), ("12345",), (None,), ("abcdefgh",)]
    assert values(spark, rows, "v string", g=text.valid_gtin("v")) == ["4006381333931", "0123456789012", None, None, None, None]
    key = text.idempotency_key(F.lit(""), F.lit("p"), F.lit("s"), F.lit(None), F.col("v"))
    one, two = values(spark, [("a",), ("b",)], "v string", k=key)
    assert one != two


def test_markup(spark):
    html = '<p onclick="x">Hi <a href="/u" class="c" title="t">you</a><script>var t="</p>"</script><b>B</b></p><style>p{}</style>'
    assert values(spark, [(html,)], "v string", s=text.sanitized("v")) == ['<p>Hi <a href="/u" title="t">you</a>B</p>']
    assert values(spark, [("<p>a</p>\n <i>b</i>",)], "v string", s=text.feed_text("v")) == ["a b"]
    assert values(spark, [("# A title\ntext",), ("x **bold text** y",), ("no",)], "v string", s=text.markdown_title("v")) == ["A title", "bold text", None]


def test_urls(spark):
    rows = [("HTTPS://Shop.Example.com:443/Products/A/?q=1#f",), ("http://x.test:8080/",), ("not a url",)]
    assert values(spark, rows, "v string", n=urls.normalized("v")) == ["https://shop.example.com/Products/A?q=1", "http://x.test:8080", "not a url"]
    assert values(spark, [("www.Shop.de/x",), ("https://www.a.b:9/",)], "v string", d=urls.bare_domain("v")) == ["shop.de", "a.b"]
    assert values(spark, [("https://a.b/products/Red-Shoe/?v=1",), ("https://a.b/x",)], "v string", h=urls.handle("v")) == ["red-shoe", None]
    odd = ["https://a.b/x.pdf", "https://a.b/", "https://a.b/shop/cart/1", "https://a.b/2023/02/16/post", "https://a.b/products/1"]
    assert values(spark, [(u,) for u in odd], "v string", n=urls.is_non_product("v")) == [True, True, True, True, False]
    safe = ["https://a.b/", "ftp://a.b/", "http://127.0.0.1/", "http://10.1.2.3/", "http://localhost/", "http://a.b:22/", "http://8.8.8.8/", "http://999.1.1.1/"]
    assert values(spark, [(u,) for u in safe], "v string", n=urls.is_safe("v")) == [True, False, False, False, False, False, True, False]
    assert values(spark, [('<https://a/1>; rel="previous", <https://a/2>; rel="next"',), ("",)], "v string", n=urls.next_page("v")) == ["https://a/2", None]


RAW = [
    ("shopify", {"id": 1, "title": " Shoe ", "handle": "shoe", "tags": "a, b", "images": [{"src": "i1"}, {"src": "i2"}], "variants": [{"id": 5, "price": "19.99", "sku": "S", "barcode": "123456789012", "inventory_quantity": 0}, {"id": 6, "price": "x", "inventory_quantity": 3}]}),
    ("woocommerce", {"id": 2, "name": "Cup", "prices": {"price": "1299", "regular_price": "1599", "currency_code": "EUR", "currency_minor_unit": 2}, "images": [{"src": "a"}, {"src": "b"}], "categories": [{"name": "c1"}, {"name": "c2"}]}),
    ("woocommerce", {"id": 3, "name": "Three", "prices": {"price": "1299", "currency_minor_unit": 3}}),
    ("magento", {"id": 9, "sku": "m1", "name": "Bag", "price": 12.5, "custom_attributes": [{"attribute_code": "ean", "value": "3"}, {"attribute_code": "url_key", "value": "bag"}, {"attribute_code": "ean", "value": "4"}]}),
    ("shopware", {"id": "s", "name": "Lamp", "price": "10.00", "compare_at_price": "10.00", "ean": "4006381333931", "in_stock": False, "condition": "New"}),
    ("generic", {"_source": "google_feed", "id": "g", "title": "Feed", "price": "50", "sale_price": "40", "availability": "out of stock", "condition": "Refurbished", "product_type": "A > B"}),
    ("generic", {"@type": ["Product"], "name": "LD", "offers": [{"price": 5, "priceCurrency": "usd", "availability": "http://schema.org/InStock"}], "image": [{"url": "p1"}, "p2"], "brand": {"name": "B"}, "additionalProperty": [{"name": "EAN", "value": "4006381333931"}], "category": "A/B > C"}),
    ("generic", {"og:title": "OG", "product:price:amount": "9.5"}),
    ("generic", {"title": "CSS", "price": "$1,299.99"}),
    ("generic", {"title": "none"}),
    ("generic", {"x": 1}),
]


def test_normalize(spark):
    frame = spark.createDataFrame([("s", p, json.dumps(r), "https://shop.x/") for p, r in RAW], "shop_id string, platform string, j string, shop_url string")
    got = normalize.normalize(frame.withColumn("raw", F.parse_json("j")).drop("j")).drop("raw").collect()
    shoe, cup, three, bag, lamp, fed, ld, og, css, none, nothing = got
    assert (shoe.title, shoe.price, shoe.gtin, shoe.tags, shoe.in_stock, len(shoe.variants), shoe.additional_images) == ("Shoe", Decimal("19.99"), "0123456789012", ["a", "b"], True, 1, ["i2"])
    assert (cup.price, cup.compare_at_price, cup.currency, cup.category_path) == (Decimal("12.99"), Decimal("15.99"), "EUR", ["c1", "c2"])
    assert three.reject_reason == "price_places"  # T3
    assert (bag.gtin, bag.product_url, bag.external_id) == ("4", "https://shop.x/bag.html", "m1")  # T9
    assert (lamp.condition, lamp.compare_at_price, lamp.in_stock) == ("New", None, False)
    assert (fed.price, fed.compare_at_price, fed.condition, fed.in_stock, fed.category_path) == (Decimal("40.00"), Decimal("50.00"), "REFURBISHED", False, ["A", "B"])
    assert (ld.price, ld.currency, ld.image_url, ld.additional_images, ld.vendor, ld.gtin, ld.category_path) == (Decimal("5.00"), "USD", "p1", ["p2"], "B", "4006381333931", ["A", "B", "C"])
    assert (og.price, css.price) == (Decimal("9.50"), Decimal("1299.99"))
    assert (none.reject_reason, nothing.reject_reason) == ("nothing_to_identify", "no_title")


def test_feeds(spark):
    xml = '<?xml version="1.0"?><rss xmlns:g="x"><channel><item><g:id>1</g:id><title><![CDATA[A & B]]></title><g:price>1,299.99 USD</g:price><g:ean>0012345678905</g:ean><g:additional_image_link>u1</g:additional_image_link><g:additional_image_link>u2</g:additional_image_link></item><item><title></title></item></channel></rss>'
    tsv = "﻿id\ttitle\tprice\tadditional_image_link\n2\tTwo\t49,99 EUR\tx,y\n3\tShort\n4\t\t1"
    rows = spark.createDataFrame([("a", xml, "application/xml"), ("b", tsv, "text/plain"), ("c", "<!DOCTYPE x><item><title>no</title></item>", "text/xml")], "url string, body string, type string")
    got = {r.url: r for r in feeds.feeds(rows, "body", "type", "url").withColumn("j", F.to_json("raw")).where("pos < 1").collect()}
    one, two = json.loads(got["a"].j), json.loads(got["b"].j)
    assert (one["title"], one["price"], one["currency"], one["gtin"], one["additional_image_link"]) == ("A & B", "1299.99", "USD", "0012345678905", ["u1", "u2"])
    assert (two["title"], two["price"], two["additional_image_link"], set(got)) == ("Two", "49.99", ["x", "y"], {"a", "b"})
    assert feeds.feeds(rows, "body", "type", "url").count() == 3
    maps = spark.createDataFrame([("<urlset><url><loc> https://a/1 </loc></url><url><loc>https://a/2?x=1&amp;y</loc></url></urlset>",), ("<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>",), ("<urlset><url>",)], "body string")
    assert [r.url for r in feeds.sitemap(maps, "body").collect()] == ["https://a/1", "https://a/2?x=1&y"]


def test_payloads(spark):
    body = json.dumps({"data": [{"id": 1, "name": "N", "brand_id": 7, "price": 5, "availability": "available", "inventory_level": 2, "images": [{"url_standard": "b", "sort_order": 2}, {"url_standard": "a", "sort_order": 1}]}]})
    rows = payloads.records(spark.createDataFrame([(body,), ("broken",)], "body string"), "body", "$.data")
    out = payloads.bigcommerce(rows, spark.createDataFrame([(7, "B")], "id bigint, name string")).withColumn("j", F.to_json("raw")).collect()
    assert len(out) == 1 and (j := json.loads(out[0].j))["vendor"] == "B" and j["image"] == "a" and j["additional_images"] == ["b"] and j["in_stock"]
    pages = spark.createDataFrame([("j", 1, 100, 150), ("j", 2, 50, 150), ("k", 1, 100, 300)], "job string, page int, n int, total int")
    assert {r.job: (r.pages_completed, r.pages_expected, r.complete) for r in payloads.paging(pages, "job", "page", "n", "total", 100, 10).collect()} == {"j": (2, 2, True), "k": (1, 3, False)}


def test_json_ld(spark):
    html = """<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"ProductGroup","name":"G","hasVariant":[{"offers":{"price":"0"}},{"offers":{"price":"7"}}]}]</script>
    <script type="application/ld+json">{"@type":"ItemPage","mainEntity":{"@type":["Product","X"],"name":"M","gtin13":"4006381333931"}}</script>"""
    page = spark.createDataFrame([(1, html)], "page_id int, html string")
    nodes = extract.products(page, "html", "page_id")
    got = [(r.n, r.p) for r in nodes.select(F.expr("try_variant_get(node, '$.name', 'string')").alias("n"), F.expr("try_variant_get(offers, '$.price', 'string')").alias("p")).collect()]
    assert got == [("G", "7"), ("M", None)]
    assert [r.gtin for r in extract.product_identifiers(nodes, "page_id").orderBy("script", "place", "inner").collect()] == [None, "4006381333931"]  # each node has its own


def test_pages(spark):
    shop = '<html><head><title>Shoe</title><meta name="generator" content="Shopify"><meta property="product:price:amount" content="5"></head><body><script src="//cdn.shopify.com/x"></script><form action="/cart/add"></form><span class="old price">5</span>' + "word " * 200 + "</body></html>"
    rows = [(shop,), ("<title>404 - Not Found</title>" + "x" * 900,), ('<title>a</title><meta http-equiv="refresh" content="0; url=/">' + "x" * 900,), ("<p>short</p>",)]
    got = values(spark, rows, "v string", r=extract.page_class("v")["rejection"], c=extract.page_class("v")["confidence"], p=extract.platform("v")["platform"])
    assert got == [("", 0.65, "shopify"), ("error_page_title", 0.0, "generic"), ("redirect_to_homepage", 0.0, "generic"), ("insufficient_content", 0.0, "generic")]


def test_scores(spark):
    rows = [("Red shoe", "red SHOE x"), (None, "a"), ("a", None)]
    assert values(spark, rows, "a string, b string", t=similarity.score("tokens", "a", "b")) == [0.8, 1.0, 0.0]
    assert values(spark, [("https://a/x/", "http://a/x"), ("u", "U/")], "a string, b string", u=similarity.url("a", "b")) == [0.9, 1.0]
    assert values(spark, [("$100", "100.5"), ("1", "2")], "a string, b string", u=similarity.numeric("a", "b")) == [1.0, 0.0]
    assert values(spark, [("abcd", "bcde")], "a string, b string", u=similarity.ratio("a", "b")) == [0.75]


def test_greedy_match_takes_turns(spark):
    a = spark.createDataFrame([("s", 0, "red shoe"), ("s", 1, "red shoes"), ("s", 2, "zebra")], "site string, pos bigint, title string")
    b = spark.createDataFrame([("s", 0, "red shoes"), ("s", 1, "red shoe")], "site string, pos bigint, title string")
    assert [(r.pos, r.matched) for r in evals.greedy_match(a, b, "site").orderBy("pos").collect()] == [(0, 1), (1, 0), (2, None)]


def test_chunks_merge(spark):
    rows = [("p", 0, "Blue Cup", None), ("p", 1, "blue cup large", "5"), ("p", 2, "", "9"), ("p", 3, "Other", "1")]
    got = evals.merge_chunks(spark.createDataFrame(rows, "page string, pos bigint, title string, price string"), "page", ["price"]).collect()
    assert [(r.title, r.price) for r in got] == [("Blue Cup", "5"), ("Other", "1")]


def test_deep_pages(spark):
    """All pages together are the table in order, each reads few ranges, and there is nothing behind the last or in an empty table."""
    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("rank")).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this is little data
    try:
        made = catalog.Pages(df, F.desc("rank"), F.col("id"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(r.id, r.rank) for r in df.orderBy(F.desc("rank"), "id").collect()]
    assert len(made.ends) > 1 and made.count(90) == 12
    assert [tuple(r) for n in range(1, 13) for r in made.page(n, 90).collect()] == want
    assert made.page(13, 90).count() == 0 and "PartitionFilters: [isnotnull(_part" in made.page(12, 90)._jdf.queryExecution().executedPlan().toString()
    empty = catalog.Pages(df.limit(0), F.col("id"))
    assert empty.count(90) == 0 and empty.page(1, 90).count() == 0


def test_token_replay(spark):
    """A token used twice in one batch is a replay, as is one spent before, expired or not; an expired one does nothing."""
    tokens = spark.createDataFrame([("a", 1, True, 9), ("b", 1, False, 9), ("c", 2, False, 9), ("d", 3, False, 9), ("e", 3, False, 9), ("f", 4, False, 1), ("g", 4, False, 9), ("h", 5, True, 1), ("i", 5, False, None), ("j", 6, False, None)], "token string, family int, revoked boolean, expires int")
    used = spark.createDataFrame([("a", 5), ("c", 9), ("d", 5), ("d", 5), ("f", 2), ("f", 3), ("h", 5), ("j", 7), ("nobody", 1)], "token string, at int")
    want = {"a": True, "b": True, "c": True, "d": True, "e": True, "f": False, "g": False, "h": True, "i": True, "j": True}
    assert {r.token: r.revoked for r in access.rotate(tokens, used).collect()} == want
    assert {r.token: r.revoked for r in access.rotate(tokens, used.where("token = 'c'")).collect()} == {r.token: r.revoked or r.token == "c" for r in tokens.collect()}
    assert access.rotate(tokens, used.limit(0)).where("revoked").count() == 2


def test_ingestion(spark):
    from millrace.plans import ingestion

    feed = "id\ttitle\tprice\timage_link\n1\tOne\t5.00 EUR\ti\n2\tTwo\t\t\n"
    page = '<script type="application/ld+json">{"@type":"Product","name":"P","sku":"9","offers":{"price":"3"}}</script><script type="application/ld+json">{"@type":"Store","name":"Shop","address":{"addressCountry":"DE"}}</script>'
    bodies = spark.createDataFrame([("s", "generic", "https://s/", "u1", feed, "text/csv"), ("s", "generic", "https://s/", "u2", page, "text/html; x")], "shop_id string, platform string, shop_url string, url string, body string, content_type string")
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    first = ingestion.accepted(ingestion.raw_records(bodies), as_of)
    assert {r.title for r in first.collect()} == {"One", "P", "Two"}
    again = ingestion.ingest(first, bodies, F.lit("2025-01-01 00:00:00").cast("timestamp")).collect()
    assert len(again) == 3 and {(r.created_at.year, r.updated_at.year) for r in again} == {(2024, 2025)}
    told = ingestion.report(ingestion.raw_records(bodies)).collect()[0]
    assert (told.n, told.rejected, told.verdict) == (3, 0, "passed")
    assert [(r.name, r.country) for r in extract.organizations(bodies, "body", "url").collect()] == [("Shop", "DE")]


def test_uploads_of_more_rows_than_a_service_takes(spark, tmp_path):
    """All 50,005 rows come back; a limit is the caller's."""
    head = "SKU,Brand\n"
    (tmp_path / "up.csv").write_text(head + "".join(f" s{i} ,b\n" for i in range(50_005)))
    got = feeds.upload(spark, f"{tmp_path}/up.csv")
    assert (got.count(), got.select("match_key").distinct().count(), got.columns) == (50_005, 50_005, ["sku", "brand", "match_key"])
    assert {r.match_key for r in feeds.upload(spark, f"{tmp_path}/up.csv", 3).collect()} == {"s0", "s1", "s2"}
