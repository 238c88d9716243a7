"""Crawled pages, sites and public APIs on nulls, empty tables, ties and odd answers."""

import json
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.operators import extract, layers, substrings
from millrace.sources import payloads

CRAWL = "id int, html string, metadata map<string,string>, markdown string, images array<struct<src: string, score: double>>"


def ld(**fields):
    return f'<script type="application/ld+json">{json.dumps({"@type": "Product", **fields})}</script>'


def test_layers_of_odd_pages(spark):
    rows = [
        (1, None, None, None, None),
        (2, "", {}, "", []),
        (3, ld(name="Own", offers={"price": "0"}), {"og:title": "Tag", "og:price:amount": "0"}, "# Mark\n$ 4.00", [("", 9.0), ("b", None), ("a", 0.0)]),
        (4, "<meta property='og:type' content='Product.Item'>", {"og:title": ""}, "**ab** text\n**Bold one** x", None),
        (5, ld(name="Same", sku="1") + ld(name=" same ", sku="1") + ld(name="Same", sku="2"), None, None, None),
        (6, "<p>blog</p>", {"og:title": "Post", "og:image": "p.jpg"}, "# Post\nno amounts", [("x", 5.0)]),
    ]
    got = layers.crawled_products(spark.createDataFrame(rows, CRAWL), "id")
    assert sorted((r.id, r.name, r.price, r.currency, r.sku, r.image) for r in got.collect()) == [(3, "Own", "4.00", "USD", None, "b"), (4, None, None, None, None, None), (5, "Same", None, None, "1", None), (5, "Same", None, None, "2", None)]
    assert layers.crawled_products(spark.createDataFrame([], CRAWL), "id").count() == 0


def test_titles_of_markdown(spark):
    cases = [("# One two\n## Three", "One two"), ("# X\n## Three", "Three"), ("text\n**Bold** x", "Bold"), ("#Nope\n ** no**", None), ("# " + "a" * 301, None), (None, None), ("", None)]
    assert [(r.m, r.t) for r in spark.createDataFrame([(m,) for m, _ in cases], "m string").select("m", layers.markdown_title("m").alias("t")).collect()] == cases


def test_sites_without_signals(spark):
    shape = "i int, html string, headers map<string,string>, probes array<struct<path: string, status: int, body: string>>"
    rows = [
        (1, None, None, None),
        (2, "", {}, []),
        (3, None, {"x-SHOPID": "1"}, [("/products.json", 200, '{"products":[]}')]),
        (4, "<script src=//cdn.shopify.com>", {"LINK": "</wp-json/>; rel=https://api.w.org/"}, [("/wp-json/", 500, '{"namespaces":[]}'), ("/wp-json/", 200, "broken")]),
        (5, None, None, [("/rest/V1/store/storeConfigs", 200, "[]"), ("/api/_info/config", 200, None)]),
    ]
    got = spark.createDataFrame(rows, shape).select("i", F.inline(F.array(extract.site_platform("html", F.col("headers"), F.col("probes"))))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("generic", 0, 0.0), ("generic", 0, 0.0), ("shopify", 2, 0.5), ("shopify", 1, 0.25), ("shopware", 1, 0.25)]


def test_public_pages_of_odd_jobs(spark):
    body = lambda *ids: json.dumps({"products": [{"id": i} for i in ids]})
    rows = [
        ("empty", 1, 1, 200, body(), None), ("no list", 1, 1, 200, '{"products": 5}', None), ("gap", 1, 1, 200, body(1, 2), None), ("gap", 3, 1, 200, body(3, 4), None),
        ("full", 1, 1, 200, body(1, 2), None), ("full", 2, 1, 200, body(3, 4), "E'U\"R"), ("gone", 1, 1, 404, None, "EUR"), ("late", 1, 1, 429, None, None), ("late", 1, 2, 200, body(7), "CHF"), ("none", 1, 1, 200, "{}", None),
    ]
    found, jobs = payloads.fetched(spark.createDataFrame(rows, "job string, page int, attempt int, status int, body string, currency string"), "job", "$.products", 2)
    assert {r.job: tuple(r)[1:] for r in jobs.collect()} == {
        "empty": (0, 0, True, None), "no list": (0, 0, False, "unexpected format on page 1"), "gap": (2, 2, True, None), "full": (4, 2, True, None), "gone": (0, 0, False, "not found on page 1"), "late": (1, 1, True, None), "none": (0, 0, True, None),
    }
    told = sorted((r.job, r.i, r.c) for r in found.select("job", F.expr("variant_get(raw, '$.id', 'int') as i"), F.expr("try_variant_get(raw, '$._shop_currency', 'string') as c")).collect())
    assert told == [("full", 1, "EUR"), ("full", 2, "EUR"), ("full", 3, "EUR"), ("full", 4, "EUR"), ("gap", 1, None), ("gap", 2, None), ("late", 7, None)]


def test_texts_that_hold_patterns(spark):
    texts, patterns = ["abcabc", "ab", "xyz", "a%c", "", None, "日本語テキスト"], ["abc", "ab", "b", "%", "zz", "", None, "本語テ", "abcabcabc", "xyz"]
    frames = (spark.createDataFrame([(v,) for v in values], f"{name} string") for values, name in ((texts, "t"), (patterns, "p")))
    got = substrings.holding(*(x for pair in zip(frames, ("t", "p"), strict=True) for x in pair))
    assert {tuple(r) for r in got.collect()} == {(t, p) for t in texts for p in patterns if t and p and p in t}
    none = spark.createDataFrame([], "t string")
    assert substrings.holding(none, "t", none, "t").count() == 0


def test_patches_of_odd_shops(spark):
    """Wildcards, blank domains, repeated ids, changes without a key: against changes taken one after the other; a place has one row however many changes and products meet there."""
    dice = random.Random(5)
    shops, keys = ["https://a.test", "https://www.a.test", "https://b_c.test", "https://bxc.test", "", None], ["k", "l", "", None]
    products = [(dice.randrange(60), dice.choice(shops), dice.choice(keys), "v", None) for _ in range(80)]
    changes = [(i, dice.choice(shops), dice.choice(["a.test", "b_c", "%", "", "nowhere", None]), dice.choice(keys), dice.choice([None, f"V{i}"]), dice.choice([None, f"M{i}"])) for i in range(60)]
    hits, invalid = [], 0
    for pos, shop, domain, key, *values in changes:
        if not key or values == [None, None]:
            invalid += 1
            continue
        own = [r for r in products if r[2] == key]
        like = domain is not None and re.compile(".*" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in domain) + ".*")
        found = [r for r in own if shop is not None and r[1] == shop] or [r for r in own if like and r[1] is not None and like.fullmatch(r[1])]
        hits += [(pos, r[0], values) for r in found]
    last = lambda i, c, old: next((v[c] for _, k, v in reversed(hits) if k == i and v[c] is not None), old)
    frames = spark.createDataFrame(products, "id int, shop_id string, match_key string, vendor string, mpn string"), spark.createDataFrame(changes, "pos int, shop string, domain string, match_key string, vendor string, mpn string")
    patched, counts = substrings.patch_shops(*frames, "id", ["vendor", "mpn"])
    assert sorted(map(str, patched.collect())) == sorted(str(Row(id=i, shop_id=s, match_key=k, vendor=last(i, 0, v), mpn=last(i, 1, m))) for i, s, k, v, m in products)
    done = len({pos for pos, *_ in hits})
    assert tuple(counts.first()) == (len(hits), 60 - invalid - done, invalid, 60)
    one = spark.range(500).select(F.lit("https://a.test").alias("shop"), F.lit("a.test").alias("domain"), F.lit("k").alias("match_key"), F.col("id").alias("pos"), F.lit("V").alias("vendor"), F.lit(None).cast("string").alias("mpn"))
    places, found = substrings.patch_places(spark.createDataFrame([("https://a.test", "k"), ("https://www.a.test", "k")], "shop_id string, match_key string"), one, ["vendor", "mpn"])
    assert [(r.shop_id, r.match_key, r._changes, r._vendor.pos) for r in places.collect()] == [("https://a.test", "k", 500, 499)] and found.count() == 500


def test_texts_that_hold_many_patterns_and_agree_in_a_key(spark):
    """Shops whose names have all their short stretches in common: only what is held is joined."""
    texts = [(i % 3, f'{{"url": "https://shop{i}.test/p"}}') for i in range(400)] + [(1, "é" * 40), (1, ""), (None, "https://shop1.test")]
    patterns = [(i % 2, f"https://shop{i}.test") for i in range(0, 500, 3)] + [(1, "é" * 33), (1, "é"), (1, "op1"), (None, "https")]
    frames = spark.createDataFrame(texts, "a int, t string"), spark.createDataFrame(patterns, "b int, p string")
    got = [tuple(r) for r in substrings.holding(frames[0], "t", frames[1], "p", ("a", "b")).collect()]
    assert sorted(got) == sorted({(t, p, b) for a, t in texts for b, p in patterns if a == b and a is not None and p in t})
    data, offsets = substrings.laid_out(pa.array([t for _, t in texts]))
    known = np.zeros(1 << 17, np.uint8)
    np.bitwise_or.at(known, (bits := substrings.pattern_bits(pa.array([p for _, p in patterns]), 1 << 20)) >> np.uint64(3), np.uint8(1) << (bits & np.uint64(7)).astype(np.uint8))
    row, *_ = substrings.text_hits(data, offsets, sorted({len(p.encode()) for _, p in patterns}), known)
    held = sum(len(re.findall(f"(?={re.escape(p)})", t)) for _, t in texts for p in {p for _, p in patterns})
    assert held <= len(row) <= held * 1.02
