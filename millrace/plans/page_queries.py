"""Page, URL and text operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import money, presence, text, urls
from millrace.operators import evals, extract, layers, quality
from millrace.session import table


def pages(s, d):
    return table(s, d, "pages")


def page_meta(s, d):
    """EXT-08, SRC-14."""
    return pages(s, d).select("page_id", extract.title("html").alias("title"), extract.language("html").alias("lang"), urls.bare_domain("url").alias("domain"))


def url_parts(s, d):
    """URL-01 to URL-05, FLT-10, FLT-12."""
    return pages(s, d).select("page_id", urls.normalized("url").alias("normalized"), urls.bare_domain("url").alias("domain"), urls.path_key("url").alias("path_key"), urls.is_non_product("url").alias("non_product"), urls.is_safe("url").alias("safe"))


def url_majority(s, d):
    """FLT-11: of the pages of a language those under /en/ if they are 30 % of all, else all; the share is one number."""
    flagged = pages(s, d).withColumn("hit", F.contains("url", F.lit("/en/")))
    share = flagged.agg(F.avg(F.col("hit").cast("int")).alias("share"))
    return flagged.join(F.broadcast(share)).where(F.col("hit") | (F.col("share") < 0.3)).select("page_id", "url")  # share is one row


def page_anchors(s, d):
    """EXT-09: links of each page with their places."""
    return pages(s, d).select("page_id", F.posexplode(extract.anchors("html")).alias("pos", "href"))


def page_text(s, d):
    """EXT-16, FN-14: length of the visible text, without scripts and comments."""
    return pages(s, d).select("page_id", F.length(extract.visible_text("html")).alias("n_text"), F.md5(extract.visible_text("html")).alias("digest"))


def page_classes(s, d):
    """EXT-16, EXT-17, AGG-16: rejection, confidence and platform of each page."""
    both = pages(s, d).select("page_id", F.inline(F.array(F.struct(extract.page_class("html").alias("c"), extract.platform("html").alias("p")))))
    return both.select("page_id", "c.rejection", "c.confidence", "c.is_product", "p.platform", F.col("p.confidence").alias("platform_confidence"))


def site_platforms(s, d):
    """EXT-17, AGG-16: pages as front pages of sites, with headers, probes and marks as far as the page's number says; many agree on one platform, some on two, some on none."""
    n = F.col("page_id")
    mark = F.element_at(F.array(*map(F.lit, ('<META name="Generator" content="Shopify">', "<script src=//CDN.shopify.com/x>", "<link href=/wp-content/plugins/woocommerce/a.css>", '<meta name="platform" content="bigcommerce">', "<i>/bundles/storefront/</i>", ""))), (n % 6 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("X-ShopId", "Link", "X-Magento-Cache", "SW-Version-Id", "server"))), (n % 5 + 1).cast("int"))
    headers = F.create_map(name, F.when(n % 15 == 1, "<https://x/wp-json/>; rel=other").otherwise("<https://x/WP-JSON/>; rel='https://api.w.org/'"))
    probe = F.struct(F.element_at(F.array(*map(F.lit, ("/products.json", "/wp-json/", "/rest/V1/store/storeConfigs", "/api/_info/config"))), (n % 4 + 1).cast("int")).alias("path"), F.when(n % 7 == 0, 404).otherwise(200).alias("status"), F.element_at(F.array(*map(F.lit, ('{"products":[]}', '{"other":1}', "[{}]", "no json"))), (n % 4 + 1).cast("int")).alias("body"))
    sites = pages(s, d).select("page_id", F.concat("html", mark).alias("html"), F.when(n % 11 > 0, headers).alias("headers"), F.when(n % 13 > 0, F.array(probe)).alias("probes"))
    return sites.select("page_id", F.inline(F.array(extract.site_platform("html", F.col("headers"), F.col("probes")))))


def enriched(s, d):
    """Pages with the marks of a shop added, as far as the page's number says; work and text follow from the table.

    Even pages have a graph of two products, every fourth broken JSON before it, others a list with something else in it, or a group of variants."""
    n = F.col("page_id")
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    no = n.cast("string")
    graph = script(F.lit('{"@graph":[{"@type":"Product","name":"Zed'), no, F.lit('","gtin13":"'), F.lpad((n + 1).cast("string"), 13, "4"), F.lit('","offers":{"price":"'), (n % 50).cast("string"), F.lit('.50","priceCurrency":"EUR"}},{"@type":["Product"],"name":"Abe'), no, F.lit('","mpn":"M'), no, F.lit('","offers":[{"price":"'), (n % 7).cast("string"), F.lit('.25"}]}]}'))
    listed = script(F.lit('[{"@type":"Product","name":" "},{"@type":"Thing","name":"no"}]'))
    group = script(F.lit('{"@type":"ProductGroup","name":"G'), no, F.lit('","hasVariant":[{"name":"v"},{"offers":{"price":"0"}},{"offers":{"price":"3.75"}}]}'))
    broken = F.when(n % 4 == 0, script(F.lit('{"@type":"Product","name":'))).otherwise("")
    ld = F.when(n % 2 == 0, F.concat(broken, graph)).when(n % 5 == 1, listed).when(n % 5 == 3, group).otherwise("")
    og = F.concat(F.lit('<meta property="og:title" content="T'), n.cast("string"), F.lit('"><meta property="og:image" content="i.jpg"><meta property="product:price:amount" content="9.5"><meta property="og:title" content="Last">'))
    tracker = F.concat(F.lit("<script>gtag('G-ABC"), F.lpad(n.cast("string"), 6, "0"), F.lit("')</script><!-- UA-12345-1 -->"), F.lit("<footer>mail Shop"), n.cast("string"), F.lit('@X.org or (212) 555-0199 <a href="https://x.com/shop">x</a> <a href="https://facebook.com/a">f</a></footer>'))
    extra = F.concat(ld, F.when(n % 3 == 0, og).otherwise(""), F.when(n % 5 == 0, tracker).otherwise(""))
    return pages(s, d).select("page_id", "url", F.concat("html", extra).alias("html"))


def products_of(s, d):
    nodes = extract.products(enriched(s, d), "html", "page_id")
    return nodes.select("*", F.expr("try_variant_get(node, '$.name', 'string')").alias("name"), evals.offer_price(F.col("offers")).alias("price"))


def product_nodes(s, d):
    """EXT-01, EXT-02, EXT-06: product nodes of the enriched pages with their own identifiers."""
    return extract.product_identifiers(products_of(s, d), "page_id", "name", "price").select("page_id", "name", "price", "gtin", "mpn")


def layered_products(s, d):
    """EXT-03, EXT-05, FLT-15, JOIN-09, JOIN-12, WIN-03: each JSON-LD product with its gaps filled from OpenGraph, then the page; pages without one need a product's signal."""
    page = enriched(s, d).select("page_id", extract.opengraph("html").alias("og"), extract.title("html").alias("page_title"))
    own = products_of(s, d).select("page_id", "name", "price")
    joined = page.join(own.withColumn("found", F.lit(True)), "page_id", "left").where(F.col("found").isNotNull() | extract.product_signal("og", F.lit(None).cast("string")))
    first = lambda *c: presence.first_truthy(*(F.nullif(F.trim(x), F.lit("")) for x in c))
    return joined.select("page_id", first(F.col("name"), F.col("og")["og:title"], F.col("page_title")).alias("title"), first(F.col("price"), F.col("og")["product:price:amount"]).alias("price"), F.col("og")["og:image"].alias("image"))


def crawl_layers(s, d):
    """EXT-04, EXT-05, FLT-15, JOIN-09, JOIN-13, JOIN-14, SORT-09: pages as crawls: the same product twice, JSON-LD with gaps, OpenGraph in metadata and HTML, Markdown alone, a page that is no product, offers of which one is free."""
    n, no = F.col("page_id"), F.col("page_id").cast("string")
    ld = lambda *parts: F.concat(F.lit('<script type="application/ld+json">{"@type":"Product"'), *parts, F.lit("}</script>"))
    kind = n % 5
    first = F.concat(F.lit(',"name":" A'), no, F.lit('","sku":"s","offers":{"price":"5.50","priceCurrency":"EUR"}'))
    html = (
        F.when(kind == 0, F.concat(ld(first), ld(F.replace(first, F.lit(" A"), F.lit("a")), F.lit(',"description":"long"')), ld(F.lit(',"name":"B","offers":{"price":"1"}'))))
        .when(kind == 1, F.concat(ld(F.lit(',"sku":"k"')), F.lit('<meta property="og:title" content="Html"><meta property="product:price:amount" content="7.5"><meta property="product:price:currency" content="CHF">')))
        .when(kind == 4, ld(F.lit(',"name":"D","image":["own.jpg"],"offers":[{"price":"0"},{"price":"9"}]')))
        .otherwise(F.lit('<meta property="og:image" content="og.jpg">'))
    )
    metadata = F.when(kind == 1, F.create_map(F.lit("og:title"), F.lit("Meta"), F.lit("x"), F.lit("y"))).when((kind == 2) & (n % 2 == 0), F.create_map(F.lit("og:title"), F.lit("Tag")))
    markdown = F.when(kind == 2, F.concat(F.lit("# X\n## Lamp "), F.translate(no, "0123456789", "abcdefghij"), F.lit("\nshipping $ 3.00\nnow $ 12.50\n"))).when(kind == 4, "**Bold words** EUR 4.00").when(kind == 3, "no price here")
    image = lambda src, score: F.struct(F.lit(src).alias("src"), score.alias("score"))
    images = F.when(n % 7 > 0, F.array(image("", F.lit(9.0)), image("low.jpg", F.lit(1.0)), image("best.jpg", F.when(n % 3 > 0, 5.0))))
    crawls = pages(s, d).select("page_id", F.concat("html", html).alias("html"), metadata.alias("metadata"), markdown.alias("markdown"), images.alias("images"))
    return layers.crawled_products(crawls, "page_id")


def page_contacts(s, d):
    """EXT-10, FN-19, SET-06."""
    return extract.contacts(enriched(s, d), "html", "page_id").select("page_id", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def page_social(s, d):
    """EXT-09, URL-07."""
    return extract.social_links(enriched(s, d), "html", "page_id")


def page_trackers(s, d):
    """FN-20, JOIN-19."""
    tags = extract.trackers(enriched(s, d), "html", "page_id")
    services = pages(s, d).where("page_id % 10 = 0").select("page_id", F.explode(F.array(F.lit("google_analytics_ga4"), F.lit("chat"))).alias("provider"))
    return extract.with_network_services(tags, services, "page_id")


def profile_scores(s, d):
    """EXT-11, EXT-12: confidence of what a page tells of its merchant."""
    p = enriched(s, d)
    low = F.col("html")
    return p.select("page_id", extract.profile_confidence({"company_name": extract.title(low) != "", "about_text": extract.about(low).isNotNull(), "contact": F.size(text.emails(extract.regions(low, "footer", "address"))) > 0, "analytics_tags": extract.without_comments(low).rlike("G-[A-Z0-9]{6,}")}).alias("confidence"))


def sanitized_pages(s, d):
    """FN-15: no script, style, attribute or tag off the list is left; counted per page."""
    c = pages(s, d).select("page_id", text.sanitized("html").alias("html"))
    return c.select("page_id", F.length("html").alias("n"), F.size(F.regexp_extract_all("html", F.lit("(?i)<p>"), F.lit(0))).alias("paragraphs"), F.col("html").rlike(r"(?i)<(script|style|article|nav|html)\b").alias("unsafe"))


def text_contacts(s, d):
    """FN-16, FN-19: e-mail addresses and the first year of documents."""
    return table(s, d, "documents").select("doc_id", F.array_join(text.emails("text"), ",").alias("emails"), text.founding_year("text").alias("year")).where("emails <> '' or year is not null")


def text_prices(s, d):
    """FN-04: the first credible price of each document."""
    return table(s, d, "documents").select("doc_id", money.text_price("text").alias("p")).where("p is not null").select("doc_id", "p.amount", "p.currency")


def price_rules(s, d):
    """FN-01, FN-02, FN-03, T20: the three price rules on prices written in four ways."""
    p = table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"), (F.col("p_partkey") % 4).alias("k"))
    us = F.format_number("v", 2)
    eu = F.translate(us, ",.", ".,")
    raw = F.when(F.col("k") == 0, F.concat(us, F.lit(" USD"))).when(F.col("k") == 1, F.concat(F.lit("$"), us)).when(F.col("k") == 2, eu).otherwise(F.format_string("%.2f", "v"))
    rows = p.select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", money.feed_price("raw")["amount"].alias("feed"), money.feed_price("raw")["currency"].alias("currency"), money.loose_price("raw").cast("double").alias("loose"), money.listed_amount(F.regexp_replace("raw", "[^0-9.,]", "")).alias("listed"))


def gtins(s, d):
    """FN-06: part keys written at five lengths."""
    p = table(s, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, (8, 12, 13, 14, 10))), (F.col("p_partkey") % 5 + 1).cast("int")), "0").alias("raw"))
    return p.select("p_partkey", text.valid_gtin(F.concat(F.lit(" "), F.substring("raw", 1, 4), F.lit("-"), F.substring("raw", 5, 20))).alias("gtin"))


def names_of(s, d):
    """FN-17, FN-18."""
    return pages(s, d).select("page_id", text.brand_from_domain(urls.bare_domain("url")).alias("brand"), text.safe_name("url").alias("file"))


def probe_gate(s, d):
    """FLT-14, FLT-15: languages whose pages are good enough on the mean."""
    q = quality.quality(extract.title("html") != "", {"price": F.contains("html", F.lit("$")), "image": F.contains("html", F.lit("<img")), "description": F.length("html") > 3000, "sku": F.contains("html", F.lit("<h1>"))})
    return quality.batch_quality(pages(s, d).select(extract.language("html").alias("lang"), q.alias("q")), "q", "lang").where("n > 0 and quality >= 0.3")


def neighbours(s, d):
    """WIN-04: page titles' words without repeats, in order; and the page before of the same domain."""
    p = page_meta(s, d)
    w = Window.partitionBy("domain").orderBy("page_id")
    return p.select("page_id", F.array_join(F.array_distinct(F.split("title", " ")), " ").alias("words"), F.lag("page_id").over(w).alias("before"))


_HOST = r"lower(regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_DOMAIN = rf"regexp_replace({_HOST}, '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script\b[^>]*>.*?</script\s*>', ' ', 'gsi'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gsi'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = r"trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), ' ' || chr(10) || chr(9))"
_LANG = r"""substr(regexp_extract(html, '<html[^>]*\blang=["'']?([^"''\s>]+)', 1, 'i'), 1, 10)"""
_OG = """(html || case when page_id % 3 = 0 then '<meta property="og:title" content="T' || page_id || '"><meta property="og:image" content="i.jpg"><meta property="product:price:amount" content="9.5"><meta property="og:title" content="Last">' else '' end)"""
_LD = """(case when page_id % 2 = 0 then case when page_id % 4 = 0 then '<script type="application/ld+json">{"@type":"Product","name":</script>' else '' end || '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Zed' || page_id || '","gtin13":"' || lpad((page_id + 1)::varchar, 13, '4') || '","offers":{"price":"' || page_id % 50 || '.50","priceCurrency":"EUR"}},{"@type":["Product"],"name":"Abe' || page_id || '","mpn":"M' || page_id || '","offers":[{"price":"' || page_id % 7 || '.25"}]}]}</script>'
  when page_id % 5 = 1 then '<script type="application/ld+json">[{"@type":"Product","name":" "},{"@type":"Thing","name":"no"}]</script>'
  when page_id % 5 = 3 then '<script type="application/ld+json">{"@type":"ProductGroup","name":"G' || page_id || '","hasVariant":[{"name":"v"},{"offers":{"price":"0"}},{"offers":{"price":"3.75"}}]}</script>' else '' end)"""
_NODES = f"""(with h as (select page_id, html || {_LD} as html from pages),
  b as (select page_id, unnest(regexp_extract_all(html, '<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1, 's')) as body from h),
  t as (select page_id, unnest(case when json_type(body) = 'ARRAY' then json_extract(body, '$[*]') else [body::json] end) as node from b where json_valid(body)),
  n as (select page_id, unnest(list_concat([node], json_extract(node, '$."@graph"[*]'))) as node from t),
  p as (select page_id, node, list_filter(json_extract(node, '$.hasVariant[*]'), lambda v: coalesce(try_cast(v ->> '$.offers.price' as double), 0) <> 0) as priced from n where contains(coalesce(node ->> '$."@type"', ''), 'Product'))
  select page_id, node ->> '$.name' as name, coalesce(node ->> '$.offers.price', node ->> '$.offers[0].price', priced[1] ->> '$.offers.price') as price, node ->> '$.gtin13' as gtin, node ->> '$.mpn' as mpn from p)"""
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_NON = rf"(regexp_extract(lower({_PATH}), '(\.[^.]*)$', 1) in ({_IN(urls.NON_PRODUCT_ENDINGS)}) or {_PATH} = '' or lower({_PATH}) in ({_IN(urls.NON_PRODUCT_PATHS)}) or list_has_any(string_split(ltrim(lower({_PATH}), '/'), '/'), [{_IN(urls.NON_PRODUCT_SEGMENTS)}]) or regexp_matches({_PATH}, '/\d{{4}}/\d{{2}}/\d{{2}}/'))"
QUERIES = {
    "page_meta": (page_meta, f"select page_id, {_TITLE} as title, {_LANG} as lang, {_DOMAIN} as domain from pages"),
    "url_parts": (url_parts, rf"select page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), case when lower(url) like 'http://%' then ':80$' else ':443$' end, '') || {_PATH} || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) as normalized, {_DOMAIN} as domain, {_PATH} as path_key, {_NON} as non_product, true as safe from pages"),
    "url_majority": (url_majority, "select page_id, url from pages where url like '%/en/%' or (select avg((url like '%/en/%')::int) from pages) < 0.3"),
    "page_anchors": (page_anchors, r"""select page_id, (k - 1)::int as pos, hrefs[k] as href from (select page_id, hrefs, unnest(range(1, len(hrefs) + 1)) as k from (select page_id, regexp_extract_all(html, '<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1, 'i') as hrefs from pages))"""),
    "page_text": (page_text, f"select page_id, length({_VISIBLE})::int as n_text, md5({_VISIBLE}) as digest from pages"),
    "page_classes": (page_classes, None),
    "site_platforms": (site_platforms, """with m as (select page_id, page_id % 6 as k, page_id % 11 > 0 as h, page_id % 5 as e, page_id % 13 > 0 and page_id % 7 <> 0 as p, page_id % 4 as a from pages),
        c as (select page_id, (k in (0, 1))::int + (h and e = 0)::int + (p and a = 0)::int as sh, (k = 2)::int + (h and e = 1 and page_id % 15 <> 1)::int as wo, (h and e = 2)::int + (p and a = 2)::int as ma, (k = 3)::int as bi, (k = 4)::int + (h and e = 3)::int + (p and a = 3)::int as sw from m),
        t as (select *, greatest(sh, wo, ma, bi, sw) as signals from c)
        select page_id, case when signals = 0 then 'generic' when sh = signals then 'shopify' when wo = signals then 'woocommerce' when ma = signals then 'magento' when bi = signals then 'bigcommerce' else 'shopware' end as platform, signals,
          round(signals / case when signals = 0 then 1 when sh = signals or wo = signals then 4 when ma = signals or bi = signals then 3 else 4 end, 4)::double as confidence from t"""),
    "product_nodes": (product_nodes, f"select * from {_NODES}"),
    "layered_products": (layered_products, f"""with p as (select page_id, regexp_extract_all({_OG}, 'property="og:title" content="([^"]*)"', 1)[-1] as og_title, nullif(regexp_extract({_OG}, 'property="product:price:amount" content="([^"]*)"', 1), '') as og_price, nullif(regexp_extract({_OG}, 'property="og:image" content="([^"]*)"', 1), '') as image, {_TITLE} as title from pages)
        select p.page_id, coalesce(nullif(trim(n.name), ''), og_title, nullif(title, '')) as title, coalesce(n.price, og_price) as price, image from p left join {_NODES} n on p.page_id = n.page_id where n.page_id is not null or og_price is not null"""),
    "crawl_layers": (crawl_layers, """with p as (select page_id, page_id % 5 as k, case when page_id % 7 > 0 then case when page_id % 3 > 0 then 'best.jpg' else 'low.jpg' end end as best from pages)
        select page_id, 'a' || page_id as name, '5.50' as price, 'EUR' as currency, 's' as sku, best as image, 'long' as description from p where k = 0
        union all select page_id, 'B', '1', null, null, best, null from p where k = 0 union all select page_id, 'Meta', '7.5', 'CHF', 'k', best, null from p where k = 1
        union all select page_id, case when page_id % 2 = 0 then 'Tag' else 'Lamp ' || translate(page_id::varchar, '0123456789', 'abcdefghij') end, '12.50', 'USD', null, 'og.jpg', null from p where k = 2
        union all select page_id, 'D', '9', null, null, 'own.jpg', null from p where k = 4"""),
    "page_contacts": (page_contacts, "select page_id, case when page_id % 5 = 0 then 'shop' || page_id || '@x.org' else '' end as emails, case when page_id % 5 = 0 then '(212) 555-0199' else '' end as phones from pages"),
    "page_social": (page_social, "select page_id, network, url from (select page_id from pages where page_id % 5 = 0), (values ('twitter', 'https://x.com/shop'), ('facebook', 'https://facebook.com/a')) as v(network, url)"),
    "page_trackers": (page_trackers, "select page_id, 'google_analytics_ga4' as provider, 'GA4' as tag_type, 'G-ABC' || lpad(page_id::varchar, 6, '0') as tag_id from pages where page_id % 5 = 0 union all select page_id, 'chat', null, null from pages where page_id % 10 = 0"),
    "profile_scores": (profile_scores, None),
    "sanitized_pages": (sanitized_pages, None),
    "text_contacts": (text_contacts, r"select doc_id, emails, year from (select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), lambda x: not regexp_matches(x, '\.(png|jpg|gif|css|js)$')), lambda x: lower(x)))), ','), '') as emails, try_cast(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1) as int) as year from documents) where emails <> '' or year is not null"),
    "text_prices": (text_prices, None),
    "price_rules": (price_rules, "select p_partkey, case k when 0 then replace(us, ',', '') when 1 then case when us like '%,%' then '$' || replace(us, ',', '') else '$' || us end when 2 then case when eu like '%.%' then replace(eu, ',', '') else replace(eu, ',', '.') end else plain end as feed, case when k = 0 then 'USD' end as currency, case k when 0 then 0.0 when 1 then replace(us, ',', '')::double when 2 then case when eu like '%.%' then round(replace(eu, ',', '')::decimal(38,6), 6)::double else replace(eu, ',', '.')::double end else plain::double end as loose, printf('%.2f', v) as listed from (select p_partkey, p_partkey % 4 as k, p_retailprice as v, format('{:,.2f}', p_retailprice) as us, translate(format('{:,.2f}', p_retailprice), ',.', '.,') as eu, printf('%.2f', p_retailprice) as plain from part)"),
    "gtins": (gtins, "select p_partkey, case when p_partkey % 5 = 4 or p_partkey = 0 then null when p_partkey % 5 = 1 then lpad(p_partkey::varchar, 13, '0') else lpad(p_partkey::varchar, ([8, 12, 13, 14, 10])[p_partkey % 5 + 1], '0') end as gtin from part"),
    "names_of": (names_of, rf"select page_id, array_to_string(list_transform(string_split(replace(split_part({_DOMAIN}, '.', 1), '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as brand, regexp_replace(url, '[^a-zA-Z0-9.\-]', '_', 'g') as file from pages"),
    "probe_gate": (probe_gate, f"select lang, count(*) as n, round(avg(case when {_TITLE} <> '' then 0.4 + 0.15 * (contains(html, '$')::int + contains(html, '<img')::int + (length(html) > 3000)::int + contains(html, '<h1>')::int) else 0 end), 4)::double as quality from (select *, {_LANG} as lang from pages) group by lang having quality >= 0.3"),
    "neighbours": (neighbours, f"select page_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') as words, lag(page_id) over (partition by domain order by page_id) as before from (select page_id, string_split({_TITLE}, ' ') as w, {_DOMAIN} as domain from pages)"),
}
