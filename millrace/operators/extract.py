"""Records, links and signals from HTML, by pattern functions that run in the JVM.

Scripts, styles and comments go before text is taken, since scripts may hold markup of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text, urls
from millrace.functions.presence import column, once, strip, truthy

# Patterns of tracking ids, the group that holds the id, the kind.
TRACKERS = {
    "google_analytics_ua": (r"(?i)UA-\d{4,10}-\d{1,4}", 0, "UA"),
    "google_analytics_ga4": (r"G-[A-Z0-9]{6,}", 0, "GA4"),
    "google_tag_manager": (r"GTM-[A-Z0-9]{6,}", 0, "GTM"),
    "google_adsense": (r"(?i)ca-pub-\d{10,}", 0, "AdSense"),
    "facebook_pixel": (r"""(?i)fbq\s*\(\s*['"]init['"]\s*,\s*['"](\d{10,})['"]""", 1, "Pixel"),
    "hotjar": (r"""(?i)hj\s*\(\s*['"]init['"]\s*,\s*(\d+)""", 1, "Hotjar"),
    "tiktok_pixel": (r"""(?i)ttq\.load\s*\(\s*['"]([A-Z0-9]+)['"]""", 1, "TikTok"),
    "pinterest_tag": (r"""(?i)pintrk\s*\(\s*['"]load['"]\s*,\s*['"](\d+)['"]""", 1, "Pinterest"),
    "microsoft_clarity": (r"""(?i)clarity\s*\(\s*['"]set['"].*?['"]([a-z0-9]{7,})['"]""", 1, "Clarity"),
}
# What of a page's lower-case HTML speaks for a platform; the order breaks ties.
PLATFORM_MARKS = {
    "shopify": (r"""<meta[^>]+name=["']generator["'][^>]+content=["']shopify""", r"cdn\.shopify\.com"),
    "woocommerce": (r"""<meta[^>]+name=["']generator["'][^>]+content=["']wordpress""", r"/wp-content/plugins/woocommerce/"),
    "magento": (),
    "bigcommerce": (r"""<meta[^>]+name=["']platform["'][^>]+content=["']bigcommerce""", r"cdn(11)?\.bigcommerce\.com"),
    "shopware": (r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*shopware""", r"/bundles/storefront/|shopware-storefront"),
}
MOST_SIGNALS = {"shopify": 4, "woocommerce": 4, "magento": 3, "bigcommerce": 3, "shopware": 4, "generic": 1}
ERROR_TITLES = ("404", "not found", "page not available")


def without_comments(html: Column | str) -> Column:
    return F.regexp_replace(column(html), r"(?s)<!--.*?-->", "")


def visible_text(html: Column | str) -> Column:
    """Text of a page, one blank for white space; scripts, styles, comments and tags are gone."""
    bare = F.regexp_replace(without_comments(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def title(html: Column | str) -> Column:
    return strip(F.regexp_extract(column(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def language(html: Column | str) -> Column:
    """EXT-08: at most 10 characters."""
    return F.substring(F.regexp_extract(column(html), r"""(?i)<html[^>]*\blang=["']?([^"'\s>]+)""", 1), 1, 10)


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def metas(html: Column | str) -> Column:
    """EXT-03: array of (key, value) of meta tags with property or name, blank ones left out; of equal keys the last stays (T9)."""
    tags = F.regexp_extract_all(column(html), F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    key = lambda t: F.coalesce(F.nullif(attribute(t, "property"), F.lit("")), F.nullif(attribute(t, "name"), F.lit("")), F.lit(""))
    rows = F.filter(F.transform(tags, lambda t: F.struct(F.lower(key(t)).alias("key"), strip(attribute(t, "content")).alias("value"))), lambda r: (r["key"] != "") & (r["value"] != ""))
    return F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda later: later["key"] == r["key"]))


def opengraph(html: Column | str) -> Column:
    """EXT-03: map of og: and product: values."""
    return F.map_from_entries(F.filter(metas(html), lambda r: r["key"].rlike("^(og|product):")))


def json_ld(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """EXT-01: a row for each JSON-LD node of a page with its place: objects, lists, members of @graph and main entities of pages. Broken JSON is skipped."""
    bodies = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<script[^>]*type=["']?application/ld\+json["']?[^>]*>(.*?)</script>"""), F.lit(1))
    parsed = pages.select(*keep, F.posexplode(bodies).alias("script", "body")).where(F.col("body").rlike(r"[}\]]\s*$")).withColumn("node", F.expr("try_parse_json(body)")).where("node is not null")
    whole = "coalesce(try_variant_get(node, '$', 'array<variant>'), array(node))"
    top = parsed.select(*keep, "script", F.posexplode(F.expr(whole)).alias("place", "node"))
    inner = "array_compact(concat(array(node), coalesce(try_variant_get(node, '$[\\'@graph\\']', 'array<variant>'), array()), array(try_variant_get(node, '$.mainEntity', 'variant'), try_variant_get(node, '$.mainEntityOfPage', 'variant'))))"
    return top.select(*keep, "script", "place", F.posexplode(F.expr(inner)).alias("inner", "node"))


def node_type(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$['@type']", "string"), F.lit(""))


def products(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """EXT-01, EXT-02: product nodes. A group without a price lends the offers of its first variant that has one (`offers`)."""
    found = json_ld(pages, html, *keep).where(F.contains(node_type(F.col("node")), F.lit("Product")))
    priced = "filter(coalesce(try_variant_get(node, '$.hasVariant', 'array<variant>'), array()), v -> coalesce(try_cast(coalesce(try_variant_get(v, '$.offers.price', 'string'), try_variant_get(v, '$.offers[0].price', 'string')) as double), 0) <> 0)"
    own = "coalesce(try_variant_get(node, '$.offers', 'variant'), try_variant_get(get(" + priced + ", 0), '$.offers', 'variant'))"
    return found.withColumn("offers", F.expr(own))


def product_identifiers(nodes: DataFrame, *keep: str) -> DataFrame:
    """EXT-06: gtin and mpn of each product node."""
    get = lambda p: F.nullif(F.try_variant_get("node", f"$.{p}", "string"), F.lit(""))
    return nodes.select(*keep, "script", "place", "inner", text.valid_gtin(F.coalesce(*map(get, ("gtin13", "gtin14", "gtin12", "gtin8", "gtin")))).alias("gtin"), get("mpn").alias("mpn"))


#: Keys of a JSON-LD product that may hold personal data.
PERSONAL = ("review", "reviews", "author", "aggregateRating", "creator", "contributor", "editor", "publisher", "reviewedBy", "commentCount", "comment", "interactionStatistic")


def without_personal(node: Column | str) -> Column:
    """FLT-22: an object of VARIANT without the keys that may hold personal data."""
    return F.parse_json(F.to_json(F.map_filter(F.try_variant_get(node, "$", "map<string,variant>"), lambda k, v: ~k.isin(*PERSONAL))))


def open_graph_of(metadata: Column | str) -> Column:
    """EXT-04: the filled og: entries of a map of metadata."""
    return F.map_filter(column(metadata), lambda k, v: k.startswith("og:") & F.coalesce(v != "", F.lit(False)))


def usable(price: Column) -> Column:
    return truthy(strip(price)) & (strip(price) != "0")


def product_signal(og: Column | str, price: Column) -> Column:
    """FLT-15: whether a page without JSON-LD is of a product: its type says so, or there is a price."""
    tags = column(og)
    told = F.contains(F.lower(F.coalesce(tags["og:type"], F.lit(""))), F.lit("product"))
    return F.coalesce(told | usable(tags["og:price:amount"]) | usable(tags["product:price:amount"]) | truthy(price), F.lit(False))


def all_priced_and_shown(products: DataFrame, price: str, image: str, *by: str) -> DataFrame:
    """FLT-16: for each page whether all its products have a price and an image."""
    return products.groupBy(*by).agg(F.bool_and(F.coalesce(usable(F.col(price)), F.lit(False)) & truthy(image)).alias("complete"))


def best_image(images: Column | str) -> Column:
    """SORT-09: src of the image of the highest score, of equals the first; images (array of struct src, score) without src don't count, a low score does."""
    shown = F.filter(column(images), lambda i: truthy(i["src"]))
    top = F.array_max(F.transform(shown, lambda i, at: F.struct(F.coalesce(i["score"], F.lit(0.0)).alias("score"), (-at).alias("at"), i["src"].alias("src"))))
    return top["src"]


def layered(layers: DataFrame, key: str, rank: str, *fields: str) -> DataFrame:
    """EXT-05, JOIN-09, JOIN-12 to JOIN-14, WIN-03: for each field the first filled value by layer. Layers are rows; each group keeps one value for a field, so it reduces before the shuffle."""
    first = lambda c: F.min(F.when(F.coalesce(F.length(strip(F.col(c).cast("string"))) > 0, F.lit(False)), F.struct(rank, c))).getField(c)
    return layers.groupBy(key).agg(*(first(c).alias(c) for c in fields))


def anchors(html: Column | str) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(column(html), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def regions(html: Column | str, *names: str) -> Column:
    """HTML within the named elements, joined."""
    return F.array_join(F.regexp_extract_all(column(html), F.lit(rf"(?is)<({'|'.join(names)})\b[^>]*>.*?</\1\s*>"), F.lit(0)), "\n")


def social_links(pages: DataFrame, html: str, key: str) -> DataFrame:
    """EXT-09, URL-07: the first link of each network, from header, footer, navigation and aside where these hold any, else from the page."""
    rows = pages.select(key, F.explode(F.array(F.struct(F.lit(0).alias("rank"), regions(html, "header", "footer", "nav", "aside").alias("part")), F.struct(F.lit(1).alias("rank"), F.col(html).alias("part")))).alias("x"))
    links = rows.select(key, "x.rank", F.posexplode(anchors("x.part")).alias("pos", "url")).withColumn("network", urls.social_network("url")).where("network is not null")
    best = links.groupBy(key, "network").agg(F.min(F.struct("rank", "pos", "url")).alias("x")).select(key, "network", "x.rank", "x.url")
    chosen = best.groupBy(key).agg(F.min("rank").alias("rank"))
    return best.join(chosen, [key, "rank"]).select(key, "network", "url")


def contacts(pages: DataFrame, html: str, key: str) -> DataFrame:
    """EXT-10, SET-06: e-mail addresses and phone numbers of links and of footers and addresses, each list sorted."""
    links, low = anchors(html), visible_text(regions(html, "footer", "address"))
    mail = F.transform(F.filter(links, lambda x: x.startswith("mailto:")), lambda x: F.lower(strip(F.split_part(F.substring(x, 8, 1000), F.lit("?"), F.lit(1)))))
    tel = F.transform(F.filter(links, lambda x: x.startswith("tel:")), lambda x: strip(F.substring(x, 5, 1000)))
    return pages.select(key, F.array_sort(F.array_union(F.filter(mail, lambda x: F.contains(x, F.lit("@"))), text.emails(low))).alias("emails"), F.array_sort(F.array_union(F.filter(tel, lambda x: truthy(x)), text.phones(low))).alias("phones"))


def trackers(pages: DataFrame, html: str, key: str) -> DataFrame:
    """FN-20: distinct (provider, tag_id) of each page, comments left out."""
    bare = pages.select(key, without_comments(html).alias("html"))
    each = F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(kind).alias("tag_type"), F.regexp_extract_all("html", F.lit(pattern), F.lit(group)).alias("ids")) for p, (pattern, group, kind) in TRACKERS.items()))
    return bare.select(key, F.explode(each).alias("x")).select(key, "x.provider", "x.tag_type", F.explode(F.array_distinct("x.ids")).alias("tag_id"))


def with_network_services(tags: DataFrame, services: DataFrame, key: str) -> DataFrame:
    """JOIN-19: services (key, provider) are added where the page has no tag of that provider."""
    new = services.dropDuplicates([key, "provider"]).join(tags.select(key, "provider").distinct(), [key, "provider"], "left_anti")
    return tags.unionByName(new.select(key, "provider"), allowMissingColumns=True)


def platform(html: Column | str) -> Column:
    """EXT-17, AGG-16: struct(platform, signals, confidence): most signals, ties by declaration, none is generic."""
    return once(F.lower(column(html)), lambda low: once(F.struct(*(sum((low.rlike(m).cast("int") for m in marks), F.lit(0)).alias(name) for name, marks in PLATFORM_MARKS.items())), most_signals))


def most_signals(counted: Column) -> Column:
    """struct(platform, signals, confidence) of a struct that holds each platform's number of signals."""
    top = F.greatest(*(counted[p] for p in PLATFORM_MARKS))
    name = F.lit("generic")
    for p in reversed(PLATFORM_MARKS):
        name = F.when((counted[p] == top) & (top > 0), p).otherwise(name)
    most = F.create_map(*(F.lit(x) for pair in MOST_SIGNALS.items() for x in pair))
    return F.struct(name.alias("platform"), top.alias("signals"), F.round(F.least(F.lit(1.0), F.greatest(top, F.lit(0)) / most[name]), 4).alias("confidence"))


#: For each platform the probed path that answers 200 and the key that its JSON must have (None: whatever it says; '[0]': a list with something in it).
PROBES = {"shopify": ("/products.json", "products"), "woocommerce": ("/wp-json/", "namespaces"), "magento": ("/rest/V1/store/storeConfigs", "[0]"), "shopware": ("/api/_info/config", None)}


def header_signals(headers: Column) -> dict[str, Column]:
    """EXT-17: platforms that a map of response headers tells of; names in any case."""
    named = lambda test: F.exists(F.map_keys(headers), lambda k: test(F.lower(k)))
    link = F.lower(F.coalesce(F.array_join(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "link")), ","), F.lit("")))
    return {
        "shopify": named(lambda k: k.isin("x-shopid", "x-shopify-stage")),
        "woocommerce": F.contains(link, F.lit("wp-json")) & F.contains(link, F.lit("api.w.org")),
        "magento": named(lambda k: k.startswith("x-magento")),
        "bigcommerce": F.lit(False),
        "shopware": named(lambda k: k.isin("sw-version-id", "sw-context-token")),
    }


def probe_signals(probes: Column) -> dict[str, Column]:
    """EXT-17: platforms whose probe (array of struct path, status, body) answers as it should."""

    def answers(name: str) -> Column:
        if name not in PROBES:
            return F.lit(False)
        path, key = PROBES[name]
        good = lambda p: F.lit(True) if key is None else F.try_variant_get(F.try_parse_json(p["body"]), "$" + (key if key[0] == "[" else f".{key}"), "variant").isNotNull()
        return F.exists(probes, lambda p: (p["path"] == path) & (p["status"] == 200) & good(p))

    return {name: answers(name) for name in PLATFORM_MARKS}


def site_platform(html: Column | str, headers: Column, probes: Column, most_bytes: int = 10 * 1024 * 1024) -> Column:
    """EXT-17: struct(platform, signals, confidence) of a site by headers, probes and its front page (unless that is too large); nulls tell nothing."""
    page = F.when(F.octet_length(column(html)) <= most_bytes, F.lower(column(html)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    told, asked = header_signals(headers), probe_signals(probes)
    count = lambda name, low: sum((flag(low.rlike(m)) for m in PLATFORM_MARKS[name]), flag(told[name]) + flag(asked[name])).alias(name)
    return once(page, lambda low: once(F.struct(*(count(name, low) for name in PLATFORM_MARKS)), most_signals))


def page_class(html: Column | str) -> Column:
    """EXT-16: struct(rejection, confidence, is_product). Error titles, redirects to the front page and pages with little text are rejected."""
    h = column(html)
    refresh = strip(F.regexp_extract(F.regexp_extract(h, r"""(?i)<meta[^>]*http-equiv=["']?refresh["']?[^>]*>""", 0), r"""(?i)url\s*=\s*([^"'>]*)""", 1))
    home = h.rlike(r"""(?i)<meta[^>]*http-equiv=["']?refresh["']?[^>]*url\s*=""") & F.regexp_replace(refresh, "/+$", "").isin("")
    shown = F.length(F.regexp_replace(visible_text(h), r"\s", ""))
    rejection = F.when(F.lower(title(h)).rlike("|".join(ERROR_TITLES)), "error_page_title").when(home, "redirect_to_homepage").when(shown < 500, "insufficient_content").otherwise("")
    scripts = F.regexp_extract_all(h, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"""), F.lit(1))
    ld = F.exists(scripts, lambda body: body.rlike(r'"@type"\s*:\s*"Product"'))
    weights = (
        (ld, 0.4),
        (h.rlike(r"""(?i)<meta[^>]*property=["']product:price:amount["']"""), 0.3),
        (h.rlike(r"(?i)<(?:button|input|form)\b[^>]*(?:name|action|id|class)=[^>]*cart"), 0.2),
        (h.rlike(r"""(?i)itemprop=["']price["']|class=["'](?:[^"']*\s)?price[\s"']|\sdata-price\b"""), 0.15),
        (h.rlike(r"""(?i)itemprop=["']name["']|class=["'](?:[^"']*\s)?product-title[\s"']|<h1[^>]*class=["'](?:[^"']*\s)?product-name[\s"']"""), 0.1),
    )
    score = F.round(F.least(F.lit(1.0), sum((F.when(c, w).otherwise(0.0) for c, w in weights), F.lit(0.0))), 4)
    judged = lambda r: F.struct(r.alias("rejection"), F.when(r != "", 0.0).otherwise(score).alias("confidence"))
    with_class = lambda x: F.struct(x["rejection"].alias("rejection"), x["confidence"].alias("confidence"), ((x["rejection"] == "") & (x["confidence"] >= 0.3)).alias("is_product"))
    return once(once(rejection, judged), with_class)


def about(html: Column | str) -> Column:
    """EXT-11: text of main, article or a content element if over 50 characters; its first 5000."""
    best = F.coalesce(*(F.nullif(visible_text(F.regexp_extract(column(html), p, 0)), F.lit("")) for p in (r"(?is)<main\b.*?</main>", r"(?is)<article\b.*?</article>", r"""(?is)<div[^>]*class=["'][^"']*content[^"']*["'].*?</div>""")), F.lit(""))
    return F.when(F.length(best) > 50, F.substring(best, 1, 5000))


def selector_robustness(selectors: Column | str) -> Column:
    """AGG-21: mean of what each CSS selector is worth."""
    worth = lambda s: F.when(F.contains(s, F.lit("nth-child")), 0.2).when(F.contains(s, F.lit("[")), 1.0).when(F.contains(s, F.lit(".")), 0.8).otherwise(0.5)
    return F.round(F.aggregate(F.transform(column(selectors), worth), F.lit(0.0), lambda a, x: a + x) / F.size(column(selectors)), 4)


# Weights of what a merchant profile has.
PROFILE_WEIGHTS = {"company_name": 0.25, "description": 0.10, "contact": 0.15, "social_links": 0.15, "analytics_tags": 0.10, "logo": 0.10, "address": 0.10, "about_text": 0.05, "services": 0.05}


def profile_confidence(present: dict[str, Column]) -> Column:
    """EXT-12."""
    return F.round(F.least(F.lit(1.0), sum((F.when(present[k], w).otherwise(0.0) for k, w in PROFILE_WEIGHTS.items() if k in present), F.lit(0.0))), 4)


#: Node types that stand for an organization.
ORGANIZATIONS = ("Organization", "LocalBusiness", "Store", "OnlineStore", "Corporation")


def organizations(pages: DataFrame, html: str, key: str) -> DataFrame:
    """EXT-07: of each page one organization node: within a script one with a name before others, then the last script's."""
    typed = json_ld(pages, html, key).where(node_type(F.col("node")).rlike("|".join(ORGANIZATIONS)))
    get = lambda p: F.nullif(F.try_variant_get("node", p, "string"), F.lit(""))
    rows = typed.select(key, "script", "place", "inner", get("$.name").alias("name"), get("$.description").alias("description"), F.coalesce(get("$.logo.url"), get("$.logo")).alias("logo"), get("$.address.addressCountry").alias("country"))
    best = F.max(F.struct(F.col("script"), F.col("name").isNotNull().alias("named"), (-F.col("place")).alias("place"), (-F.col("inner")).alias("inner"), "name", "description", "logo", "country")).alias("x")
    return rows.groupBy(key).agg(best).select(key, "x.name", "x.description", "x.logo", "x.country")


def keyword_score(url: Column | str, words: tuple[str, ...] = ("product", "shop", "item", "buy", "store", "p")) -> Column:
    """EXT-18: share of the words that a URL's path holds."""
    low = F.lower(urls.path(url))
    return F.round(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words), 4)
