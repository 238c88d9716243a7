"""Rules on URLs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.presence import column, strip

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# Paths that are never products.
NON_PRODUCT_PATHS = (
    "/", "/about", "/about-us", "/contact", "/contact-us", "/blog", "/cart", "/checkout", "/account", "/login", "/register", "/search", "/faq", "/privacy",
    "/privacy-policy", "/terms", "/terms-of-service", "/terms-and-conditions", "/shipping", "/shipping-policy", "/returns", "/return-policy", "/refund-policy",
    "/sitemap", "/brands", "/categories", "/pages", "/wishlist", "/compare", "/basket", "/help", "/support", "/careers", "/press", "/newsletter", "/my-account",
    "/order-tracking", "/rewards",
)
# Path segments that no product has.
NON_PRODUCT_SEGMENTS = (
    "checkout", "basket", "cart", "login", "register", "account", "blog", "faq", "help", "support", "careers", "press", "my-account", "order-tracking", "wp-admin",
    "wp-includes", "feed", "author", "tag", "category", "wp-login.php", "newsletter", "unsubscribe", "journal", "news", "stories", "articles", "recipe", "recipes",
    "tea_collections", "product_collection", "our-story", "sustainability", "charity", "events", "product-category", "product-tag",
)
# Endings of files that are no pages.
NON_PRODUCT_ENDINGS = (
    ".xml", ".json", ".txt", ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".css", ".js", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".map", ".gz",
)
# Networks and what their links hold.
SOCIAL = {
    "facebook": ("facebook.com/", "fb.com/"),
    "instagram": ("instagram.com/",),
    "twitter": ("twitter.com/", "x.com/"),
    "linkedin": ("linkedin.com/company/", "linkedin.com/in/"),
    "tiktok": ("tiktok.com/@",),
    "youtube": ("youtube.com/", "youtu.be/"),
    "pinterest": ("pinterest.com/",),
}
BLOCKED_PORTS = (22, 25, 445, 3389, 5432, 27017)
PRIVATE_V4 = r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.)"


def part(c: Column | str, group: int) -> Column:
    return F.regexp_extract(column(c), URL, group)


def scheme(c: Column | str) -> Column:
    return F.lower(part(c, 1))


def host(c: Column | str) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(part(c, 2), r"^(?:[^@]*@)?([^:]*)", 1))


def port(c: Column | str) -> Column:
    return F.regexp_extract(part(c, 2), r":(\d+)$", 1).try_cast("int")


def path(c: Column | str) -> Column:
    return part(c, 3)


def normalized(c: Column | str) -> Column:
    """URL-01: scheme and host in lower case, default port, closing slashes and fragment gone; query kept."""
    default = F.when(scheme(c) == "http", ":80").when(scheme(c) == "https", ":443").otherwise("")
    place = F.lower(part(c, 2))
    bare = F.when((default != "") & place.endswith(default), F.regexp_replace(place, r":(80|443)$", "")).otherwise(place)
    return F.when(part(c, 1) != "", F.concat(scheme(c), F.lit("://"), bare, F.regexp_replace(path(c), "/+$", ""), F.coalesce(part(c, 4), F.lit("")))).otherwise(column(c))


def bare_domain(c: Column | str) -> Column:
    """URL-02 and URL-03: host without port and leading www., of a URL with or without scheme."""
    full = F.when(column(c).rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), column(c)).otherwise(F.concat(F.lit("https://"), column(c)))
    return F.regexp_replace(host(full), r"^www\.", "")


def path_key(c: Column | str) -> Column:
    """URL-04."""
    return F.regexp_replace(path(c), "/+$", "")


def handle(c: Column | str) -> Column:
    """URL-05: what follows the last /products/, in lower case."""
    behind = F.substring_index(F.split_part(column(c), F.lit("?"), F.lit(1)), "/products/", -1)
    return F.when(F.contains(column(c), F.lit("/products/")), F.lower(F.regexp_replace(behind, "^/+|/+$", "")))


def joined(base: Column | str, tail: Column | str) -> Column:
    """URL-06."""
    return F.concat(F.regexp_replace(column(base), "/+$", ""), F.lit("/"), F.regexp_replace(column(tail), "^/+", ""))


def is_non_product(c: Column | str) -> Column:
    """FLT-10: file ending, exact path, any segment, or a dated path."""
    p = F.lower(F.regexp_replace(path(c), "/+$", ""))
    ending = F.regexp_extract(p, r"(\.[^.]*)$", 1)
    segments = F.split(F.regexp_replace(p, "^/+", ""), "/")
    return ending.isin(*NON_PRODUCT_ENDINGS) | (p == "") | p.isin(*NON_PRODUCT_PATHS) | F.arrays_overlap(segments, F.array(*map(F.lit, NON_PRODUCT_SEGMENTS))) | p.rlike(r"/\d{4}/\d{2}/\d{2}/")


def is_safe(c: Column | str) -> Column:
    """FLT-12 and FLT-13 without name lookups: web scheme, a host, no blocked port, no private address or local name."""
    h = host(c)
    local = h.isin("localhost", "") | h.endswith(".local") | h.endswith(".internal") | h.rlike(PRIVATE_V4) | part(c, 2).rlike(r"^\[")
    odd = h.rlike(r"^[0-9.]+$") & ~h.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return scheme(c).isin("http", "https") & ~local & ~odd & ~F.coalesce(port(c).isin(*BLOCKED_PORTS), F.lit(False))


def social_network(c: Column | str) -> Column:
    """URL-07: the network of a link, else null."""
    low, out = F.lower(column(c)), None
    for name, marks in SOCIAL.items():
        hit = None
        for mark in marks:
            hit = F.contains(low, F.lit(mark)) if hit is None else hit | F.contains(low, F.lit(mark))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def next_page(c: Column | str) -> Column:
    """SRC-08: the address of rel="next" in a Link header."""
    parts = F.filter(F.split(column(c), ","), lambda x: F.contains(x, F.lit('rel="next"')))
    return F.nullif(F.regexp_extract(F.get(parts, F.lit(0)), "<([^>]*)>", 1), F.lit(""))


def shop_domain(c: Column | str, platform: str) -> Column:
    """FN-25: the bare domain of a shop, null where it isn't one that the platform allows."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(column(c))), "^https://", ""), "^http://", ""), "/+$", "")
    label = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    allowed = r"^[a-z0-9][a-z0-9-]*\.myshopify\.com$" if platform == "shopify" else rf"^{label}(?:\.{label})*\.[a-z]{{2,}}$"
    return F.when(name.rlike(allowed), name)
