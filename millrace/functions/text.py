"""Identifiers, markup and small text rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.presence import column, strip


def valid_gtin(c: Column | str) -> Column:
    """FN-06: digits of a GTIN of 8, 13 or 14 places, one of 12 filled up to 13; null for anything else. No check digit (T5)."""
    digits = F.regexp_replace(F.replace(strip(column(c).cast("string")), F.lit("-"), F.lit("")), " ", "")
    padded = F.when(F.length(digits) == 12, F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.when(digits.rlike("^[0-9]+$") & ~digits.rlike("^0+$") & F.length(padded).isin(8, 13, 14), padded)


def idempotency_key(external_id: Column, platform: Column, shop: Column, sku: Column, title: Column) -> Column:
    """FN-11: sha256 of the identifying fields; the title joins them when both ids are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    base = F.concat_ws("|", text(external_id), text(platform), text(shop), text(sku))
    return F.sha2(F.when((text(external_id) == "") & (text(sku) == ""), F.concat_ws("|", base, text(title))).otherwise(base), 256)


def email_hash(c: Column | str) -> Column:
    """FN-12."""
    return F.sha2(F.lower(strip(c)), 256)


def feed_text(c: Column | str) -> Column:
    """FN-14: markup becomes blanks, white space one blank."""
    return strip(F.regexp_replace(F.regexp_replace(column(c), "<[^>]+>", " "), r"\s+", " "))


# Tags that a sanitized description may keep.
KEPT_TAGS = ("p", "br", "strong", "em", "a", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "span", "div")


#: A whole tag, whose quoted values may hold angle brackets.
TAG = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""


def link_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a whole link tag, without its quotes; null if the tag hasn't got it."""
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = F.regexp_extract(tag, rf"""(?is)^<a(?:\s+[^\s=>"'/]+(?:\s*=\s*{value.replace("(", "(?:", 1)})?)*?\s+{name}\s*=\s*{value}""", 1)
    return F.nullif(F.regexp_replace(raw, """^["']|["']$""", ""), F.lit(""))


def safe_target(href: Column) -> Column:
    """http, https, mailto and relative addresses; an entity or blank can't hide another scheme."""
    bare = F.lower(F.regexp_replace(href, r"[\x00-\x20]", ""))
    return bare.rlike("^(?:https?:|mailto:)") | bare.rlike("^[^:&]*(?:[/?#]|$)")


def clean_piece(piece: Column) -> Column:
    """A piece of markup: text stays, a kept tag is built anew from its name and kept attributes, other tags go, and a bracket that opens no tag is escaped."""
    name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9]*)(?=[\s/>])", 1))
    is_tag = piece.rlike(r"(?s)^<[A-Za-z/!?].*>$")
    href, title = link_attribute(piece, "href"), link_attribute(piece, "title")
    written = lambda n, v: F.coalesce(F.concat(F.lit(f' {n}="'), F.replace(v, F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))
    own = F.when(name == "a", F.concat(written("href", F.when(safe_target(href), href)), written("title", title))).otherwise("")
    opened = F.concat(F.lit("<"), name, own, F.when(piece.endswith("/>"), "/").otherwise(""), F.lit(">"))
    kept = F.when(piece.startswith("</"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(opened)
    return F.when(~piece.startswith("<"), piece).when(~is_tag, F.concat(F.lit("&lt;"), F.substring(piece, 2, 1 << 30))).when(name.isin(*KEPT_TAGS), kept).otherwise("")


def sanitized(c: Column | str) -> Column:
    """FN-15: scripts and styles go with their content, closed or not; tags off the list go, their text stays; attributes go but for a link's href and title."""
    c = F.regexp_replace(column(c), r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(rf"(?s){TAG}|<|[^<]+"), F.lit(0)), clean_piece), "")


def founding_year(c: Column | str) -> Column:
    """FN-16: the first year from 1900 to 2099 in a text."""
    return F.regexp_extract(column(c), r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def brand_from_domain(c: Column | str) -> Column:
    """FN-17."""
    return F.initcap(F.replace(F.split_part(column(c), F.lit("."), F.lit(1)), F.lit("-"), F.lit(" ")))


def safe_name(c: Column | str) -> Column:
    """FN-18: for file names."""
    return F.regexp_replace(column(c), r"[^a-zA-Z0-9.\-]", "_")


# What counts as an address and as a phone number.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9})|(?:\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4})"


def emails(c: Column | str) -> Column:
    """FN-19: distinct lower-case addresses in order, without names of assets."""
    found = F.when(F.contains(column(c), F.lit("@")), F.regexp_extract_all(column(c), F.lit(EMAIL), F.lit(0))).otherwise(F.array())
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda m: ~m.rlike(r"\.(png|jpg|gif|css|js)$")), F.lower)))


def phones(c: Column | str) -> Column:
    """FN-19: distinct numbers of 7 to 15 digits, in order."""
    found = F.transform(F.regexp_extract_all(column(c), F.lit(PHONE), F.lit(0)), lambda m: strip(m))
    return F.array_sort(F.array_distinct(F.filter(found, lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(7, 15))))


def markdown_title(c: Column | str) -> Column:
    """FN-05: the first heading of level 1 or 2, else bold text, of 3 to 300 characters."""
    each = (F.trim(F.regexp_extract(column(c), p, 1)) for p in (r"(?m)^#\s+(.+)$", r"(?m)^##\s+(.+)$", r"\*\*(.+?)\*\*"))
    return F.coalesce(*(F.when(F.length(t).between(3, 300), t) for t in each))


def truth(c: Column | str) -> Column:
    """FN-21."""
    return F.lower(strip(column(c).cast("string"))).isin("true", "1", "yes", "in_stock", "instock", "available", "in stock")


def schema_condition(c: Column | str) -> Column:
    """FN-10: of a schema.org item condition."""
    c = column(c)
    has = lambda x: F.contains(c, F.lit(x))
    return F.when(has("NewCondition"), "NEW").when(has("RefurbishedCondition"), "REFURBISHED").when(has("UsedCondition") | has("DamagedCondition"), "USED")
