"""Prices in texts. Two comma rules exist and differ on purpose (T20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.presence import column, strip

# Currency codes that may stand beside an amount.
ISO_CODES = (
    "USD", "EUR", "GBP", "JPY", "CAD", "AUD", "NZD", "CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "INR", "KRW", "BRL", "RUB", "HKD", "SGD", "MXN", "ZAR", "TRY",
    "THB", "MYR", "PHP", "IDR", "TWD", "AED", "SAR", "CNY", "VND", "BGN", "RON", "HRK", "ILS", "CLP", "COP", "PEN", "ARS", "UAH", "KZT", "QAR", "KWD", "BHD", "OMR",
    "JOD", "EGP", "NGN", "KES",
)
# Symbols and the code that each stands for.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₽": "RUB", "R$": "BRL", "kr": "SEK", "zł": "PLN", "CHF": "CHF", "A$": "AUD", "C$": "CAD", "NZ$": "NZD", "HK$": "HKD", "S$": "SGD"}
# Words of lines that hold no product price.
NOISE = r"(?i)\b(?:shipping|subtotal|total|tax|discount|coupon|cart|was\s+\$|original|compare|regular|list\s+price|you\s+save|msrp|rrp|from\s+\$|starting\s+at|add\s+to|rug\s+pad|protection\s+plan|warranty|accessory|free\s+shipping|estimated|per\s+month|/month|installment)\b"
# How an amount in a text is written; which price counts as the first depends on it.
AMOUNT = r"\d{1,3}(?:[,.\s]\d{3})*(?:[.,]\d{1,2})?|\d+[.,]\d{1,2}"


def feed_price(c: Column | str) -> Column:
    """FN-01: struct(amount, currency) of '1,299.99 USD', '49,99 EUR' or a bare number; both are text, null if absent."""
    words = F.split(strip(c), r"\s+")
    last = F.element_at(words, -1)
    coded = (F.size(words) > 1) & last.rlike("^[A-Za-z]{3}$")
    raw = F.when(coded, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(strip(c))
    both = F.contains(raw, F.lit(",")) & F.contains(raw, F.lit("."))
    amount = F.when(both, F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    return F.struct(F.nullif(amount, F.lit("")).alias("amount"), F.when(coded, F.upper(last)).alias("currency"))


def loose_price(c: Column | str) -> Column:
    """FN-02: number in a text with a currency sign; a comma beside a point is dropped, a comma alone is a point; else 0."""
    raw = strip(F.translate(column(c).cast("string"), "$€£", ""))
    both = F.contains(raw, F.lit(",")) & F.contains(raw, F.lit("."))
    return F.coalesce(F.when(both, F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit("."))).try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))


def listed_amount(c: Column | str) -> Column:
    """FN-03: amount as '%.2f'. A comma with two digits at the end is a decimal comma; other commas part thousands. Null if not over 0 or over a million."""
    raw = F.replace(column(c), F.lit(" "), F.lit(""))
    decimal_comma = raw.rlike(r",\d{2}$")
    plain = F.when(decimal_comma, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    value = plain.try_cast("double")
    return F.when((value > 0) & (value <= 1_000_000), F.format_string("%.2f", value))


def text_price(c: Column | str) -> Column:
    """FN-04: struct(amount, currency) of the first credible price of a text: a known code before an amount, else an amount with its sign in a line without noise words."""
    c = column(c)
    coded = F.transform(F.regexp_extract_all(c, F.lit(rf"[A-Z]{{3}}\s+(?:{AMOUNT})"), F.lit(0)), lambda m: F.struct(listed_amount(F.regexp_replace(m, r"^[A-Z]{3}\s+", "")).alias("amount"), F.substring(m, 1, 3).alias("currency")))
    coded = F.filter(coded, lambda m: m["currency"].isin(*ISO_CODES) & m["amount"].isNotNull())
    # Signs, and what stands before and behind an amount.
    signs = r"[€£¥₹₩₽]|R\$|A\$|C\$|NZ\$|HK\$|S\$|\$|kr|zł|CHF"
    pattern = rf"(?:(?:{signs})\s*)?(?:{AMOUNT})(?:\s*(?:[€£¥₹₩₽]|kr|zł))?(?:\s+[A-Z]{{3}})?"
    lines = F.filter(F.split(c, "\n"), lambda line: ~line.rlike(NOISE))
    found = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(pattern), F.lit(0))))
    code = lambda m: F.regexp_extract(m, r"\s([A-Z]{3})$", 1)
    sign = lambda m: F.regexp_extract(m, rf"({signs})", 1)
    named = F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))
    priced = F.transform(found, lambda m: F.struct(listed_amount(F.regexp_extract(m, rf"({AMOUNT})", 1)).alias("amount"), F.when(code(m).isin(*ISO_CODES), code(m)).otherwise(F.try_element_at(named, sign(m))).alias("currency")))
    return F.coalesce(F.get(coded, F.lit(0)), F.get(F.filter(priced, lambda m: m["amount"].isNotNull()), F.lit(0)))


def two_places(c: Column | str) -> Column:
    """Whether an unrounded number has at most two decimal places (T3): others are rejected, not rounded."""
    c = column(c)
    return c == F.round(c, 2)
