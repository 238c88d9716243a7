"""Rules on rows that they refuse, and small operators that no other query runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import presence, urls
from millrace.operators import access, analytics, catalog, evals, export, extract, normalize
from millrace.plans import ingestion
from millrace.session import fresh_dir, table
from millrace.sinks.buckets import BucketTable
from millrace.sources import feeds


def one_of(values, n):
    """The value of a list that a number stands for."""
    return F.element_at(F.array(*(F.lit(v) if not hasattr(v, "alias") else v for v in values)), (n % len(values) + 1).cast("int"))


_PLACES = ("https://shop.test/p", "http://127.0.0.1/x", "https://10.1.2.3/", "ftp://shop.test/", "https://localhost/x", "https://a.internal/", "HTTPS://Shop.test:8443/", "https://8.8.8.8/", "https://[::1]/", "https://999.1.1.1/", "nonsense", "http://172.16.0.1/", "http://192.168.1.1:80/", "https://printer.local/")
_SAFE = (1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0)


def unsafe_urls(s, d):
    """FLT-12, FLT-13: addresses of private networks, local names, other schemes and broken ones."""
    p = table(s, d, "pages").select("page_id", one_of(_PLACES, F.col("page_id")).alias("url"))
    return p.select("page_id", urls.is_safe("url").alias("safe"))


def active_sessions(s, d):
    """FLT-08, MUT-06, SORT-03: sessions in force once an account's are revoked, newest first."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("account"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderstatus") == "P").otherwise(False).alias("revoked"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("expires"), F.col("o_orderdate").alias("created"))
    now = access.revoke(o, F.when(F.col("account") % 7 != 0, F.col("account") % 5 == 0))
    return now.where(access.active("revoked", "expires", F.expr("timestamp_ntz'1998-01-01'"))).orderBy(F.desc("created"), "session").select("session", "account")


def gap_fills(s, d):
    """JOIN-10, JOIN-13, FLT-23: blank columns filled from what was fetched again; rows from an API take images alone."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), one_of((F.col("p_name"), F.lit(" "), F.lit(None).cast("string")), F.col("p_partkey")).alias("title"), F.when(F.col("p_partkey") % 2 == 0, "i.jpg").alias("image_url"), (F.col("p_partkey") % 5 == 0).alias("api"))
    again = table(s, d, "part").where("p_partkey % 4 < 3").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("title"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("image_url"))
    return ingestion.gaps_filled(p, again, "id", ["title", "image_url"], F.col("api")).drop("api")


def selector_scores(s, d):
    """AGG-21: mean worth of the selectors of a schema; none has no mean."""
    n = F.col("page_id")
    chosen = F.filter(F.array(F.when(n % 2 == 0, "[data-x]"), F.when(n % 3 == 0, ".price > b"), F.when(n % 5 == 0, "li:nth-child(2)"), F.when(n % 7 == 0, "h1")), lambda x: x.isNotNull())
    return table(s, d, "pages").select("page_id", F.when(F.size(chosen) > 0, extract.selector_robustness(chosen)).alias("score"))


def newest_products(s, d):
    """PRJ-19, SORT-07: the last five products with what stands for their title; five is the feature."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("at"), one_of((F.col("p_name"), F.lit(""), F.lit(None).cast("string")), F.col("p_partkey")).alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S"), F.col("p_partkey").cast("string"))).alias("sku"), F.col("p_partkey").alias("external_id"), F.col("p_retailprice").alias("price"))
    return catalog.recent(p, "at").select("title", "price", F.col("image").isNull().alias("no_image"))


def uploaded_rows(s, d):
    """SRC-18: an upload written as CSV with odd heads, quotes and blanks is read back and matched by sku."""
    k = F.col("p_partkey")
    rows = table(s, d, "part").select(F.when(k % 4 > 0, F.concat(F.lit(" s"), k.cast("string"), F.lit(" "))).alias(" SKU "), k.cast("string").alias("External_ID"), F.concat("p_name", F.lit(', "big"')).alias("Brand"), F.when(k % 3 == 0, k.cast("string")).alias("mpn"))
    path = fresh_dir(s, "upload")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return feeds.upload(s, path).select("match_key", F.col("external_id").cast("bigint").alias("id"), F.length("brand").alias("n"), "mpn")


def audit_log(s, d):
    """SNK-06, SNK-10: lines of an audit log appended batch by batch, one of which comes twice; runs added to a history, and a baseline that each run replaces."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    log = BucketTable(s, fresh_dir(s, "audit"), (), e.schema)
    for batch in (0, 1, 1):
        log.append(e.where(F.col("event_id") % 2 == batch), "log", batch)
    runs, base = fresh_dir(s, "runs"), fresh_dir(s, "baseline")
    for kind in ("view", "click"):
        scores = e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
        export.save_run(scores, runs)
        export.save_baseline(scores, base)
    told = lambda df, what, n: df.agg(F.count("*").alias("rows"), F.sum(n).alias("total")).select(F.lit(what).alias("what"), "rows", "total")
    read = lambda path: s.read.schema("user_id bigint, n bigint").json(path)
    return told(log.rows(), "log", "event_id").union(told(read(runs), "runs", "n")).union(told(read(base), "baseline", "n"))


def extra_identifiers(s, d):
    """FN-09, FN-06: identifiers among additional properties: names in any case, the last of a name counts, what isn't one is dropped."""
    k = F.col("p_partkey")
    code = F.lpad(k.cast("string"), 13, "4")
    prop = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    more = one_of((F.array(prop("EAN", F.lit("4006381333931")), prop("ean", code)), F.array(prop("Gtin13", code), prop("color", F.lit("red"))), F.array(prop("isbn", F.lit("12")), prop("MPN", F.lit("m"))), F.array().cast("array<struct<name: string, value: string>>")), k)
    node = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), more.alias("additionalProperty"), F.struct(F.lit("5").alias("price")).alias("offers"))
    rows = table(s, d, "part").select(k.alias("k"), F.lit("s").alias("shop_id"), F.lit("generic").alias("platform"), F.lit("https://x.test").alias("shop_url"), F.parse_json(F.to_json(node)).alias("raw"))
    return normalize.normalize(rows, "k").select("k", "gtin", "sku", "external_id")


_PRICES = ("5", "0", "0.00", " ", None, "x", " 7.5 ", "-1", "00")


def price_presence(s, d):
    """FN-23, FN-24, T15: zero for completeness and usable for extraction are two notions."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), one_of(_PRICES, F.col("p_partkey")).alias("price"))
    return p.select("k", presence.price_is_zero("price").alias("zero"), presence.usable_price("price").alias("usable"))


def offer_prices(s, d):
    """PRJ-15, PRJ-16: price of an offer, of a list of them and of an aggregate, and of none."""
    k, price = F.col("p_partkey"), F.format_string("%.2f", "p_retailprice")
    shapes = ('{"price":"%s"}', '[{"price":"%s"},{"price":"1"}]', '{"lowPrice":"%s"}', '{"offers":[{"price":"%s"}]}', '{"price":""}', "[]")
    return table(s, d, "part").select(k.alias("k"), evals.offer_price(F.parse_json(F.replace(one_of(shapes, k), F.lit("%s"), price))).alias("price"))


def urls_in_order(s, d):
    """SET-05: distinct addresses by where they come first."""
    e = table(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 97).cast("string")).alias("url"), "event_id")
    return catalog.first_seen(e, "url", "event_id")


def crawl_totals(s, d):
    """AGG-06: seconds of all jobs and products a second, of jobs that took any time; by year, and of a year without any."""
    jobs = table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy").alias("year"), F.when(F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01'"), F.col("o_orderkey") % 100).otherwise(0).alias("seconds"), (F.col("o_custkey") % 9).alias("products"))
    return analytics.crawl_totals(jobs, "seconds", "products", "year")


_TEXTS = ("[1,2]", "not json", "5", '"q"', None, '{"a":', "true", '{"a":{"b":1}}', "12 x", "")


def row_documents(s, d):
    """PRJ-22, DQ-06: events as JSON documents: amounts are numbers, times ISO text, texts that hold JSON are what they hold, others stay text; read back by path."""
    e = table(s, d, "events").select("event_id", "ts", F.col("value").cast("decimal(12,2)").alias("value"), F.col("props").alias("raw_data"), one_of(_TEXTS, F.col("event_id")).alias("tags"))
    doc = export.row_documents(e)
    at = lambda p: F.get_json_object("json", p)
    return doc.select("event_id", at("$.ts").alias("ts"), at("$.value").cast("double").alias("value"), at("$.raw_data.k").cast("int").alias("k"), at("$.tags").alias("tags"), F.contains("json", F.lit('"tags":null')).alias("no_tags"))


def _list(values):
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


QUERIES = {
    "row_documents": (row_documents, f"""select event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') as ts, value::decimal(12,2)::double as value, try_cast(json_extract_string(props, '$.k') as int) as k, case t when '"q"' then 'q' else t end as tags, t is null as no_tags
        from (select *, ({_list(_TEXTS)})[event_id % {len(_TEXTS)} + 1] as t from events)"""),
    "unsafe_urls": (unsafe_urls, f"select page_id, ({list(_SAFE)})[page_id % {len(_SAFE)} + 1] = 1 as safe from pages"),
    "active_sessions": (active_sessions, "select o_orderkey as session, o_custkey as account from orders where not (case when o_orderkey % 17 <> 0 then o_orderstatus = 'P' else false end) and not (o_custkey % 7 <> 0 and o_custkey % 5 = 0) and o_orderdate + interval 30 day > timestamp '1998-01-01'"),
    "gap_fills": (gap_fills, "select id, case when t then title when not api and again then lower(kind) else title end as title, coalesce(image_url, case when again then 'n' || id end) as image_url from (select p_partkey as id, case p_partkey % 3 when 0 then p_name when 1 then ' ' end as title, p_partkey % 3 = 0 as t, p_type as kind, case when p_partkey % 2 = 0 then 'i.jpg' end as image_url, p_partkey % 5 = 0 as api, p_partkey % 4 < 3 as again from part)"),
    "selector_scores": (selector_scores, "select page_id, round(list_avg(list_filter([case when page_id % 2 = 0 then 1.0 end, case when page_id % 3 = 0 then 0.8 end, case when page_id % 5 = 0 then 0.2 end, case when page_id % 7 = 0 then 0.5 end], lambda x: x is not null)), 4)::double as score from pages"),
    "newest_products": (newest_products, "select case when p_partkey % 3 = 0 then p_name when p_partkey % 2 = 0 then 'S' || p_partkey else p_partkey::varchar end as title, p_retailprice::varchar as price, true as no_image from part order by p_partkey desc limit 5"),
    "uploaded_rows": (uploaded_rows, "select case when p_partkey % 4 > 0 then 's' || p_partkey end as match_key, p_partkey as id, (length(p_name) + 7)::int as n, case when p_partkey % 3 = 0 then p_partkey::varchar end as mpn from part"),
    "audit_log": (audit_log, "with v as (select user_id, event_type, count(*) as n from events where event_type in ('view', 'click') group by all) select 'log' as what, count(*) as rows, sum(event_id)::bigint as total from events union all select 'runs', count(*), sum(n)::bigint from v union all select 'baseline', count(*), sum(n)::bigint from v where event_type = 'click'"),
    "extra_identifiers": (extra_identifiers, "select p_partkey as k, case when p_partkey % 4 < 2 then lpad(p_partkey::varchar, 13, '4') end as gtin, case when p_partkey % 4 = 2 then 'm' end as sku, case when p_partkey % 4 < 2 then lpad(p_partkey::varchar, 13, '4') else '' end as external_id from part"),
    "price_presence": (price_presence, f"select p_partkey as k, p is null or trim(p) = '' or p in ('0', '0.00', 'x', '00') as zero, case when trim(p) not in ('', '0') then trim(p) end as usable from (select p_partkey, ({_list(_PRICES)})[p_partkey % {len(_PRICES)} + 1] as p from part)"),
    "offer_prices": (offer_prices, "select p_partkey as k, case when p_partkey % 6 < 4 then printf('%.2f', p_retailprice) end as price from part"),
    "urls_in_order": (urls_in_order, "select url, min(event_id) as first, row_number() over (order by min(event_id)) as place from (select 'u' || user_id % 97 as url, event_id from events) group by url"),
    "crawl_totals": (crawl_totals, "select year, sum(seconds)::bigint as seconds, coalesce(round(sum(products) / nullif(sum(seconds), 0), 4), 0.0) as products_a_second from (select strftime(o_orderdate, '%Y') as year, case when o_orderdate < timestamp '1996-01-01' then o_orderkey % 100 else 0 end as seconds, o_custkey % 9 as products from orders) where seconds > 0 group by year union all select distinct strftime(o_orderdate, '%Y'), 0::bigint, 0.0 from orders where strftime(o_orderdate, '%Y') not in (select strftime(o_orderdate, '%Y') from orders where o_orderdate < timestamp '1996-01-01' and o_orderkey % 100 > 0)"),
}
