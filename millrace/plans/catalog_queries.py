"""Catalog, quality and access operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.presence import filled, strip
from millrace.operators import access, catalog, quality, substrings
from millrace.session import fresh_dir, table
from millrace.sinks.buckets import BucketTable

AS_OF = "timestamp_ntz'1998-01-01 00:00:00'"


def products(s, d):
    """part as a catalog: one product a row, with gaps that follow from its own values."""
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).otherwise(0.0).alias("price"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("vendor"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_type")).otherwise("").alias("product_type"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("S"), F.col("p_partkey").cast("string"))).alias("sku"), F.col("p_size").alias("size"),
    )


PRODUCTS = """(select p_partkey as id, p_name as title, case when p_size % 7 <> 0 then p_retailprice else 0.0 end as price,
  case when p_size % 3 <> 0 then p_brand end as vendor, case when p_size % 5 <> 0 then p_type else '' end as product_type,
  case when p_partkey % 4 <> 0 then 'S' || p_partkey end as sku, p_size as size from part)"""


def catalog_page(s, d):
    """SORT-01, SORT-02: the third page of the priced first, dearest first."""
    return catalog.page(products(s, d), 3, 50, F.desc(F.col("price") > 0), F.desc("price"), F.col("id"))


def catalog_deep_pages(s, d):
    """SORT-01, SORT-02: the third page, the last and one beyond it, through the directory of ranges."""
    made = catalog.Pages(products(s, d), F.desc(F.col("price") > 0), F.desc("price"), F.col("id"))
    last = made.count(30)
    named = lambda n: made.page(n, 30).select(F.lit(n).alias("page"), "id", "title", "price")
    return named(3).union(named(last)).union(named(last + 1))


def catalog_counts(s, d):
    """AGG-01 by vendor."""
    return products(s, d).groupBy("vendor").agg(F.count("*").alias("n"), F.count_if(F.col("price") > 0).alias("priced"))


def exact_then_like(s, d):
    """FLT-02, FLT-03: no supplier has exactly this name, so the wildcard decides."""
    names = table(s, d, "supplier").select("s_suppkey", "s_name")
    return catalog.exact_else_like(names, F.col("s_name") == "Supplier#00000000", catalog.like("s_name", "0_1"))


def completeness_coverage(s, d):
    """AGG-02, AGG-03."""
    p = products(s, d)
    return catalog.coverage(p, {"title": filled("title"), "price": F.col("price") > 0, "vendor": filled("vendor"), "product_type": filled("product_type"), "sku": filled("sku")})


_FLAGS = {"title": "coalesce(trim(title), '') <> ''", "price": "price > 0", "vendor": "coalesce(trim(vendor), '') <> ''", "product_type": "coalesce(trim(product_type), '') <> ''", "sku": "coalesce(trim(sku), '') <> ''"}


def completeness_rows(s, d):
    """DQ-02, DQ-03."""
    p = products(s, d)
    score, gaps, again = quality.completeness({"title": filled("title"), "price": F.col("price") > 0}, {"vendor": filled("vendor"), "product_type": filled("product_type"), "sku": filled("sku")})
    mandatory, ready = quality.mandatory_score({"title": filled("title"), "price": F.col("price") > 0, "vendor": filled("vendor"), "sku": filled("sku")})
    return p.select("id", score.alias("score"), F.array_join(gaps, ",").alias("missing"), again.alias("reextract"), mandatory.alias("mandatory"), ready.alias("ready"))


def quality_scores(s, d):
    """DQ-01."""
    p = products(s, d)
    return p.select("id", quality.quality(filled("title"), {"price": F.col("price") > 0, "image": filled("vendor"), "description": filled("product_type"), "sku": filled("sku")}).alias("score"))


def quality_batches(s, d):
    """AGG-09, FLT-14, DQ-04: mean quality of documents by source, and the verdict."""
    docs = table(s, d, "documents").withColumn("score", quality.quality(F.length("text") > 0, {"price": F.col("text").rlike("[0-9]"), "image": F.col("n_chars") > 1000, "description": F.col("n_chars") > 200, "sku": F.contains("text", F.lit("\n"))}))
    return quality.batch_quality(docs, "score", "source").withColumn("verdict", quality.verdict(F.col("n"), F.col("quality"), 0.75))


def keep_valid_rows(s, d):
    """FLT-04, MUT-01, T2."""
    return catalog.keep_valid(products(s, d), catalog.is_invalid("price", "vendor", "product_type", "sku")).select("id", "price", "vendor", "sku")


def dedup_last(s, d):
    """WIN-01: each user's last event."""
    return catalog.last_by_key(table(s, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


def dedup_richest(s, d):
    """WIN-02: of products with one brand and size the one with most fields, then the first."""
    p = products(s, d).withColumn("key", F.md5(F.concat_ws(":", F.coalesce("vendor", F.lit("")), F.col("size").cast("string"))))
    return catalog.richest_by_key(p, ["key"], ["vendor", "product_type", "sku"], "id").select("key", "id", "vendor", "sku")


def idempotency_keys(s, d):
    """FN-11."""
    p = products(s, d)
    return p.select("id", text.idempotency_key(F.coalesce(F.when(F.col("size") % 2 == 0, F.col("id")).cast("string"), F.lit("")), F.lit("generic"), F.col("vendor"), F.col("sku"), F.col("title")).alias("key"))


def _orders(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created"), F.lit(0).alias("version"))


def upsert_merge(s, d):
    """SNK-01: a table of the orders of even customers; every third order arrives, every ninth twice (the last counts), some without a key; created stays as it was, version is stamped. The batch comes twice and counts once."""
    o = table(s, d, "orders")
    shape = lambda df, v: df.select(F.col("o_orderkey").alias("key"), F.lit(v).alias("status"), F.round(F.col("o_totalprice") * (2 if v == "new" else 1), 2).alias("price"), F.when(F.lit(v == "old"), F.col("o_orderdate")).otherwise(F.expr("timestamp_ntz'2000-01-01'")).alias("created"), F.lit(0).alias("version"))
    new = shape(o.where("o_orderkey % 3 = 0"), "new")
    staged = new.withColumn("seq", F.lit(0)).union(new.where("key % 9 = 0").withColumn("status", F.lit("last")).withColumn("seq", F.lit(1))).union(new.where("key % 30 = 0").withColumn("key", F.lit(None).cast("bigint")).withColumn("seq", F.lit(2)))
    old = shape(o.where("o_custkey % 2 = 0"), "old")
    made = BucketTable(s, fresh_dir(s, "orders"), ["key"], old.schema, buckets=16)
    made.upsert(old, source="orders", batch=0)
    for _ in range(2):
        made.upsert(staged, keep=["created"], stamp={"version": F.lit(1)}, order=["seq"], source="orders", batch=1)
    return made.rows()


def connection_upserts(s, d):
    """SNK-02 to SNK-04: connections by platform and domain in a table: a second batch replaces token and settings (a map) and makes the status active again, created stays; then those of one platform go (MUT-01)."""
    o = table(s, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("platform"), F.concat(F.lit("d"), (F.col("o_custkey") % 40).cast("string")).alias("domain"), F.col("o_orderkey").alias("token"), F.create_map(F.lit("status"), "o_orderstatus").alias("settings"), F.when(F.col("o_orderkey") % 2 == 0, "revoked").otherwise("active").alias("status"), F.col("o_orderdate").alias("created"))
    made = BucketTable(s, fresh_dir(s, "connections"), ["platform", "domain"], rows.schema, buckets=16)
    made.upsert(rows.where("token % 2 = 0"), order=["token"])
    made.upsert(rows.where("token % 2 = 1 and token % 5 = 0"), keep=["created"], order=["token"])
    made.delete(F.col("platform") == "5-LOW")
    return made.rows().withColumn("settings", F.col("settings")["status"])


def insert_if_absent(s, d):
    """SNK-05."""
    o = _orders(s, d).select("key", "status")
    return catalog.insert_if_absent(o.where("key % 2 = 0"), o.where("key % 3 = 0").withColumn("status", F.lit("late")), ["key"])


def patch_update(s, d):
    """MUT-02, MUT-03."""
    o = _orders(s, d).select("key", "status", "price")
    changes = o.where("key % 5 = 0").select("key", F.when(F.col("key") % 2 == 0, "patched").alias("status"), F.lit(None).cast("double").alias("price"))
    return catalog.patch(o, changes, "key", ["status", "price"])


def patch_counts(s, d):
    """JOIN-18."""
    o = _orders(s, d)
    changes = o.select(F.when(F.col("key") % 7 != 0, F.col("key") * F.when(F.col("key") % 3 == 0, -1).otherwise(1)).alias("key"))
    return catalog.patch_report(o, changes, "key")


def retention(s, d):
    """FLT-06, MUT-04: orders get 700 days; what is past by then."""
    o = _orders(s, d).withColumn("until", F.when(F.col("key") % 2 == 0, F.col("created") + F.make_dt_interval(F.lit(100))))
    return catalog.with_retention(o, "until", "created", 700).select("key", "until", catalog.is_expired("until", F.expr(AS_OF)).alias("expired"))


def nested_children(s, d):
    """JOIN-08: at most 3 lines of each order, in order."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))
    nested = catalog.nest(_orders(s, d).select("key"), lines, "key", ["n", "part"], 3, "lines")
    return nested.select("key", F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["part"].cast("string")), ",").alias("parts"))


def two_stage_fill(s, d):
    """JOIN-05, JOIN-06: vendor by sku, else by title, from a lookup made of the catalog itself."""
    p = products(s, d)
    lookup = table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S"), F.col("p_partkey").cast("string"))).alias("sku2"), F.lower("p_name").alias("title2"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("seq"))
    return catalog.two_stage_fill(p.withColumn("title_key", catalog.title_key("title")), lookup, ("sku", "sku2"), ("title_key", "title2"), {"vendor": "brand"}, ~filled("vendor")).select("id", "vendor")


def brand_lookup(s, d):
    """JOIN-07: nation names of customers; missing ones are empty."""
    n = table(s, d, "nation").where("n_nationkey % 4 <> 0")
    return table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"))


def outcome_audit(s, d):
    """AGG-10, AGG-13: events as outcomes of fetches, by day."""
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "empty").when(F.col("event_type") == "click", "incomplete").otherwise("skipped").alias("outcome"), F.floor("value").cast("bigint").alias("products"), F.col("user_id").cast("string").alias("url"))
    audit = quality.outcome_audit(e, "outcome", "products", "url", "day", most=3)
    return audit.withColumn("failed", F.array_join("failed", ",")).withColumn("incomplete_urls", F.array_join("incomplete_urls", ",")).withColumn("abort", quality.too_many_errors(F.col("attempted"), F.col("error") + F.col("skipped") + F.col("empty")))


def reconciliation(s, d):
    """AGG-12, AGG-14: orders discovered, tried (not P) and done (F) by priority."""
    g = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("discovered"), F.count_if(F.col("o_orderstatus") != "P").alias("attempted"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    return quality.reconciliation(g, F.col("discovered"), F.col("attempted"), F.col("ok"))


def reextraction_plan(s, d):
    """AGG-11."""
    return quality.reextraction_plan(products(s, d), "title", {"price": ~(F.col("price") > 0), "vendor": ~filled("vendor"), "sku": ~filled("sku")})


def role_grid(s, d):
    """JOIN-03, FLT-09: regions as roles, nations as permissions."""
    roles = table(s, d, "region").select(F.col("r_name").alias("role"))
    codes = table(s, d, "nation").select(F.col("n_name").alias("code"), "n_regionkey")
    names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    rules = {names[0]: F.lit(True), names[1]: ~F.col("code").isin("BRAZIL", "CANADA"), names[2]: F.col("code").isin("CHINA", "INDIA", "JAPAN"), names[3]: F.col("n_regionkey") == 3}
    return access.grants_by_role(roles, codes, rules)


def distinct_permissions(s, d):
    """JOIN-01: customers as members, nations as roles, regions as permissions."""
    members = table(s, d, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("role_id"))
    members = members.union(members.select("member", ((F.col("role_id") + 1) % 25).alias("role_id")))
    grants = table(s, d, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_regionkey").alias("permission_id"))
    return access.permissions_of(members, grants, table(s, d, "region").select(F.col("r_regionkey").alias("permission_id"), F.col("r_name").alias("code")))


def usable_keys(s, d):
    """JOIN-02, FLT-07: orders as keys of customers' accounts."""
    keys = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("account"), (F.col("o_orderstatus") == "F").alias("revoked"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("expires"))
    accounts = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("account"), "c_mktsegment")
    return access.usable_keys(keys, accounts, "account", F.expr("timestamp_ntz'1996-01-01'")).select("key", "account", "c_mktsegment")


def lockouts(s, d):
    """MUT-05, FLT-20."""
    df = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 6).cast("int").alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("locked"), "o_orderstatus")
    return access.after_failure(df, "attempts", "locked", F.col("o_orderstatus") == "F", F.expr(AS_OF)).select("key", "attempts", "locked")


def stale_jobs(s, d):
    """MUT-07: events as running jobs."""
    df = table(s, d, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("completed").alias("status"), "ts")
    return access.stale_failed(df, "status", "ts", F.expr("timestamp_ntz'2024-01-15 00:00:00'"))


def scope_sets(s, d):
    """FLT-21, SET-03, SET-04: scopes asked for against those owned and known, by the brand's digits."""
    p = table(s, d, "part")
    digit = lambda n: F.when(F.substring(F.regexp_replace("p_brand", "[^0-9]", ""), n, 1) == "", "0").otherwise(F.substring(F.regexp_replace("p_brand", "[^0-9]", ""), n, 1))
    asked = F.array_distinct(F.array(digit(1), digit(2)))
    x = access.scopes(asked, F.array(*map(F.lit, "123")), F.array(*map(F.lit, "1234")))
    return p.select("p_partkey", *(F.array_join(x[k], ",").alias(k) for k in ("unknown", "excess", "granted")))


def set_operations(s, d):
    """SET-01 to SET-05: users who viewed, bought, either, both, and viewed without buying."""
    e = table(s, d, "events")
    who = lambda t: e.where(F.col("event_type") == t).select("user_id")
    views, buys = who("view"), who("purchase")
    named = lambda df, n: df.select(F.lit(n).alias("what"), "user_id")
    return named(views.union(buys).distinct(), "either").union(named(views.intersect(buys), "both")).union(named(views.subtract(buys), "no_purchase"))


def email_hashes(s, d):
    """FN-12."""
    return table(s, d, "customer").select("c_custkey", text.email_hash(F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.COM "))).alias("hash"))


def urls_all_missing(s, d):
    """JOIN-11: brands of which no product has a price."""
    p = products(s, d).withColumn("url", F.concat(F.coalesce("vendor", F.lit("none")), F.lit("/"), F.col("size").cast("string")))
    all_gone = p.groupBy("url").agg(F.bool_and(~(F.col("price") > 0)).alias("gone")).where("gone").select("url")
    return p.join(all_gone, "url", "left_semi").select("url", "id")


def erased(s, d):
    """JOIN-22: rows left of four tables when a segment's shops go: orders and customers by shop, events as progress of a shop in odd spellings and as dead letters that name one."""
    shop = lambda key, before="https://shop": F.concat(F.lit(before), F.col(key).cast("string"), F.lit(".test"))
    c, e = table(s, d, "customer"), table(s, d, "events")
    gone = c.where("c_mktsegment = 'BUILDING'").select(shop("c_custkey").alias("shop_id"))
    progress = e.select(F.concat(shop("user_id", "HTTPS://Shop"), F.when(F.col("event_id") % 2 == 0, ":443/").otherwise("")).alias("shop_url"))
    letters = e.select(F.concat(F.lit('{"job": '), F.col("event_id").cast("string"), F.lit(', "url": "'), shop("user_id"), F.when(F.col("event_id") % 2 == 0, "/p").otherwise(""), F.lit('"}')).alias("body"))
    left = substrings.erase_shops(gone, table(s, d, "orders").select(shop("o_custkey").alias("shop_id")), c.select(shop("c_custkey").alias("shop_id")), progress, letters)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def token_rotation(s, d):
    """MUT-09: orders as refresh tokens of a customer's family; every eighth is used, every fortieth twice; some uses come when the token has expired."""
    o = table(s, d, "orders")
    t = o.select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("family"), (F.col("o_orderstatus") == "P").alias("revoked"), F.col("o_orderdate").alias("expires"))
    used = t.where("token % 8 = 1").select("token", (F.col("expires") + F.make_dt_interval(F.when(F.col("token") % 3 == 0, 1).otherwise(-1))).alias("at"))
    return access.rotate(t, used.union(used.where("token % 5 = 0")))


QUERIES = {
    "catalog_page": (catalog_page, f"select * from {PRODUCTS} order by price > 0 desc, price desc, id limit 50 offset 100"),
    "catalog_deep_pages": (catalog_deep_pages, f"select page, id, title, price from (select *, ((row_number() over (order by price > 0 desc, price desc, id) - 1) // 30 + 1)::int as page, ((count(*) over () + 29) // 30)::int as n from {PRODUCTS}) where page in (3, n)"),
    "catalog_counts": (catalog_counts, f"select vendor, count(*) as n, count(*) filter (where price > 0) as priced from {PRODUCTS} group by vendor"),
    "exact_then_like": (exact_then_like, "select s_suppkey, s_name from supplier where s_name = 'Supplier#00000000' or (s_name like '%0_1%' and not exists (select 1 from supplier where s_name = 'Supplier#00000000'))"),
    "completeness_coverage": (completeness_coverage, "select count(*) as total, " + ", ".join(f"count(*) filter (where {c}) as n_{f}, coalesce(round(count(*) filter (where {c}) / count(*) * 100, 1), 0.0) as pct_{f}" for f, c in _FLAGS.items()) + f" from {PRODUCTS}"),
    "completeness_rows": (completeness_rows, "select id, greatest(0.0, least(1.0, round(1 - 0.3 * (not t::bool)::int - 0.3 * (not p)::int - 0.1 * ((not v)::int + (not y)::int + (not k)::int), 4)))::double as score, array_to_string(list_sort(list_filter([case when not t then 'title' end, case when not p then 'price' end, case when not v then 'vendor' end, case when not y then 'product_type' end, case when not k then 'sku' end], lambda x: x is not null)), ',') as missing, not t or not p as reextract, round((t::int + p::int + v::int + k::int) / 4.0, 2)::double as mandatory, t and p and v and k as ready from (select id, " + ", ".join(f"{c} as {a}" for a, c in zip("tpvyk", _FLAGS.values(), strict=True)) + f" from {PRODUCTS})"),
    "quality_scores": (quality_scores, f"select id, case when {_FLAGS['title']} then round(0.4 + 0.15 * (({_FLAGS['price']})::int + ({_FLAGS['vendor']})::int + ({_FLAGS['product_type']})::int + ({_FLAGS['sku']})::int), 4)::double else 0.0 end as score from {PRODUCTS}"),
    "quality_batches": (quality_batches, "select source, n, quality, case when n = 0 then 'zero_products' when quality < 0.75 then 'low_quality' else 'passed' end as verdict from (select source, count(*) as n, round(coalesce(avg(case when length(text) > 0 then 0.4 + 0.15 * (regexp_matches(text, '[0-9]')::int + (n_chars > 1000)::int + (n_chars > 200)::int + contains(text, chr(10))::int) else 0 end), 0), 4)::double as quality from documents group by source)"),
    "keep_valid_rows": (keep_valid_rows, f"select id, price, vendor, sku from {PRODUCTS} where not coalesce(price = 0 and (vendor is null or vendor = '') and (product_type is null or product_type = '') and (sku is null or sku = ''), false)"),
    "dedup_last": (dedup_last, "select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1"),
    "dedup_richest": (dedup_richest, f"select key, id, vendor, sku from (select *, row_number() over (partition by key order by (coalesce(vendor, '') <> '')::int + (coalesce(product_type, '') <> '')::int + (coalesce(sku, '') <> '')::int desc, id) as r from (select *, md5(coalesce(vendor, '') || ':' || size) as key from {PRODUCTS})) where r = 1"),
    "idempotency_keys": (idempotency_keys, f"select id, sha256(e || '|generic|' || coalesce(vendor, '') || '|' || coalesce(sku, '') || case when e = '' and coalesce(sku, '') = '' then '|' || title else '' end) as key from (select *, case when size % 2 = 0 then id::varchar else '' end as e from {PRODUCTS})"),
    "upsert_merge": (upsert_merge, "with t as (select o_orderkey as key, 'old' as status, round(o_totalprice, 2) as price, o_orderdate as created, 0 as version from orders where o_custkey % 2 = 0), s as (select o_orderkey as key, case when o_orderkey % 9 = 0 then 'last' else 'new' end as status, round(o_totalprice * 2, 2) as price, timestamp '2000-01-01' as created, 0 as version from orders where o_orderkey % 3 = 0 union all select null, 'new', round(o_totalprice * 2, 2), timestamp '2000-01-01', 0 from orders where o_orderkey % 30 = 0) select coalesce(t.key, s.key) as key, coalesce(s.status, t.status) as status, coalesce(s.price, t.price) as price, coalesce(t.created, s.created) as created, case when t.key is not null and s.key is not null then 1 else 0 end as version from t full join s on t.key = s.key"),
    "connection_upserts": (connection_upserts, """with r as (select o_orderpriority as platform, 'd' || o_custkey % 40 as domain, o_orderkey as token, o_orderstatus as settings, case when o_orderkey % 2 = 0 then 'revoked' else 'active' end as status, o_orderdate as created from orders),
        a as (select platform, domain, max(token) as token, arg_max(settings, token) as settings, 'revoked' as status, arg_max(created, token) as created from r where token % 2 = 0 group by all),
        b as (select platform, domain, max(token) as token, arg_max(settings, token) as settings, 'active' as status, arg_max(created, token) as created from r where token % 2 = 1 and token % 5 = 0 group by all)
        select platform, domain, coalesce(b.token, a.token) as token, coalesce(b.settings, a.settings) as settings, coalesce(b.status, a.status) as status, coalesce(a.created, b.created) as created from a full join b using (platform, domain) where platform <> '5-LOW'"""),
    "insert_if_absent": (insert_if_absent, "select o_orderkey as key, case when o_orderkey % 2 = 0 then o_orderstatus else 'late' end as status from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0"),
    "patch_update": (patch_update, "select o_orderkey as key, case when o_orderkey % 10 = 0 then 'patched' else o_orderstatus end as status, o_totalprice as price from orders"),
    "patch_counts": (patch_counts, "select count(*) as total, count(*) filter (where o_orderkey % 7 <> 0 and o_orderkey % 3 <> 0) as matched, count(*) filter (where o_orderkey % 7 <> 0 and o_orderkey % 3 = 0) as not_found, count(*) filter (where o_orderkey % 7 = 0) as invalid from orders"),
    "retention": (retention, "select key, until, until < timestamp '1998-01-01' as expired from (select o_orderkey as key, case when o_orderkey % 2 = 0 then o_orderdate + interval 100 day else o_orderdate + interval 700 day end as until from orders)"),
    "nested_children": (nested_children, "select o_orderkey as key, coalesce(n, 0)::int as n, coalesce(parts, '') as parts from orders left join (select l_orderkey, count(*) as n, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) as parts from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as r from lineitem) where r <= 3 group by 1) on o_orderkey = l_orderkey"),
    "two_stage_fill": (two_stage_fill, f"select p.id, case when coalesce(trim(p.vendor), '') <> '' then p.vendor else coalesce(a.brand, b.brand, p.vendor) end as vendor from {PRODUCTS} p left join (select 'S' || p_partkey as k, p_brand as brand from part where p_partkey % 2 = 0) a on p.sku = a.k left join (select lower(p_name) as k, max_by(p_brand, p_partkey) as brand from part group by 1) b on lower(trim(p.title)) = b.k"),
    "brand_lookup": (brand_lookup, "select c_custkey, coalesce(n_name, '') as nation from customer left join (select * from nation where n_nationkey % 4 <> 0) on c_nationkey = n_nationkey"),
    "outcome_audit": (outcome_audit, "select day, attempted, success, error, empty, incomplete, skipped, products, success_rate, failed, incomplete_urls, attempted > 3 and (error + skipped + empty) / attempted > 0.7 as abort from (select strftime(ts, '%Y-%m-%d') as day, count(*) as attempted, count(*) filter (where event_type = 'purchase') as success, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'view') as empty, count(*) filter (where event_type = 'click') as incomplete, count(*) filter (where event_type not in ('purchase', 'error', 'view', 'click')) as skipped, coalesce(sum(floor(value)::bigint) filter (where event_type = 'purchase'), 0)::bigint as products, round(100.0 * count(*) filter (where event_type = 'purchase') / count(*), 2) as success_rate, coalesce(array_to_string(list_sort(list_distinct(list(user_id::varchar) filter (where event_type = 'error')))[1:3], ','), '') as failed, coalesce(array_to_string(list_sort(list_distinct(list(user_id::varchar) filter (where event_type = 'click')))[1:3], ','), '') as incomplete_urls from events group by 1)"),
    "reconciliation": (reconciliation, "select o_orderpriority, discovered, attempted, ok, coalesce(round(100.0 * ok / nullif(discovered, 0), 2), 0.0) as coverage_pct, coalesce(round(100.0 * ok / nullif(attempted, 0), 2), 0.0) as success_pct, discovered - ok as gap from (select o_orderpriority, count(*) as discovered, count(*) filter (where o_orderstatus <> 'P') as attempted, count(*) filter (where o_orderstatus = 'F') as ok from orders group by 1)"),
    "reextraction_plan": (reextraction_plan, f"select count(distinct title) filter (where not price > 0) as urls_price, count(distinct title) filter (where coalesce(trim(vendor), '') = '') as urls_vendor, count(distinct title) filter (where coalesce(trim(sku), '') = '') as urls_sku, count(*) filter (where not price > 0 or coalesce(trim(vendor), '') = '' or coalesce(trim(sku), '') = '') as incomplete, round(1 - count(*) filter (where not price > 0 or coalesce(trim(vendor), '') = '' or coalesce(trim(sku), '') = '') / count(*), 4) as complete_rate from {PRODUCTS}"),
    "role_grid": (role_grid, "select r_name as role, n_name as code from region, nation where r_name = 'AFRICA' or (r_name = 'AMERICA' and n_name not in ('BRAZIL', 'CANADA')) or (r_name = 'ASIA' and n_name in ('CHINA', 'INDIA', 'JAPAN')) or (r_name = 'EUROPE' and n_regionkey = 3)"),
    "distinct_permissions": (distinct_permissions, "select distinct c_custkey as member, r_name as code from (select c_custkey, c_nationkey as k from customer union all select c_custkey, (c_nationkey + 1) % 25 from customer) join nation on k = n_nationkey join region on n_regionkey = r_regionkey"),
    "usable_keys": (usable_keys, "select o_orderkey as key, o_custkey as account, c_mktsegment from orders join customer on o_custkey = c_custkey where c_acctbal > 0 and o_orderstatus <> 'F' and (o_orderkey % 3 = 0 or o_orderdate > timestamp '1996-01-01')"),
    "lockouts": (lockouts, "select o_orderkey as key, (o_orderkey % 6 + (o_orderstatus = 'F')::int)::int as attempts, case when o_orderstatus = 'F' and o_orderkey % 6 + 1 >= 5 then timestamp '1998-01-01 00:15:00' end as locked from orders"),
    "stale_jobs": (stale_jobs, "select event_id, case when event_type = 'view' then case when ts < timestamp '2024-01-14 23:30:00' then 'failed' else 'running' end else 'completed' end as status, ts from events"),
    "scope_sets": (scope_sets, "select p_partkey, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(['1','2','3','4'], x))), ',') as unknown, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(['1','2','3'], x))), ',') as excess, array_to_string(list_sort(list_filter(a, lambda x: list_contains(['1','2','3'], x))), ',') as granted from (select p_partkey, list_distinct([case when substr(g, 1, 1) = '' then '0' else substr(g, 1, 1) end, case when substr(g, 2, 1) = '' then '0' else substr(g, 2, 1) end]) as a from (select p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') as g from part))"),
    "set_operations": (set_operations, "with v as (select distinct user_id from events where event_type = 'view'), b as (select distinct user_id from events where event_type = 'purchase') select 'either' as what, user_id from (select * from v union select * from b) union all select 'both', user_id from v where user_id in (from b) union all select 'no_purchase', user_id from v where user_id not in (from b)"),
    "email_hashes": (email_hashes, "select c_custkey, sha256(lower(trim(' ' || c_name || '@Example.COM '))) as hash from customer"),
    "urls_all_missing": (urls_all_missing, f"with p as (select *, coalesce(vendor, 'none') || '/' || size as url from {PRODUCTS}) select url, id from p where url in (select url from p group by url having bool_and(not price > 0))"),
    "erased": (erased, "with g as (select c_custkey as k from customer where c_mktsegment = 'BUILDING') select 'products' as what, count(*) as n from orders where o_custkey not in (from g) union all select 'profiles', count(*) from customer where c_custkey not in (from g) union all select unnest(['progress', 'letters']), count(*) from events where user_id not in (from g)"),
    "token_rotation": (token_rotation, """with t as (select o_orderkey as token, o_custkey as family, o_orderstatus = 'P' as revoked, o_orderdate as expires, o_orderkey % 8 = 1 as used, o_orderkey % 3 <> 0 as in_force, o_orderkey % 5 = 0 as twice from orders),
        b as (select distinct family from t where used and (revoked or in_force and twice))
        select token, family, revoked or (used and in_force) or family in (select family from b) as revoked, expires from t"""),
}
