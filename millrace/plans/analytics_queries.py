"""Job, request, evaluation and export operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import similarity, text
from millrace.operators import analytics, evals, export, ranges
from millrace.plans.catalog_queries import PRODUCTS, products
from millrace.session import table

AS_OF = "timestamp_ntz'2024-01-10 12:00:00'"


def endpoint_stats(s, d):
    """AGG-08, SORT-06."""
    return analytics.endpoint_stats(table(s, d, "events").select(F.col("event_type").alias("endpoint"), "value"), "endpoint", "value")


def request_stats(s, d):
    """AGG-07."""
    return analytics.request_stats(table(s, d, "events"), "value", F.col("event_type") == "error", "ts")


def requests_last_hour(s, d):
    """SRC-21."""
    return analytics.last_hours(table(s, d, "events"), "ts", F.expr(AS_OF)).select("event_id", "ts", "event_type", "value")


def jobs(s, d):
    """Orders as jobs: the tier is the priority, seconds and products follow from their lines."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("seconds"), F.count("*").alias("products"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
    return table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("job"), status.alias("status"), F.col("o_orderpriority").alias("tier"), F.date_format("o_orderdate", "yyyy").alias("platform"), "seconds", "products", F.col("o_orderdate").alias("started"))


JOBS = """(select o_orderkey as job, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' end as status, o_orderpriority as tier,
  strftime(o_orderdate, '%Y') as platform, seconds, products, o_orderdate as started
  from orders left join (select l_orderkey, sum(l_quantity) as seconds, count(*) as products from lineitem group by 1) on o_orderkey = l_orderkey)"""


def job_summary(s, d):
    """AGG-04, AGG-06, FLT-18."""
    return analytics.job_summary(jobs(s, d), "status", "products", "seconds")


def job_counts(s, d):
    """AGG-04."""
    return analytics.counts_by(jobs(s, d), "status", "platform", "tier")


def job_shares(s, d):
    """WIN-09, WIN-10."""
    return analytics.shares(analytics.counts_by(jobs(s, d), "tier"), "n")


def tier_performance(s, d):
    """AGG-05, SORT-05."""
    return analytics.tier_performance(jobs(s, d).where("status = 'completed'"), "tier", "seconds", "products")


def recent_jobs(s, d):
    """SORT-04, SORT-06, FLT-19."""
    return jobs(s, d).where("status = 'completed'").orderBy(F.desc_nulls_last("started"), "job").limit(10).select("job", "tier", "started")


def latest_progress(s, d):
    """STR-03 in batch form, SRC-20."""
    return analytics.latest(table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")


def running_progress(s, d):
    """WIN-05, WIN-06, SNK-12."""
    return analytics.progress(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "processed", "percentage")


def spend(s, d):
    """AGG-22, WIN-07: each user's spend against a limit."""
    log = table(s, d, "events").select("user_id", "event_id", F.round(F.col("value") / 100, 4).alias("cost"))
    return analytics.budget(log, "user_id", ["event_id"], "cost", 5.0).select("user_id", "event_id", "spent", "remaining", "warns", "exceeds")


def domain_concurrency(s, d):
    """STR-05: events as requests of a domain (their kind) that take as many minutes as their value says, some without an end, some ending as they begin: most at once, and how many began beyond five."""
    e = table(s, d, "events")
    end = F.when(F.col("event_id") % 50 != 0, F.col("ts") + F.make_dt_interval(mins=F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("int") + 1).otherwise(0)))
    return ranges.concurrent(e.select(F.col("event_type").alias("domain"), "ts", end.alias("done")), "domain", "ts", "done")


def props_json(s, d):
    """DQ-06, PRJ-22: a key of the JSON, null where it doesn't parse."""
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def pairs(s, d):
    """Suppliers and customers of one nation and rank, as expected and extracted records."""
    rank = lambda df, key, by: df.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    a = rank(table(s, d, "supplier"), "s_suppkey", "s_nationkey").select(F.col("s_nationkey").alias("site"), "pos", F.col("s_name").alias("e_name"), F.col("s_acctbal").alias("e_num"))
    b = rank(table(s, d, "customer"), "c_custkey", "c_nationkey").select(F.col("c_nationkey").alias("site"), "pos", F.col("c_name").alias("x_name"), F.col("c_acctbal").alias("x_num"))
    return a.join(b, ["site", "pos"], "left")


PAIRS = """(select a.site, a.pos, e_name, e_num, x_name, x_num from
  (select s_nationkey as site, row_number() over (partition by s_nationkey order by s_suppkey) as pos, s_name as e_name, s_acctbal as e_num from supplier) a left join
  (select c_nationkey as site, row_number() over (partition by c_nationkey order by c_custkey) as pos, c_name as x_name, c_acctbal as x_num from customer) b on a.site = b.site and a.pos = b.pos)"""


def token_scores(s, d):
    """DQ-08: word F1 of benchmark items against the documents of the same number."""
    b, x = table(s, d, "benchmark").select("item_id", F.col("text").alias("expected")), table(s, d, "documents").select("doc_id", F.col("text").alias("extracted"))
    return b.join(x, F.col("item_id") == F.col("doc_id"), "left").select("item_id", similarity.score("tokens", "expected", "extracted").alias("score"))


def field_scores(s, d):
    """DQ-08: numbers, URLs and truth values."""
    p = pairs(s, d)
    link = lambda c, scheme: F.concat(F.lit(scheme), F.regexp_replace(c, "[^0-9]", "").cast("bigint").cast("string"))
    return p.select("site", "pos", similarity.score("numeric", "e_num", F.col("x_num")).alias("number"), similarity.score("url", link("e_name", "https://x.test/"), link("x_name", "http://x.test/")).alias("url"), similarity.score("boolean", F.when(F.col("e_num") > 0, "yes").otherwise("no"), F.when(F.col("x_num") > 0, "In Stock").otherwise("none")).alias("flag"))


def tier_averages(s, d):
    """AGG-17, AGG-18, AGG-19: orders' lines as field scores; accuracy, completeness and overall by status and priority, then the best priority."""
    lines = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_returnflag").alias("site"), F.col("o_orderpriority").alias("tier"), (1 - F.col("l_discount") * 5).alias("score"))
    mean = evals.averages(lines, "site", "tier")
    scored = mean.withColumn("overall", evals.overall(F.col("avg_score"), evals.completeness(F.col("fields"), F.lit(3000))))
    return evals.with_best_tier(scored, "site", "tier", "overall")


def baseline_delta(s, d):
    """JOIN-17, WIN-08: mean discount of each flag and mode, one year against the next."""
    by_year = lambda y: table(s, d, "lineitem").where(F.year("l_shipdate") == y).groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.round(F.avg("l_discount"), 4).alias("score"))
    allowed = table(s, d, "lineitem").where("l_linenumber = 1").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
    return evals.regressions(by_year(1995), by_year(1996), ["l_returnflag", "l_linestatus", "l_linenumber"], 0.001, allowed)


def _score_rows(s, d):
    """Score logs as they are kept: for each run (a year) a map of site (order status) to a map of tier (priority) to scores."""
    rows = table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("timestamp"), F.col("o_orderstatus").alias("site"), F.col("o_orderpriority").alias("tier")).agg(F.round(F.avg(F.col("o_totalprice") / 500_000), 4).alias("overall_score"), F.count("*").alias("products_extracted"))
    tiers = rows.groupBy("timestamp", "site").agg(F.map_from_entries(F.collect_list(F.struct("tier", F.struct("overall_score", F.lit(None).cast("double").alias("avg_score"), "products_extracted")))).alias("tiers"))
    return tiers.groupBy("timestamp").agg(F.map_from_entries(F.collect_list(F.struct("site", "tiers"))).alias("scores"))


def score_history(s, d):
    """SRC-15, AGG-18: mean score of each run, and that of one site and of one tier, with the change from the run before."""
    log = evals.history(_score_rows(s, d))
    named = lambda df, what: df.select(F.lit(what).alias("what"), "*")
    return named(evals.run_averages(log), "all").unionByName(named(evals.run_averages(log, site="F"), "site")).unionByName(named(evals.run_averages(log, tier="1-URGENT"), "tier"))


def best_tiers(s, d):
    """AGG-19: how many sites (status and year) each tier is best of, and the mean of the best scores."""
    log = evals.history(_score_rows(s, d)).withColumn("site", F.concat_ws("/", "timestamp", "site"))
    return evals.best_of_sites(log, "site", "tier", "overall_score")


def fuzzy_match(s, d):
    """JOIN-15: a nation's suppliers matched in order with the names of all its customers."""
    a = table(s, d, "supplier").select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("title"))
    b = table(s, d, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("pos"), F.regexp_replace("c_name", "Customer", "Supplier").alias("title"))
    return evals.greedy_match(a, b, "site", 0.8)


def chunk_merge(s, d):
    """JOIN-16: products of one brand and size as chunks of a page."""
    p = table(s, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("page"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("kind"))
    return evals.merge_chunks(p, "page", ["kind"], 0.7)


def seeded_sample(s, d):
    """SORT-08: the same rows for the same seed (T14); limit is the feature."""
    return table(s, d, "documents").select("doc_id", "source").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(100)


def exported(s, d):
    p = products(s, d)
    return p.select(F.lit(None).cast("string").alias("external_id"), "sku", "vendor", "title", F.when(F.col("size") % 2 == 0, F.split("product_type", " ")).alias("category_path"), "product_type", F.concat(F.lit("https://x.test/p/"), F.col("id").cast("string")).alias("product_url"),
        F.when(F.col("id") % 3 == 0, F.lpad(F.col("id").cast("string"), 13, "0")).alias("gtin"), F.lit(None).cast("string").alias("mpn"), F.concat(F.lit("<p>"), F.col("title"), F.lit("</p>\n<b>x</b>")).alias("description"), F.lit("a.jpg").alias("image_url"), F.array(F.lit("b.jpg"), F.lit("")).alias("additional_images"), "price", F.lit("new").alias("condition"))


def feed_rows(s, d):
    """PRJ-18, FLT-17, FN-14, SNK-07."""
    return export.feed_rows(exported(s, d), text.brand_from_domain(F.lit("blue-shop.example.com")), "1-3 days", "4.90", "0.00")


def offers(s, d):
    """SNK-08: the offers' JSON, read back."""
    o = export.offers(feed_rows(s, d))
    return o.select("sku", F.get_json_object("offer", "$.price").alias("price"), F.get_json_object("offer", "$.brand").alias("brand"), F.get_json_object("offer", "$.eans").alias("eans"), F.size(F.json_object_keys("offer")).alias("keys"))


def export_readiness(s, d):
    """AGG-20, DQ-05."""
    return export.readiness(exported(s, d), "vendor")


_FEED = f"""select sku, coalesce(nullif(vendor, ''), 'Blue Shop') as brand, title, case when size % 2 = 0 and product_type <> '' then array_to_string(string_split(product_type, ' '), ' > ') else product_type end as categoryPath,
  'https://x.test/p/' || id as url, 'a.jpg;b.jpg' as imageUrls, case when id % 3 = 0 then lpad(id::varchar, 13, '0') else '' end as eans, '' as hans, printf('%.2f', price) as price, '4.90' as deliveryCosts, '1-3 days' as delivery, '0.00' as paymentCosts,
  regexp_replace(trim(title), '\\s+', ' ', 'g') || ' x' as description, 'NEW' as conditionType from {PRODUCTS} where sku <> '' and price <> 0 and title <> ''"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"
QUERIES = {
    "endpoint_stats": (endpoint_stats, "select event_type as endpoint, count(*) as n, round(avg(value), 4) as avg_latency, round(quantile_cont(value, 0.95), 4) as p95 from events group by 1 order by n desc, endpoint limit 10"),
    "request_stats": (request_stats, "select count(*) as n, round(100.0 * count(*) filter (where event_type = 'error') / count(*), 4) as error_rate, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, round(quantile_cont(value, 0.99), 4) as p99, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6), 4) as rpm from events"),
    "requests_last_hour": (requests_last_hour, "select event_id, ts, event_type, value from events where ts between timestamp '2024-01-10 11:00:00' and timestamp '2024-01-10 12:00:00'"),
    "job_summary": (job_summary, f"select count(*) as jobs, coalesce(sum(products), 0)::bigint as products, round(100.0 * count(*) filter (where status = 'completed') / count(*), 1) as success_rate, round(avg(seconds) filter (where status = 'completed' and seconds > 0), 1) as avg_seconds from {JOBS}"),
    "job_counts": (job_counts, f"select dimension, value, count(*) as n from (select 'status' as dimension, coalesce(status, 'unknown') as value from {JOBS} union all select 'platform', platform from {JOBS} union all select 'tier', tier from {JOBS}) where value is not null group by all"),
    "job_shares": (job_shares, f"select 'tier' as dimension, tier as value, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as share, round(count(*) / greatest(max(count(*)) over (), 1), 4) as of_max from {JOBS} where tier is not null group by tier"),
    "tier_performance": (tier_performance, f"select tier, count(*) as jobs, round(avg(seconds), 1) as avg_seconds, round(avg(products), 1) as avg_products, round(sum(products) / sum(seconds), 2) as pps from {JOBS} where status = 'completed' and seconds > 0 group by tier"),
    "recent_jobs": (recent_jobs, f"select job, tier, started from {JOBS} where status = 'completed' order by started desc nulls last, job limit 10"),
    "latest_progress": (latest_progress, "select user_id, ts, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1"),
    "running_progress": (running_progress, "select l_orderkey, l_linenumber, l_partkey, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity rows unbounded preceding) as processed, round(100.0 * sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity rows unbounded preceding) / sum(l_quantity) over (partition by l_orderkey), 2) as percentage from lineitem"),
    "spend": (spend, "select user_id, event_id, spent, greatest(0.0, round(5.0 - spent, 4))::double as remaining, spent >= 4.0 and before < 4.0 as warns, spent > 5.0 and before <= 5.0 as exceeds from (select *, round(spent - cost, 4) as before from (select user_id, event_id, cost, round(sum(cost) over (partition by user_id order by event_id rows unbounded preceding), 4) as spent from (select user_id, event_id, round(value / 100, 4) as cost from events)))"),
    "domain_concurrency": (domain_concurrency, """with r as (select event_type as domain, event_id, ts, case when event_id % 50 <> 0 then ts + to_minutes(case when event_id % 7 <> 0 then floor(value)::bigint + 1 else 0 end) end as done from events),
        m as (select domain, event_id, ts as t, 1 as move from r where done is null or done > ts union all select domain, event_id, done, -1 from r where done > ts),
        n as (select domain, move, sum(move) over (partition by domain order by t, move, event_id rows unbounded preceding) as now from m)
        select domain, (select count(*) from events where event_type = domain) as spans, max(now)::bigint as most_at_once, count(*) filter (where now > 5) as over_limit from n where move = 1 group by domain"""),
    "props_json": (props_json, "select try_cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1"),
    "token_scores": (token_scores, f"select item_id, case when expected is null then 1.0 when extracted is null then 0.0 when len(a) + len(b) = 0 then 1.0 else round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) end as score from (select item_id, b.text as expected, d.text as extracted, {_WORDS.format('b.text')} as a, {_WORDS.format('d.text')} as b from benchmark b left join documents d on item_id = doc_id)"),
    "field_scores": (field_scores, f"select site, pos, case when x_num is null then 0.0 when abs(abs(e_num) - abs(x_num)) <= 0.01 * greatest(abs(e_num), abs(x_num)) then 1.0 else 0.0 end as number, case when x_name is null then 0.0 when regexp_replace(e_name, '[^0-9]', '', 'g')::bigint = regexp_replace(x_name, '[^0-9]', '', 'g')::bigint then 0.9 else 0.0 end as url, case when (e_num > 0) = (coalesce(x_num, 0) > 0) then 1.0 else 0.0 end as flag from {PAIRS}"),
    "tier_averages": (tier_averages, "with m as (select l_returnflag as site, o_orderpriority as tier, round(avg(1 - l_discount * 5), 4) as avg_score, count(*) filter (where 1 - l_discount * 5 >= 0.8) as fields_matched, count(*) as fields from lineitem join orders on l_orderkey = o_orderkey group by 1, 2), o as (select *, round(0.6 * avg_score + 0.4 * least(1.0, fields / 3000), 4) as overall from m) select *, first_value(tier) over (partition by site order by overall desc, tier) as best_tier from o"),
    "baseline_delta": (baseline_delta, "with y as (select l_returnflag, l_linestatus, l_linenumber, year(l_shipdate) as y, round(avg(l_discount), 4) as score from lineitem group by all) select a.l_returnflag, a.l_linestatus, a.l_linenumber, a.score as before, b.score as after, round(b.score - a.score, 4) as delta, case when round(b.score - a.score, 4) < -0.001 and a.l_linenumber <> 1 then 'regression' when round(b.score - a.score, 4) > 0.001 then 'improvement' else 'same' end as kind from y a join y b on a.y = 1995 and b.y = 1996 and a.l_returnflag = b.l_returnflag and a.l_linestatus = b.l_linestatus and a.l_linenumber = b.l_linenumber"),
    "score_history": (score_history, """with l as (select strftime(o_orderdate, '%Y') as timestamp, o_orderstatus as site, o_orderpriority as tier, round(avg(o_totalprice / 500000), 4) as s from orders group by all),
        r as (select 'all' as what, * from l union all select 'site', * from l where site = 'F' union all select 'tier', * from l where tier = '1-URGENT'),
        m as (select what, timestamp, count(distinct site) as sites, avg(s) as mean from r group by all)
        select what, timestamp, sites, round(mean, 4) as mean, round(mean - lag(mean) over (partition by what order by timestamp), 4) as change from m"""),
    "best_tiers": (best_tiers, """with l as (select strftime(o_orderdate, '%Y') || '/' || o_orderstatus as site, o_orderpriority as tier, round(avg(o_totalprice / 500000), 4) as s from orders group by all),
        b as (select site, tier, s from (select *, row_number() over (partition by site order by s desc, tier) as r from l) where r = 1)
        select tier as best_tier, count(*) as sites, (select round(avg(s), 4) from b) as mean_best from b group by tier"""),
    "fuzzy_match": (fuzzy_match, None),
    "chunk_merge": (chunk_merge, None),
    "seeded_sample": (seeded_sample, None),
    "feed_rows": (feed_rows, _FEED),
    "offers": (offers, f"select sku, price, brand, nullif(eans, '') as eans, (7 + (eans <> '')::int + (categoryPath <> '')::int)::int as keys from ({_FEED})"),
    "export_readiness": (export_readiness, f"select vendor, count(*) as total, count(*) filter (where coalesce(vendor, '') = '') as missing_brand, count(*) filter (where id % 3 <> 0) as missing_gtin, count(*) filter (where coalesce(sku, '') = '') as missing_id, count(*) filter (where coalesce(vendor, '') <> '' and id % 3 = 0 and coalesce(sku, '') <> '') as ready from {PRODUCTS} group by vendor"),
}
