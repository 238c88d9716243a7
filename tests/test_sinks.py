"""The table of buckets: repeats, repeated keys, null keys, other writers, maps and variants, and what stays untouched; and what ingestion keeps of repeated keys."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import analytics, catalog
from millrace.plans import ingestion
from millrace.sinks.buckets import BucketTable

SHAPE = "k bigint, shop string, price double, m map<string,string>, n int"


@pytest.fixture
def made(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as k", "concat('s', id % 3) as shop", "1.0d as price", "map('a', string(id)) as m", "0 as n")
    table = BucketTable(spark, f"file://{tmp_path}/t", ["k", "shop"], rows.schema, buckets=16)
    assert table.rows().count() == 0
    assert table.upsert(rows, source="b", batch=3) == {"affected": 40, "replaced": 0, "added": 0}
    return table


def rows_of(table):
    return sorted((str(r.k), str(r.shop), r.price, tuple(sorted(r.m.items())) if r.m else None, r.n) for r in table.rows().collect())


def test_upserts_in_place(spark, made):
    before, files = rows_of(made), set(made.rows().inputFiles())
    staged = spark.createDataFrame([(1, "s1", 2.0, {"b": "x"}, 5), (1, "s1", 3.0, {"c": "y"}, 5), (1, "s2", 9.0, None, 5), (None, "s1", 7.0, None, 5), (None, "s1", 7.0, None, 5)], SHAPE)
    assert made.upsert(staged, keep=["price"], stamp={"n": F.lit(77)}, source="b", batch=4) == {"affected": 4, "replaced": 1, "added": 2}
    want = sorted([r for r in before if r[0] != "1"] + [("1", "s1", 1.0, (("c", "y"),), 77), ("1", "s2", 9.0, None, 5), ("None", "s1", 7.0, None, 5), ("None", "s1", 7.0, None, 5)])
    assert rows_of(made) == want  # the last of a key by position
    assert len(files & set(made.rows().inputFiles())) >= len(files) - 2  # no other bucket was written
    version = made.version
    assert made.upsert(staged, source="b", batch=4)["affected"] == made.upsert(staged, source="b", batch=2)["affected"] == 0  # repeats
    assert (rows_of(made), made.version) == (want, version)
    assert made.upsert(staged.where("k = 1 and price = 2"), source="other", batch=0)["affected"] == 1  # numbers count within their source
    old = made.version
    assert made.vacuum() > 0 and made.version == old and len(rows_of(made)) == len(want)
    assert made.upsert(staged.limit(0), source="b", batch=9)["affected"] == 0 and made.upsert(staged, source="b", batch=9)["affected"] == 0  # empty batches count too


def test_order_columns_and_newest(spark, made):
    late = spark.createDataFrame([(2, "s2", 5.0, 1), (2, "s2", 4.0, 9), (2, "s2", 0.5, 3)], "k bigint, shop string, price double, seq int")
    made.upsert(late, order=["seq"])  # a column that the table lacks; columns that the batch lacks are null
    assert [r for r in rows_of(made) if r[0] == "2"] == [("2", "s2", 4.0, None, None)]
    for price, want in ((3.0, 4.0), (4.0, 4.0), (6.0, 6.0)):
        made.upsert(late.limit(1).withColumn("price", F.lit(price)), order=["price"], newest=True)
        assert [r[2] for r in rows_of(made) if r[0] == "2"] == [want]


def test_deletes_and_appends(spark, made, tmp_path):
    more = spark.createDataFrame([(None, "x", 1.0, None, None), (1, "s1", 8.0, None, None)], SHAPE)
    assert made.append(more, "log", 0) and not made.append(more, "log", 0) and made.rows().count() == 42
    files = set(made.rows().inputFiles())
    assert made.delete(F.col("k") > 37) == 2 and made.rows().count() == 40  # null keys stay: unknown
    assert len(files & set(made.rows().inputFiles())) >= len(files) - 2
    assert made.delete(F.col("shop") == "x") == 1 and made.delete(F.col("shop") == "x") == 0 and made.delete(F.lit(True)) == 39 and made.rows().count() == 0
    plain = BucketTable(spark, f"file://{tmp_path}/plain", (), more.schema)
    plain.append(more)
    assert plain.rows().count() == 2 and BucketTable(spark, f"file://{tmp_path}/plain").rows().count() == 2
    with pytest.raises(ValueError):
        plain.upsert(more)
    with pytest.raises(ValueError):
        BucketTable(spark, f"file://{tmp_path}/none")


def test_two_writers(spark, made):
    """A writer whose version was taken meanwhile merges again with what the other wrote; the loser of a race can't overwrite a commit."""
    version, state = made._read()
    assert made._commit(version, state) and not made._commit(version, state)
    other, first = BucketTable(spark, made.path), []
    commit = made._commit

    def raced(version, state):
        if not first:
            first.append(other.upsert(spark.createDataFrame([(3, "s0", 50.0, None, 1)], SHAPE)))
        return commit(version, state)

    made._commit = raced
    made.upsert(spark.createDataFrame([(3, "s0", 60.0, None, 2), (100, "s0", 60.0, None, 2)], SHAPE), keep=["price"])
    assert [r[2:] for r in rows_of(made) if r[0] == "3"] == [(50.0, None, 2)] and first[0]["replaced"] == 1 and made.rows().count() == 41


def test_a_key_with_most_rows_and_variants(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("if(id % 3 > 0, 7, id) as k", "parse_json(concat('{\"n\":', id, '}')) as v", "map(id, 'x') as m")
    table = BucketTable(spark, f"file://{tmp_path}/v", ["k"], rows.schema, buckets=4)
    assert table.upsert(rows, order=[])["affected"] == 10_001
    last = table.rows().where("k = 7").selectExpr("variant_get(v, '$.n', 'int') as n", "map_keys(m)[0] as m").collect()
    assert [tuple(r) for r in last] == [(29_999, 29_999)]


def test_dedup_with_maps_and_variants(spark):
    """Columns that have no order don't take part in ties."""
    rows = spark.sql("select k, o, map(coalesce(o, 0), 'x') as m, parse_json('[1]') as v, w from values (1, 1, 'a'), (1, 2, 'b'), (1, 2, 'c'), (2, null, 'd') as x(k, o, w)")
    assert {(r.k, r.w) for r in catalog.last_by_key(rows, ["k"], ["o"]).collect()} == {(1, "c"), (2, "d")}
    assert {(r.k, r.w) for r in catalog.richest_by_key(rows, ["k"], ["w"], "o").collect()} == {(1, "a"), (2, "d")}
    assert {(r.k, r.w) for r in analytics.latest(rows, "k", "o").collect()} == {(1, "c"), (2, "d")}
    merged = catalog.upsert(rows.where("w in ('a', 'd')"), rows.where("w = 'c'").withColumn("k", F.lit(2)), ["k"])
    assert {(r.k, r.w, tuple(r.m)) for r in merged.collect()} == {(1, "a", (1,)), (2, "c", (2,))}


def test_ingestion_keeps_the_last(spark, tmp_path):
    """Of a feed the last record of a key counts, of a page the richest, and of bodies the last; records with nothing to be told by are refused."""
    feed = "id\ttitle\tprice\tdescription\n7\tFirst\t1.00 EUR\tlong\n7\tLast\t2.00 EUR\t\n8\tOnly\t\t\n\tNothing\t\t\n"
    ld = lambda *nodes: "".join(f'<script type="application/ld+json">{{"@type":"Product",{n}}}</script>' for n in nodes)
    page = ld('"name":"P","sku":"9","image":"i","offers":{"price":"3"}', '"name":"P","sku":"9"')
    shape = "seq int, body string, content_type string"
    bodies = spark.createDataFrame([(2, feed, "text/csv"), (1, feed.replace("Last", "Older"), "text/csv"), (3, page, "text/html"), (0, page.replace("3", "5"), "text/html")], shape)
    bodies = bodies.select("*", F.lit("s").alias("shop_id"), F.lit("generic").alias("platform"), F.lit("https://s/").alias("shop_url"), F.lit("u").alias("url"))
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = ingestion.accepted(ingestion.raw_records(bodies), as_of)
    assert {(r.title, float(r.price)) for r in got.collect()} == {("Last", 2.0), ("Only", 0.0), ("P", 3.0)}
    table = BucketTable(spark, f"file://{tmp_path}/c", ["idempotency_key"], got.schema, buckets=4)
    assert ingestion.into(table, got, "x", 0)["affected"] == 3 and ingestion.into(table, got, "x", 0)["affected"] == 0
