"""Catalog tables: dedup, upsert, patches, deletion, retention, paging and counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.functions.presence import filled, strip
from millrace.operators import ranges
from millrace.session import fresh_dir


def _struct(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _orderable(df: DataFrame) -> list[Column]:
    """Columns that rows can be ordered by, to settle ties; those of or with maps or variants can't."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def last_by_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """WIN-01: of rows with one key the last in order, of equals the greatest by all columns that have an order. Partial results meet in the shuffle and no key is sorted."""
    row = F.max_by(_struct(df), F.struct(*order, *_orderable(df))).alias("row")
    return df.groupBy(*keys).agg(row).select("row.*")


def richest_by_key(df: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """WIN-02: the row with most fields that aren't empty; of equals the first in order."""
    n = sum((filled(c).cast("int") for c in fields), F.lit(0))
    return last_by_key(df, keys, [n.alias("_n"), (-F.col(order)).alias("_first")])


def upsert(target: DataFrame, staged: DataFrame, key: str | list[str], keep: list[str] = (), stamp: dict[str, Column] | None = None, order: list[str] = ()) -> DataFrame:
    """SNK-01 to SNK-04: rows of staged replace those of target with their key (of one or more columns); columns in keep stay as they were. stamp: values set where a row is replaced.

    Of staged rows with one key the last in order counts (by all columns that have an order, if none is given); rows without a key are added. sinks.buckets has tables that take upserts in place."""
    keys = [key] if isinstance(key, str) else list(key)
    known = F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    staged = last_by_key(staged.where(known), keys, list(order)).unionByName(staged.where(~known))
    t, s = target.withColumn("_there", F.lit(True)).alias("t"), staged.withColumn("_here", F.lit(True)).alias("s")
    there, here = F.col("_there").isNotNull(), F.col("_here").isNotNull()
    columns = []
    for c in target.columns:
        value = F.when(~here | (there if c in keep else F.lit(False)), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        if stamp and c in stamp:
            value = F.when(here & there, stamp[c]).otherwise(value)
        columns.append(value.alias(c))
    return t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer").select(*columns)


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """SET-05: distinct values that aren't null with where each comes first, and its place among them."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    return ranges.running(firsts.withColumn("_one", F.lit(1)), [], ["first", value], {"place": "_one"}).select(value, "first", "place")


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-05."""
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def patch(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """MUT-02, MUT-03, JOIN-18: columns take the change's value where it isn't null. Changes must have one row for each key."""
    c = changes.select(F.col(key).alias("_key"), *(F.col(x).alias(f"_{x}") for x in columns))
    joined = target.join(c, target[key] == c["_key"], "left")
    return joined.select(*(F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in target.columns))


def patch_report(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """JOIN-18: rows of changes, matched, not found, and invalid (no key)."""
    known = target.select(F.col(key).alias("_key")).distinct().withColumn("_there", F.lit(True))
    joined = changes.join(known, changes[key] == known["_key"], "left")
    return joined.agg(F.count("*").alias("total"), F.count_if("_there").alias("matched"), F.count_if(F.col(key).isNotNull() & F.col("_there").isNull()).alias("not_found"), F.count_if(F.col(key).isNull()).alias("invalid"))


def is_invalid(price: str, *others: str) -> Column:
    """FLT-04: no price and none of the others."""
    gone = F.col(price) == 0
    for c in others:
        gone &= F.col(c).isNull() | (F.col(c) == "")
    return gone


def keep_valid(df: DataFrame, invalid: Column) -> DataFrame:
    """MUT-01: what a deletion leaves. Rows for which the condition is unknown stay (T2)."""
    return df.where(~F.coalesce(invalid, F.lit(False)))


def is_expired(until: str, as_of: Column) -> Column:
    """FLT-06."""
    return F.col(until).isNotNull() & (F.col(until) < as_of)


def with_retention(df: DataFrame, until: str, created: str, days: int) -> DataFrame:
    """MUT-04: a date of expiry for rows that have none."""
    return df.withColumn(until, F.coalesce(until, F.col(created) + F.make_dt_interval(F.lit(days))))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """SORT-01, SORT-02: one of the first pages in a total order; end the order with a unique column (T7). Pages has deep ones."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(total: int, size: int) -> int:
    return math.ceil(total / size)


class Pages:
    """SORT-01, SORT-02: all pages of a table in a total order. Rows are written once in ranges of the order with a directory of how many each range holds, so that any page reads the one or two ranges that it lies in."""

    def __init__(self, df: DataFrame, *order: Column) -> None:
        self.spark, self.order, self.schema, self.path = df.sparkSession, order, df.schema, fresh_dir(df.sparkSession, "pages")
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(self.path)
        counts = self._all().groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row for each range
        self.ends, self.total = [], 0
        for r in counts:
            self.ends.append((r["_part"], self.total, self.total + r["n"]))
            self.total += r["n"]

    def _all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_part", IntegerType())])).parquet(self.path)

    def count(self, size: int) -> int:
        return pages(self.total, size)

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` from 1 on; one that isn't there is empty."""
        first, last = (number - 1) * size, min(number * size, self.total)
        held = [(p, low) for p, low, high in self.ends if low < last and high > first]
        if not held:
            return self._all().drop("_part").limit(0)
        return self._all().where(F.col("_part").isin([p for p, _ in held])).drop("_part").orderBy(*self.order).offset(first - held[0][1]).limit(last - first)


def exact_else_like(df: DataFrame, exact: Column, like: Column) -> DataFrame:
    """FLT-03: rows that match exactly, or where there are none those that match loosely."""
    flagged = df.where(exact | like).withColumn("_exact", exact)
    some = flagged.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_some"))
    return flagged.join(F.broadcast(some)).where(F.col("_exact") | ~F.col("_some")).drop("_exact", "_some")  # `some` is one row


def like(c: str, text: str) -> Column:
    """FLT-02: the text's own % and _ are wildcards too."""
    return F.col(c).like(f"%{text}%")


def coverage(df: DataFrame, present: dict[str, Column]) -> DataFrame:
    """AGG-02, AGG-03: rows, and for each field how many have it and the share in percent."""
    counted = df.agg(F.count("*").alias("total"), *(F.count_if(p).alias(f"n_{f}") for f, p in present.items()))
    share = lambda f: F.coalesce(F.round(F.try_divide(F.col(f"n_{f}"), F.col("total")) * 100, 1), F.lit(0.0))
    return counted.select("total", *(f"n_{f}" for f in present), *(share(f).alias(f"pct_{f}") for f in present))


def nest(parents: DataFrame, children: DataFrame, key: str, order: list[str], most: int, name: str) -> DataFrame:
    """JOIN-08: parents with the first `most` children by order as an array; parents without any have an empty one."""
    numbered = children.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most)
    own = [c for c in children.columns if c != key]
    packed = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", *own))).alias(name))
    dropped = F.transform(F.col(name), lambda x: F.struct(*(x[c].alias(c) for c in own)))
    return parents.join(packed.withColumn(name, dropped), key, "left").withColumn(name, F.coalesce(name, F.array()))


def two_stage_fill(df: DataFrame, lookup: DataFrame, first: tuple[str, str], second: tuple[str, str], fill: dict[str, str], wanted: Column) -> DataFrame:
    """JOIN-05, JOIN-06: where wanted, fills columns from lookup by the first pair of keys (own, lookup's), else the second.

    fill maps own columns to lookup columns. Of lookup rows with one key the last by `seq` counts. Rows are never multiplied.
    """
    out = df
    for n, (own, other) in enumerate((first, second)):
        one = lookup.where(F.col(other).isNotNull() & (F.col(other) != "")).groupBy(F.col(other).alias(f"_k{n}")).agg(F.max(F.struct("seq", *(F.col(c) for c in dict.fromkeys(fill.values())))).alias(f"_v{n}"))
        out = out.join(one, F.col(own) == F.col(f"_k{n}"), "left")
    for c, other in fill.items():
        out = out.withColumn(c, F.when(wanted, F.coalesce(F.col("_v0")[other], F.col("_v1")[other], F.col(c))).otherwise(F.col(c)))
    return out.drop("_k0", "_v0", "_k1", "_v1")


def title_key(c: str) -> Column:
    return F.lower(strip(c))


def recent(products: DataFrame, order: str, most: int = 5) -> DataFrame:
    """PRJ-19, SORT-07: the last few products with what stands for their title, price and image."""
    some = lambda *names: F.coalesce(*(F.when(filled(c), F.col(c).cast("string")) for c in names if c in products.columns), F.lit(None).cast("string"))
    return products.orderBy(F.desc(order)).limit(most).select(some("title", "sku", "external_id").alias("title"), some("price").alias("price"), some("image_url").alias("image"))


def affected(target: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """AGG-23: rows that an upsert adds and replaces; repeated keys count once."""
    keys, known = staged.where(F.col(key).isNotNull()).select(key).distinct(), target.select(F.col(key).alias("_key")).distinct().withColumn("_there", F.lit(True))
    joined = keys.join(known, keys[key] == known["_key"], "left")
    return joined.agg(F.count("*").alias("affected"), F.count_if("_there").alias("replaced"))


def with_columns_added(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """MUT-08: columns (name to type) that the table lacks are added as nulls; those it has stay as they are."""
    return df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in df.columns))


def needs_gtins(products: DataFrame, gtin: str, platform: str, *by: str) -> DataFrame:
    """AGG-15: whether identifiers must be fetched for a shop: always for woocommerce, else where under a tenth of the products have one."""
    share = F.count_if(filled(gtin)) / F.count("*")
    return products.groupBy(*by, platform).agg(((F.col(platform) == "woocommerce") | (share < 0.1)).alias("supplement"))
