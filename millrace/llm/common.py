"""Shared folders, keys and connected components for the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import fresh_dir


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, which gives the memory that it has freed back to the system at its end: Python workers live on, and the next stage's memory comes on top of what they keep."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once in the shared folder and read back: cuts lineage and outlives executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing later reads."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hidden(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones renamed, so that no name clashes with those an operator makes; and what restores names, order and columns."""
    names = {c: c if c in used else f"kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def crc32_mod(column: str, divisor: int) -> F.Column:
    """crc32 of the column's text form modulo divisor; null counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % divisor


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of edges.

    edges: src, dst of one orderable type, in any direction; loops and repeats do no harm.
    Returns node, component; nodes without an edge aren't listed. Alternates large-star
    and small-star steps, whose groups are reduced by partial minima and joined back by
    key, so a node of any degree is never gathered in one place. Each round is
    stored in the shared folder; rounds grow with the logarithm of the largest component.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first())

    pairs = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct(), "components")
    before = mark(pairs)
    while before[0]:
        new = stored(star(star(pairs, True), False), "components")
        discard(pairs)
        pairs, now = new, mark(new)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
