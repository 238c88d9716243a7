"""Embedding whitening with MLlib's block matrices (operator 12).

Entries become whole numbers x = floor(scale * c) + shift, so that sums are exact. Distinct x vectors are the fit list: numbered through,
centred and laid out as a BlockMatrix B, whose product B'B is the scatter. The driver turns its small square matrix (vectors' length squared) into
eigenvectors, and B times the whitening matrix projects all distinct vectors, from where rows take their values by their x vector.

Vectors that are null, empty, or hold null or non-finite entries give no rows. Vectors of different lengths are whitened apart, each length by its own
fit list. Entries beyond 2**62 in size after scaling count as 2**62. Repeated rows and repeated or null ids each get their rows. Components whose eigenvalue is
nothing but rounding (a fit list with fewer directions than components) have no scale and are left out: a fit list of one vector gives no rows, nor
does an empty table. A deviation beyond 64 bits is null. Columns other than vec_id and embedding aren't read.

A block of B has 2**20 entries; the product's parts are added up by as many tasks as there are pairs of blocks, and those sums (of the vectors' length
squared each) by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, tidied

BLOCK_ENTRIES = 1 << 20
BOUND = 1 << 62


def whole_vectors(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and x of the rows that have one, and 128 bits (k0, k1) that stand for x where rows are joined."""
    entry = lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-BOUND)), F.lit(BOUND)) + F.lit(shift).cast("bigint")
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    whole = vectors.where((F.size("embedding") > 0) & finite).select("vec_id", F.transform("embedding", entry).alias("x"))
    return whole.select("*", F.xxhash64("x").alias("k0"), F.xxhash64(F.lit("x"), "x").alias("k1"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `index` from 0 on without gaps: numbers within parts, behind the counts of the parts before. Written once."""
    parts = stored(rows.withColumn("place", F.monotonically_increasing_id()), "whitening-fit").withColumn("part", F.shiftright("place", 33))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each task
    sizes = sizes.select(F.col("part").alias("own"), (before - F.shiftleft("part", 33)).alias("behind"))
    return parts.join(F.broadcast(sizes), F.col("part") == F.col("own")).select(*rows.columns, (F.col("place") + F.col("behind")).alias("index"))


def totals(fit: DataFrame, width: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and for each dimension the exact sum and the bounds of x. Batches are summed up first, in halves of 31 bits that can't run over."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch["x"].flatten().to_numpy().reshape(len(batch), width)
                columns = [np.full(width, len(batch)), (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *map(pa.array, columns)], names=["pos", "n", "high", "low", "least", "most"])

    parts = fit.select("x").mapInArrow(run, "pos bigint, n bigint, high bigint, low bigint, least bigint, most bigint")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = parts.groupBy("pos").agg(F.sum("n").alias("n"), whole("high"), whole("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("pos").collect()
    return rows[0]["n"], [(int(r["high"]) << 31) + int(r["low"]) for r in rows], [r["least"] for r in rows], [r["most"] for r in rows]


def blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """A matrix of n rows from index and the column of doubles `entries`."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("entries").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK_ENTRIES // width), width)


def scatter(b: BlockMatrix) -> np.ndarray:
    """B'B. The middle dimension is split, so that a task multiplies two blocks, not all of them."""
    splits = max(1, -(-b.numRowBlocks // 2))
    product = b.transpose()._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, b.colsPerBlock, b.colsPerBlock).toLocalMatrix().toArray()


def product_rows(spark: SparkSession, b: BlockMatrix, by: np.ndarray) -> DataFrame:
    """index and `entries` of B times a small matrix."""
    small = spark.sparkContext.parallelize([((0, 0), Matrices.dense(*by.shape, by.T.ravel().tolist()))], 1)
    made = b.multiply(BlockMatrix(small, *by.shape)).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", made._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("entries"))


def centred(fit: DataFrame, n: int, sums: list[int], size: int, off_most: int) -> DataFrame:
    """index, keys, entries (x - S / n) and deviation (the sum of (n x - S)^2) of the fit list. size and off_most: upper bounds of |x| and |n x - S|, which tell whether 64 bits are enough."""
    kind = np.int64 if n * size < BOUND and off_most**2 * len(sums) < BOUND else object
    s = np.array(sums, kind)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(len(batch), len(s))
            off = n * x.astype(kind) - s
            deviation = pa.array([int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)], pa.int64())
            entries = (off / n if kind is np.int64 else np.array([[float(Fraction(v, n)) for v in row] for row in off]).reshape(off.shape)).astype(np.float64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(s)), pa.array(entries.ravel()))
            yield pa.RecordBatch.from_arrays([batch["index"], batch["k0"], batch["k1"], flat, deviation], names=["index", "k0", "k1", "entries", "deviation"])

    return fit.select("index", "k0", "k1", "x").mapInArrow(run, "index bigint, k0 bigint, k1 bigint, entries array<double>, deviation bigint")


def fitted(fit: DataFrame, width: int, components: int) -> DataFrame | None:
    """keys of x, n, deviation, entries (whitened, by component), shares (explained, likewise) and identity_error of a fit list of vectors of one length; None without any component."""
    spark = fit.sparkSession
    rows = numbered(fit)
    n, sums, least, most = totals(rows, width)
    off_most = max(max(n * high - t, t - n * low) for t, low, high in zip(sums, least, most, strict=True))
    rows = stored(centred(rows, n, sums, max(map(abs, (*least, *most))), off_most), "whitening-centred")
    b = blocks(rows, n, len(sums))
    values, axes = np.linalg.eigh(scatter(b) / n)
    values, axes = values[::-1], axes[:, ::-1]
    count = int(np.count_nonzero(values[:components] > len(sums) * np.finfo(float).eps * max(values[0], 0)))
    if not count:
        return None
    made = stored(product_rows(spark, b, axes[:, :count] / np.sqrt(values[:count])), "whitening-projected")
    means = made.agg(*(F.avg(F.get("entries", F.lit(i))) for i in range(count))).first()
    middle = F.array(*(F.lit(float(m)) for m in means))
    spread = scatter(blocks(made.select("index", F.zip_with("entries", middle, lambda a, m: a - m).alias("entries")), n, count)) / n
    error = float(np.abs(spread - np.eye(count)).max())
    shares = F.array(*(F.lit(float(v / values.sum())) for v in values[:count]))
    return rows.select("index", "k0", "k1", "deviation").join(made, "index").select("k0", "k1", F.lit(n).cast("bigint").alias("n"), "deviation", "entries", shares.alias("shares"), F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error of every row and component."""
    rows = stored(whole_vectors(vectors, scale, shift), "whitening-rows")
    fit = stored(rows.select("k0", "k1", "x").distinct(), "whitening-distinct")
    widths = [r["w"] for r in fit.select(F.size("x").alias("w")).distinct().orderBy("w").collect()]  # lengths of vectors: one of a source, as a rule
    parts = [p for w in widths if (p := fitted(fit.where(F.size("x") == w), w, components)) is not None]
    if not parts:
        return rows.limit(0).selectExpr("vec_id", "1 component", "0L n", "0L deviation", "0d whitened", "0d explained", "0d identity_error")
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.union(p)
    out = rows.drop("x").join(joined, ["k0", "k1"]).select("*", F.posexplode("entries").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("at")).alias("explained"), "identity_error")
