"""Embedding near-dedup: spherical k-means cells and blocked cosine products (operator 10).

Exact copies are joined as one. k-means on a sample gives cells, beyond a thousand of them in two levels (a centre, and a centre of what is left behind it), so that
their number can grow with the vectors; each distinct vector is a member of its nearest
cell and a guest of every cell that could be the home of a vector within the threshold: a vector within angle t of x can lie across the plane
between two centres only if x lies within sin t of that plane. So no link is lost, however the cells fall. Vectors
without any clusters of their own make guests nearly everywhere, and the work is then that of comparing all with all; `reach` below 1 narrows
the planes' margin for such data at the price of some links.

Within a cell members are compared with members and guests, block by block, as matrix products in single precision with room for
its error; what passes is computed in double precision. A block pair gives the link counts of its rows and a spanning forest of its
links, so that neither a large cell nor a crowd of near copies makes all pairs into rows.

Vectors that are null, zero or hold null or non-finite components link with nothing and are kept; vectors
of different lengths don't link. Repeated rows each get a row; vec_id should be unique, and a null vec_id is never the
name of a component that has another member. An empty table gives no rows. Columns other than vec_id and
embedding are not read; labels play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, stored, tidied


def units(column: list[bytes] | pd.Series, width: int, kind: str) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, cells: int, unit: bool, rounds: int = 8) -> np.ndarray:
    """Centres of the rows of x, of length 1 if asked for; no more than there are rows."""
    c = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[at : at + 2048] @ c.T - (0 if unit else (c**2).sum(axis=1) / 2)).argmax(axis=1) for at in range(0, len(x), 2048)])
        sums, times = np.zeros_like(c), np.bincount(home, minlength=len(c))[:, None]
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True) if unit else times
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


@dataclass
class Level:
    """Centres, half their squared lengths, and their distances from each other."""

    c: np.ndarray
    half: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, c: np.ndarray) -> Level:
        square = (c**2).sum(axis=1)
        return cls(c, square / 2, np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 0)))

    def near(self, x: np.ndarray, margin: float, linear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of x: row, cell, and whether the cell is the row's own, for its own cell and those whose border is within the margin."""
        scores = x @ self.c.T - (0 if linear else self.half)
        home = scores.argmax(axis=1)
        inside = scores[np.arange(len(x)), home][:, None] - scores <= margin * self.apart[home] + 1e-12
        inside[np.arange(len(x)), home] = True
        rows, cells = np.nonzero(inside)
        return rows, cells, cells == home[rows]


def centres(vectors: DataFrame, cells: int, most_rows: int, kind: str, first_level: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means on a sample of vectors (drawn by hash; shorter vectors are filled up with zeros), and k-means on what is left of each behind its centre.

    The cells are pairs of both; one centre of the second kind is enough up to first_level cells. The sample has most_rows vectors, or ten for each centre of the larger kind (about the root of the cells)."""
    tops = min(cells, max(first_level, math.isqrt(cells)))
    subs = math.ceil(cells / tops)
    most_rows = max(most_rows, 10 * max(tops, subs))
    drawn = [r["raw"] for r in vectors.orderBy(F.xxhash64("copy", F.lit("k-means")), "copy").limit(most_rows).select("raw").collect()]
    if not drawn:
        return np.zeros((1, 1)), np.zeros((1, 1))
    size = np.dtype(kind).itemsize
    x = np.zeros((len(drawn), max(len(r) for r in drawn) // size))
    for i, r in enumerate(drawn):
        x[i, : len(r) // size] = units([r], len(r) // size, kind)
    top = k_means(x, tops, unit=True)
    if subs == 1:
        return top, np.zeros((1, x.shape[1]))
    home = np.concatenate([(x[at : at + 2048] @ top.T).argmax(axis=1) for at in range(0, len(x), 2048)])
    return top, k_means(x - top[home], subs, unit=False)


def fitted(c: np.ndarray, width: int) -> np.ndarray:
    """Centres for vectors of a width."""
    return c[:, :width] if c.shape[1] >= width else np.pad(c, ((0, 0), (0, width - c.shape[1])))


def cell_rows(x: np.ndarray, top: Level, sub: Level, margin: float, reach_length: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For vectors (rows of unit length): row, cell, and whether the cell is the row's home, for home and guest cells; `step` rows at a time.

    A vector within the threshold lies within the margin of any plane between centres that parts them, and within reach_length of the vector itself."""
    for at in range(0, len(x), step):
        rows, tops, own = top.near(x[at : at + step], margin, linear=True)
        rows += at
        if len(sub.c) == 1:
            yield rows, tops, own
            continue
        for first in range(0, len(rows), step):
            some = slice(first, first + step)
            part, cells, nearest = sub.near(x[rows[some]] - top.c[tops[some]], reach_length, linear=False)
            yield rows[some][part], tops[some][part] * len(sub.c) + cells, own[some][part] & nearest


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of n nodes to the smallest node of its component, for given links."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(n))
    return moved, least[moved]


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of cosine >= threshold, a few hundred rows of x at a time."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    room = np.float32(threshold - 1e-6 - 3e-7 * x.shape[1])
    for at in range(0, len(x), 512):
        a, b = np.divmod(np.flatnonzero(x32[at : at + 512] @ y32.T >= room), len(y))
        for first in range(0, len(a), 1 << 15):
            p, q = a[first : first + (1 << 15)] + at, b[first : first + (1 << 15)]
            good = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            yield p[good], q[good]


def near_copies(vectors: DataFrame, threshold: float = 0.95, cell_size: int = 16_384, sample: int = 20_000, block: int = 8192, reach: float = 1.0, first_level: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding).

    n_links: other vectors of cosine >= threshold. component_id: smallest vec_id reachable by links. cell_size: vectors in a cell
    on average. sample: vectors that k-means sees, or ten for each centre of the larger level. first_level: cells from which on they have two levels. block: rows of a matrix product's side. reach: 1 finds every link;
    0.3 finds nearly all links of vectors of 64 dimensions (the tests measure it) in a small part of the cells.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch["embedding"]:
                x = np.array(v.as_py(), np.float64) if v.is_valid else np.zeros(0)
                out.append(x.astype(kind).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary())], names=["vec_id", "raw"])

    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")).mapInArrow(pack, "vec_id bigint, raw binary")
    rows = stored(rows.withColumn("copy", F.sha2("raw", 256)), "vectors")
    distinct = rows.where("raw is not null").groupBy("copy", "raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = stored(distinct.withColumn("node", F.xxhash64("copy")), "vectors-distinct")
    top, sub = centres(distinct, max(1, math.ceil(distinct.count() / cell_size)), sample, kind, first_level)
    margin, reach_length = reach * math.sqrt(1 - threshold**2) + 1e-9, reach * math.sqrt(2 - 2 * threshold) + 1e-9

    @tidied
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[int, tuple[Level, Level]] = {}
        for batch in batches:
            raw = batch["raw"].to_pylist()
            widths = np.array([len(r) for r in raw]) // np.dtype(kind).itemsize
            for width in np.unique(widths):
                if width not in levels:
                    levels[width] = Level.of(fitted(top, int(width))), Level.of(fitted(sub, int(width)))
                own = np.flatnonzero(widths == width)
                for row, cell, home in cell_rows(units([raw[i] for i in own], int(width), kind), *levels[width], margin, reach_length):
                    at = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(home), pa.array(np.full(len(row), width, np.int32)), *(batch[k].take(at) for k in ("node", "copies", "raw"))], names=["cell", "home", "width", "node", "copies", "raw"])

    dealt = stored(distinct.select("raw", "node", "copies").mapInArrow(deal, "cell bigint, home boolean, width int, node bigint, copies bigint, raw binary"), "vectors-cells")
    # Members fall into `lefts` blocks, members and guests into `rights`; each pair of blocks is one group.
    blocks = lambda n: F.ceil(n / F.lit(float(block))).cast("int")
    sizes = dealt.groupBy("cell", "width").agg(blocks(F.count_if("home")).alias("lefts"), blocks(F.count("*")).alias("rights")).where("lefts > 0")
    placed = dealt.join(sizes, ["cell", "width"])
    as_left = placed.where("home").select("*", F.lit(True).alias("left"), F.expr("cast(pmod(node, lefts) as int)").alias("i"), F.explode(F.expr("sequence(0, rights - 1)")).alias("j"))
    as_right = placed.select("*", F.lit(False).alias("left"), F.explode(F.expr("sequence(0, lefts - 1)")).alias("i"), F.expr("cast(pmod(node, rights) as int)").alias("j"))
    paired = as_left.union(as_right.select(as_left.columns))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        one, other = pdf[pdf["left"]], pdf[~pdf["left"]]
        n = len(one)
        nodes, copies = (np.concatenate([one[k], other[k]]) for k in ("node", "copies"))
        count, ends = np.zeros(len(nodes), np.int64), [np.zeros((2, 0), np.int64)]
        if n and len(other):
            for a, b in linked(units(one["raw"], width, kind), units(other["raw"], width, kind), threshold):
                mine = nodes[a] < nodes[n + b]  # a pair counts once: on the left is its smaller node, in its home cell
                a, b = a[mine], b[mine]
                np.add.at(count, a, copies[n + b])
                np.add.at(count, n + b, copies[a])
                ends.append(np.stack(forest(a, n + b, len(nodes))))
        a, b = forest(*np.concatenate(ends, axis=1), len(nodes))
        some = np.flatnonzero(count)
        return pd.DataFrame({"src": np.concatenate([nodes[some], nodes[a]]), "dst": np.concatenate([nodes[some], nodes[b]]), "n": np.concatenate([count[some], np.zeros(len(a), np.int64)])})

    found = stored(paired.groupBy("cell", "width", "i", "j").applyInPandas(compare, "src bigint, dst bigint, n bigint"), "vectors-links")
    linked_nodes = found.groupBy("src").agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("src != dst").select("src", "dst")).withColumnRenamed("node", "own")
    nodes = distinct.join(linked_nodes, distinct["node"] == linked_nodes["src"], "left").join(parts, distinct["node"] == parts["own"], "left")
    nodes = nodes.select("copy", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", distinct["node"]).alias("part"))
    named = nodes.groupBy("part").agg(F.min("least").alias("component_id"))
    groups = nodes.join(named, "part").select("copy", "n_links", "component_id")
    out = rows.select("vec_id", "copy").join(groups, "copy", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("copy").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id").eqNullSafe(F.col("component_id")), F.lit(False)))
