"""SimHash near-dedup by Golay-code fuzzy hashing (operator 6).

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. A segment, filled up with zeros to 23
bits, lies at most 3 bits from exactly one codeword of the binary Golay code; its keys are the codewords
nearest to it and to each word that differs in one of its own bits. Two segments that differ in at most 2 bits have a
key in common: that of the word between them. When fingerprints differ in at most 4 bits, two
of the three segments differ in at most 2 bits together: both in none or one, or one of them in up to 2 and the other in none.
The second case meets under (whole segment, any key) of both. Where that fails every segment differs, so the two differ in one bit each and the third
in one or two, and of its three parts one is equal: they meet under (nearest codeword, any key, a part of the third) of
one and (any key, nearest codeword, the same part) of the other.

Words: A-Z lower-cased, then runs of [^\\x20\\x09-\\x0D]+. Null, empty and blank texts have fingerprint zero, which
links like any other. Exact copies have one fingerprint and are joined as one. Repeated rows
each get a row. An empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, discard, stored, tidied

#: Fixed value: the generator x^11+x^10+x^6+x^5+x^4+x^2+1 of the (23, 12) Golay code.
GENERATOR = 0b110001110101
#: Where each segment of a fingerprint begins, and its bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The furthest that the keys reach.
MOST_BITS = 4


def remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: words modulo the generator, as polynomials over two elements."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out ^= ((out >> bit) & 1) * (GENERATOR << (bit - 11))
    return out


def error_table() -> np.ndarray:
    """For each syndrome the one error of at most 3 bits that has it."""
    bits = 1 << np.arange(23, dtype=np.int64)
    ones = np.concatenate([[0], bits])
    errors = np.unique((ones[:, None, None] | ones[None, :, None] | ones[None, None, :]).ravel())
    table = np.zeros(1 << 11, np.int64)
    table[remainders(errors)] = errors
    return table


def segment_keys(words: np.ndarray, bits: int, table: np.ndarray) -> list[np.ndarray]:
    """Distinct keys of each segment, as columns; a repeated key is -1."""
    near = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    moved = words[:, None].astype(np.int64) ^ near[None, :]
    keys = np.sort((moved ^ table[remainders(moved)]) >> 11, axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles, repeats included: a bit is 1 if over half of their XXH64 (seed 42) have it."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= 4:
        return digest(whole, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total, n = np.zeros(64, np.int64), len(words) - 3
    for at in range(0, n, 1 << 16):
        some = [digest(whole[s:e], 42) for s, e in zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + 3 : at + 3 + (1 << 16)].tolist(), strict=True)]
        total += np.unpackbits(np.array(some, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * total > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit integer) of every row."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def spread(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a key of left and a key of right in each row; -1 is none. Returns row, left, right."""
    row, i = np.nonzero(left >= 0)
    again, j = np.nonzero(right >= 0)
    counts = np.bincount(again, minlength=len(right))
    many = counts[row]
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, i = np.repeat(row, many), np.repeat(i, many)
    return row, left[row, i], right[row, j[(np.cumsum(counts) - counts)[row] + place]]


#: A row may be compared as the one side, as the other, or as both.
LEFT, RIGHT, BOTH = 1, 2, 3


def with_keys(nodes: DataFrame) -> DataFrame:
    """About 130 rows for each fingerprint: key, side, fp. Fingerprints at most 4 bits apart have a key in common, with different sides or with both."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = error_table()
        for batch in batches:
            all_prints = batch["fp"].to_numpy().view(np.uint64)
            for first in range(0, len(all_prints), 2000):
                prints = all_prints[first : first + 2000]
                words = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)[:, None] for at, bits in SEGMENTS]
                keys = [segment_keys(w[:, 0], bits, table) for w, (_, bits) in zip(words, SEGMENTS, strict=True)]
                nearest = [(w ^ table[remainders(w)]) >> 11 for w in words]
                for pair, (a, b, c) in enumerate(((0, 1, 2), (0, 2, 1), (1, 2, 0))):
                    kinds = ((nearest[a], keys[b], LEFT), (keys[a], nearest[b], RIGHT), (words[a], keys[b], BOTH), (keys[a], words[b], BOTH))
                    for kind, (left, right, side) in enumerate(kinds):
                        row, x, y = spread(left, right)
                        if side == BOTH:
                            key = ((pair * 4 + kind) << 46) | (x << 23) | y
                        else:  # both of these kinds have the tag 0, so that they meet
                            third = words[c][row]
                            parts = np.concatenate([(i << 8) | ((third >> (7 * i)) & (0xFF if i == 2 else 0x7F)) for i in range(3)], axis=1)
                            key = ((pair * 4) << 46) | (parts << 24) | (x << 12)[:, None] | y[:, None]
                            key, row = key.ravel(), np.repeat(row, 3)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(row), side, np.int8)), pa.array(prints[row].view(np.int64))], names=["key", "side", "fp"])

    return nodes.select("fp").mapInArrow(run, "key bigint, side tinyint, fp bigint")


def differing(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def labelled(rows: DataFrame, by: str, edges: DataFrame) -> DataFrame:
    """rows with `part`: the component in which edges (src, dst) put the value of column `by`, or that value itself."""
    found = stored(connected_components(edges), "golay-parts")
    return rows.join(found, rows[by] == found["node"], "left").withColumn("part", F.coalesce("component", by)).drop("node", "component")


def mixed_keys(placed: DataFrame) -> DataFrame:
    """For each key under which rows of different sides lie in different parts: the rows of the lowest and highest part of either side."""
    spot = F.struct("part", "fp")
    sides = {"l": F.col("side") != RIGHT, "r": F.col("side") != LEFT}
    ends = placed.groupBy("key").agg(*(of(F.when(side, spot)).alias(name + end) for name, side in sides.items() for end, of in (("0", F.min), ("1", F.max))))
    return ends.where("l0.part != r1.part or l1.part != r0.part")


def linked_parts(nodes: DataFrame, most: int) -> DataFrame:
    """part of each fp that shares a key: fingerprints linked by differences of at most `most` bits have one part.

    Parts grow in three steps. Every fingerprint is compared with the smallest of the other side of each of its key groups; then with one of
    another part in each group that still has several parts; the few groups left open are compared in full, between parts only. The rows of
    the first two steps grow with the number of keys, not with the square of a group, and a crowd of near copies falls to them.
    """
    every = stored(with_keys(nodes), "golay-keys")
    heads = every.groupBy("key").agg(F.min(F.when(F.col("side") != RIGHT, F.col("fp"))).alias("head"), F.min(F.when(F.col("side") != LEFT, F.col("fp"))).alias("other"), F.max("fp").alias("last"))
    heads = heads.where("head is not null and other is not null and (head != other or last > head)").drop("last")
    keyed = stored(every.join(heads, "key"), "golay-shared")  # what meets nothing is done
    discard(every)
    pairs = F.array(F.when(F.col("side") != LEFT, F.col("head")), F.when(F.col("side") == LEFT, F.col("other")))
    star = keyed.select("fp", F.explode(pairs).alias("dst")).where("dst is not null and fp != dst").where(differing("fp", "dst") <= most)
    placed = stored(labelled(keyed.select("key", "side", "fp"), "fp", star.select(F.col("fp").alias("src"), "dst")), "golay-placed")
    discard(keyed)

    far = lambda low, high: F.when(F.col(low)["part"] != F.col("part"), F.col(low)).otherwise(F.col(high))
    beside = F.when(F.col("side") != RIGHT, far("r0", "r1")).otherwise(far("l0", "l1"))
    second = placed.join(mixed_keys(placed), "key").where((beside["part"] != F.col("part")) & (F.bit_count(F.col("fp").bitwiseXOR(beside["fp"])) <= most))
    placed = stored(labelled(placed, "part", second.select(F.col("part").alias("src"), beside["part"].alias("dst"))), "golay-placed")

    open_ = placed.join(mixed_keys(placed), "key", "left_semi")
    left = open_.where(F.col("side") != RIGHT).select("key", F.col("fp").alias("x"), F.col("part").alias("src"))
    right = open_.where(F.col("side") != LEFT).select("key", F.col("fp").alias("y"), F.col("part").alias("dst"))
    last = left.join(right, "key").where("src != dst").where(differing("x", "y") <= most)
    return labelled(placed.select("fp", "part").distinct(), "part", last.select("src", "dst"))


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row.

    component_id is the smallest doc_id reachable by links of fingerprints that differ in at most `most` (4 at the most) bits.
    A null doc_id is a document that no component is named after unless it has no other.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError("the keys find differences of 0 to 4 bits")
    prints = stored(fingerprints(docs), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    placed = nodes.join(linked_parts(nodes, most), "fp", "left").select("fp", "least", F.coalesce("part", "fp").alias("part"))
    named = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    groups = placed.join(named, "part").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
