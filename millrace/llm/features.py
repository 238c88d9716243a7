"""Hashed words and structure statistics of texts, as sparse rows (for operators 7 and 9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import Hasher, lower_table, slices, text_bytes
from millrace.llm.common import tidied

#: Statistics of a text, and how many buckets each is put in.
STATISTICS = ("length", "upper", "digit", "mark", "blank", "foreign", "word_length", "distinct", "repeated_lines", "lines", "long_word")
BUCKETS = 8
BLOCK_BYTES = 2 << 20


@dataclass
class Rows:
    """Sparse rows: row i has bins[edges[i]:edges[i + 1]], each once, and their values; n_words counts its words."""

    bins: np.ndarray
    values: np.ndarray
    edges: np.ndarray
    n_words: np.ndarray

    def sums(self, of: np.ndarray) -> np.ndarray:
        """Sum over each row of what is given for each of its bins."""
        total = np.concatenate([np.zeros((1, *of.shape[1:])), np.cumsum(of, axis=0, dtype=np.float64)])
        return total[self.edges[1:]] - total[self.edges[:-1]]


def dimensions(words: int) -> int:
    """Bins in all: those of words, then those of statistics."""
    return words + len(STATISTICS) * BUCKETS


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(raw: np.ndarray, offsets: np.ndarray, words: int, hasher: Hasher) -> Rows:
    """Words (A-Z lower-cased, runs of letters and digits) in `words` bins with the root of their count, scaled to length 1; each statistic as one bin of value 0.5."""
    n = len(offsets) - 1
    low = lower_table()[raw]
    starts, ends, hashes, rows = hasher.words(low, offsets)
    n_words = np.bincount(rows, minlength=n)
    joint = rows * words + (hashes % np.uint64(words)).astype(np.int64)
    joint, counts = np.unique(joint, return_counts=True)
    row, bins = joint // words, joint % words
    values = np.sqrt(counts)
    norm = np.sqrt(np.bincount(row, values**2, n))
    values = values / norm[row]

    size = np.maximum(np.diff(offsets), 1)
    _, _, of_lines, line_rows = hasher.words(raw, offsets, inside=np.arange(256) != 10)
    n_lines = np.bincount(line_rows, minlength=n)
    pairs = np.unique(np.stack([line_rows.astype(np.uint64), of_lines], axis=1), axis=0) if len(of_lines) else np.zeros((0, 2), np.uint64)
    own_lines = np.bincount(pairs[:, 0].astype(np.int64), minlength=n)
    lengths = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, rows, lengths)
    some = np.maximum(n_words, 1)
    share = {
        "length": np.log2(np.diff(offsets) + 1) / 18,
        "upper": per_row((raw >= 65) & (raw <= 90), offsets) / size * 2,
        "digit": per_row((raw >= 48) & (raw <= 57), offsets) / size * 4,
        "mark": per_row((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 128), offsets) / size * 4,
        "blank": per_row(raw <= 32, offsets) / size * 2,
        "foreign": per_row(raw > 127, offsets) / size * 2,
        "word_length": np.bincount(rows, lengths, n) / some / 12,
        "distinct": np.bincount(row, minlength=n) / some,
        "repeated_lines": 1 - own_lines / np.maximum(n_lines, 1),
        "lines": np.log2(n_lines + 1) / 10,
        "long_word": np.log2(longest + 1) / 8,
    }
    buckets = [words + i * BUCKETS + np.minimum((share[name] * BUCKETS).astype(np.int64), BUCKETS - 1) for i, name in enumerate(STATISTICS)]
    all_rows = np.concatenate([row, np.tile(np.arange(n), len(STATISTICS))])
    order = np.argsort(all_rows, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=n))])
    return Rows(np.concatenate([bins, *buckets])[order], np.concatenate([values, np.full(n * len(STATISTICS), 0.5)])[order].astype(np.float32), edges, n_words)


def over_blocks(batches: Iterator[pa.RecordBatch], words: int, act: Callable[[pa.RecordBatch, Rows], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """act(rows of the batch, their features) for blocks of bounded size."""
    hasher = Hasher()
    for batch in batches:
        raw, offsets = text_bytes(batch["text"])
        for first, last in slices(offsets, BLOCK_BYTES):
            yield act(batch.slice(first, last - first), features(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], words, hasher))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most_rows: int, words: int) -> tuple[Rows, np.ndarray]:
    """Features and targets of at most most_rows labelled rows, drawn by a hash of doc_id and evenly over the targets.

    labels: doc_id and a column `target` of a few integers. The draw bounds what is broadcast and what the driver holds
    (a row has no more than `words` bins).
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).select(F.col("doc_id").cast("bigint"), F.col(target).cast("int").alias("target"))
    counts = {r["target"]: r["count"] for r in labels.groupBy("target").count().collect()}
    each = most_rows / max(1, len(counts))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1_000_003))
    share = F.coalesce(*(F.when(F.col("target") == x, F.lit(each / n)) for x, n in counts.items()), F.lit(0.0)) if counts else F.lit(0.0)
    drawn = labels.where(dice < share * 1_000_003).orderBy(dice, "doc_id", "target").limit(most_rows)

    def act(batch: pa.RecordBatch, rows: Rows) -> pa.RecordBatch:
        n = len(batch)
        parts = [(rows.bins[rows.edges[i] : rows.edges[i + 1]].astype(np.int32).tobytes(), rows.values[rows.edges[i] : rows.edges[i + 1]].tobytes()) for i in range(n)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["target"], pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["doc_id", "target", "bins", "values"])

    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    got = joined.mapInArrow(tidied(lambda b: over_blocks(b, words, act)), "doc_id bigint, target int, bins binary, values binary").limit(2 * most_rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["target"], r["bins"]))
    bins = [np.frombuffer(r["bins"], np.int32) for r in got]
    values = [np.frombuffer(r["values"], np.float32) for r in got]
    edges = np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int64)
    joined_bins = np.concatenate(bins).astype(np.int64) if bins else np.zeros(0, np.int64)
    return Rows(joined_bins, np.concatenate(values) if values else np.zeros(0, np.float32), edges, np.zeros(len(got), np.int64)), np.array([r["target"] for r in got], np.int64)


def batches_of(rows: Rows, size: int, rounds: int, seed: int) -> Iterator[tuple[np.ndarray, Rows]]:
    """Shuffled batches of rows, round after round."""
    dice, n = np.random.default_rng(seed), len(rows.edges) - 1
    for _ in range(rounds):
        order = dice.permutation(n)
        for at in range(0, n, size):
            some = order[at : at + size]
            counts = rows.edges[some + 1] - rows.edges[some]
            edges = np.concatenate([[0], np.cumsum(counts)])
            where = np.repeat(rows.edges[some] - edges[:-1], counts) + np.arange(edges[-1])
            yield some, Rows(rows.bins[where], rows.values[where], edges, rows.n_words[some])


class Adam:
    """Adam's step for one array."""

    def __init__(self, of: np.ndarray, rate: float) -> None:
        self.of, self.rate, self.t, self.m, self.v = of, rate, 0, np.zeros_like(of), np.zeros_like(of)

    def step(self, slope: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (slope - self.m)
        self.v += 0.01 * (slope**2 - self.v)
        self.of -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
