"""Benchmark decontamination by a positional inverted index (operator 3).

Documents are cut into blocks. For each block and each distinct word the index holds one row: the
word's 64-bit value and the places at which it stands, as gaps (`postings`). `blocks` holds, for each block,
the documents with their word counts. Both are tables in the shared folder. A benchmark item's
windows are looked up by intersecting the lists of their words, shifted by their place in the
window, beginning with the word that is rarest in the whole corpus. A block answers for its own
documents, so lists never cross the network and no list grows with the corpus.

Words: A-Z lower-cased, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Null or wordless texts have no words,
are never contaminated and still get a row. Repeated rows each get their own; ties don't matter.
Items without words match nothing; items that repeat an id count once; an item without an id hits words, but no list of items names it. Empty tables give no rows or
clean documents. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytewords import Hasher, lower_table, slices, text_bytes
from millrace.llm.common import stored, tidied
from millrace.session import fresh_dir

#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 4 << 20


def build_index(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> str:
    """Writes the positional index of docs (doc_id, text); returns its folder.

    One row of `index` is one block: a name of its own, ids, word counts, and for its distinct words in the order of their
    values the counts and the places, as the gaps between them, in 32 bits each.
    """
    path = path or fresh_dir(docs.sparkSession, "postings")

    @tidied
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, hasher = lower_table(), Hasher()
        for batch in batches:
            raw, offsets = text_bytes(batch["text"])
            for first, last in slices(offsets, block_bytes):
                part = offsets[first : last + 1] - offsets[first]
                _, _, words, rows = hasher.words(lower[raw[offsets[first] : offsets[last]]], part)
                order = np.argsort(words, kind="stable")
                terms, at, counts = np.unique(words[order], return_index=True, return_counts=True)
                gaps = np.diff(order, prepend=0)
                gaps[at] = order[at]
                ids = batch["doc_id"].slice(first, last - first)
                n_words = np.bincount(rows, minlength=last - first)
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (terms, counts.astype(np.uint32), gaps.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *packed, pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([n_words.tolist()], pa.list_(pa.int64()))], names=["block", "terms", "counts", "gaps", "doc_ids", "n_words"])

    docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(blocks, "block string, terms binary, counts binary, gaps binary, doc_ids array<bigint>, n_words array<bigint>").write.option("compression", "zstd").parquet(f"{path}/index")
    return path


def benchmark_windows(texts: list[tuple[str, str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all windows (rows of `size`, padded with 0), their lengths, and the number of their item."""
    lower, hasher, rows, lengths, owner = lower_table(), Hasher(), [], [], []
    raw, offsets = text_bytes(pa.array([t for _, t in texts], pa.string()))
    _, _, words, of = hasher.words(lower[raw], offsets)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    for item in range(len(texts)):
        own = words[edges[item] : edges[item + 1]]
        if len(own):
            wide = np.lib.stride_tricks.sliding_window_view(own, min(size, len(own)))
            padded = np.zeros((len(wide), size), np.uint64)
            padded[:, : wide.shape[1]] = wide
            rows.append(padded)
            lengths += [wide.shape[1]] * len(wide)
            owner += [item] * len(wide)
    if not rows:
        return np.zeros((0, size), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.array(lengths), np.array(owner)


class Block:
    """The lists of one block, opened as they are asked for."""

    def __init__(self, terms: bytes, counts: bytes, gaps: bytes) -> None:
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.gaps = np.frombuffer(gaps, np.uint32)
        self.open: dict[int, np.ndarray] = {}

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Number of each word's list, -1 where the block lacks it."""
        if not len(self.terms):
            return np.full(words.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def places(self, term: int) -> np.ndarray:
        if term not in self.open:
            end = int(self.ends[term])
            self.open[term] = np.cumsum(self.gaps[end - int(self.counts[term]) : end].astype(np.int64))
        return self.open[term]

    def phrase(self, lists: np.ndarray, rarest_first: np.ndarray) -> np.ndarray:
        """Places at which the window begins exactly."""
        at = self.places(int(lists[rarest_first[0]])) - rarest_first[0]
        for k in rarest_first[1:]:
            if not len(at):
                break
            other = self.places(int(lists[k]))
            i = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
            at = at[other[i] == at + k]
        return at

    def near(self, lists: np.ndarray, rarest_first: np.ndarray, slack: int) -> np.ndarray:
        """Places of the rarest word with every other word at most `slack` words off its own place in the window."""
        at = self.places(int(lists[rarest_first[0]]))
        for k in rarest_first[1:]:
            if not len(at):
                break
            other, least = self.places(int(lists[k])), at + k - rarest_first[0] - slack
            i = np.minimum(np.searchsorted(other, least), len(other) - 1)
            at = at[(other[i] >= least) & (other[i] <= least + 2 * slack)]
        return at


def search(spark: SparkSession, path: str, items: list[tuple[str, str]], size: int, slack: int) -> DataFrame:
    """What a bounded list of items hits in each document: block, row, doc_id, n_words, hits (places of its words), items and near_items."""
    windows, lengths, owner = benchmark_windows(items, size)
    names = [name for name, _ in items]
    wanted = np.unique(windows[windows > 0]) if len(windows) else np.zeros(0, np.uint64)
    index = spark.read.parquet(f"{path}/index")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch["terms"], batch["counts"], strict=True):
                block = Block(terms.as_py(), counts.as_py(), b"")
                at = block.rank(wanted)
                total[at >= 0] += block.counts[at[at >= 0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(total)], names=["term", "n"])

    found = index.select("terms", "counts").mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect() if len(wanted) else []
    often = np.zeros(len(wanted), np.int64)
    for term, n in found:  # at most one for each word of the bounded list of items
        often[term] = n
    ranked = np.where(windows > 0, often[np.minimum(np.searchsorted(wanted, windows), max(0, len(wanted) - 1))] if len(wanted) else 0, np.iinfo(np.int64).max)
    order = np.argsort(ranked, axis=1, kind="stable")

    @tidied
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, terms, counts, gaps, ids, n_words in zip(*(batch[c] for c in ("block", "terms", "counts", "gaps", "doc_ids", "n_words")), strict=True):
                block, sizes = Block(terms.as_py(), counts.as_py(), gaps.as_py()), np.array(n_words.as_py(), np.int64)
                starts = np.cumsum(sizes) - sizes
                lists = block.rank(windows)
                hits = np.zeros(int(sizes.sum()) + 1, np.int64)  # +1 where a match begins, -1 after it
                exact: list[tuple[np.ndarray, int]] = []
                close: list[tuple[np.ndarray, int]] = []
                for w in np.flatnonzero(((lists >= 0) | (windows == 0)).all(axis=1)):
                    n, first = int(lengths[w]), order[w, : int(lengths[w])]
                    at = block.phrase(lists[w], first)
                    row = np.searchsorted(starts, at, side="right") - 1
                    good = at + n <= (starts + sizes)[row] if len(at) else np.zeros(0, bool)
                    at, row = at[good], row[good]
                    np.add.at(hits, at, 1)
                    np.add.at(hits, at + n, -1)
                    if len(row):
                        exact.append((np.unique(row), int(owner[w])))
                    if len(around := block.near(lists[w], first, slack)):
                        close.append((np.unique(np.searchsorted(starts, around, side="right") - 1), int(owner[w])))
                covered = np.flatnonzero(np.cumsum(hits) > 0)
                edges = np.searchsorted(covered, np.append(starts, sizes.sum()))
                places = covered - np.repeat(starts, np.diff(edges))
                hit_lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(places, pa.int32()))
                found, nearby = ([[] for _ in sizes] for _ in range(2))
                for out, got in ((found, exact), (nearby, close)):
                    for rows, item in got:
                        for row in rows:
                            out[row].append(item)
                as_lists = [pa.array([[names[i] for i in sorted(set(x)) if names[i] is not None] for x in out], pa.list_(pa.string())) for out in (found, nearby)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(sizes)), pa.array(np.arange(len(sizes), dtype=np.int32)), ids.values, pa.array(sizes), hit_lists, *as_lists], names=["block", "row", "doc_id", "n_words", "hits", "items", "near_items"])

    return index.mapInArrow(match, "block string, row int, doc_id bigint, n_words bigint, hits array<int>, items array<string>, near_items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slack: int = 2, part_bytes: int = 2 << 20) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near_items.

    size: words of a window; an item of fewer words is one window. n_hit: words of the document inside any exact
    occurrence. near_items: items of which a window stands there with each word at most `slack` places off.
    The benchmark goes to all tasks, part_bytes of its text at a time (an item is never cut); what the parts hit is put together for each document.
    """
    path = build_index(docs)
    texts = stored(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null"), "benchmark")
    parts = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) / part_bytes))
    return summary(search_parts(docs.sparkSession, path, texts, parts, size, slack))


def search_parts(spark: SparkSession, path: str, texts: DataFrame, parts: int, size: int, slack: int) -> DataFrame:
    """search() for texts (item, text) in so many parts by a hash: one row for each document."""
    whole = [search(spark, path, [tuple(r) for r in texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == n).collect()], size, slack) for n in range(parts)]
    if parts == 1:
        return whole[0]
    # A document has one row for each part; only the first part's also tells of documents without hits.
    found = stored(reduce(DataFrame.union, (p if n == 0 else p.where("size(hits) + size(items) + size(near_items) > 0") for n, p in enumerate(whole))), "benchmark-hits")
    joined = (F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "items", "near_items"))
    return found.groupBy("block", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *joined)


def summary(found: DataFrame) -> DataFrame:
    items = F.array_sort("items")
    found = found.withColumn("n_hit", F.size("hits").cast("bigint"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), items.alias("items"), F.array_sort("near_items").alias("near_items"))


def brute_force(text: str | None, items: list[tuple[str, str | None]], size: int = 10) -> tuple[int, int, int, str]:
    """What decontaminate() returns for one text, computed plainly; for tests."""
    import re

    def words(x: str | None) -> list[str]:
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))

    own, hit, found = words(text), set(), set()
    for item, other in items:
        theirs = words(other)
        n = min(size, len(theirs))
        for i in range(len(theirs) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == theirs[i : i + n]:
                    hit |= {*range(j, j + n)}
                    found |= {str(item)} - {"None"}
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
