"""Periodic runs of words, found in a grammar (operator 11).

A run is a stretch of consecutive words with smallest period q and length >= max(least, 2 q) that no neighbouring word
extends keeping period q. Each text gets its own grammar, those of a block of texts in one go: Re-Pair replaces repeated pairs of symbols,
the most frequent first, until none repeats; what is left of a text is joined pairwise to a tree. Of each node the runs
across its boundary are found once, at its first place (Main and Lorentz: how far the words around the boundary agree with those p words off), and moved to all
places where the grammar derives it; every run lies whole in the node whose boundary it crosses lowest. Intervals of one period that overlap
by a period are one run.

Whether words agree over a length is read from ranks of all stretches of 2, 4, 8, ... words, so results are exact (words themselves are
told apart by 64-bit values). A run repeats a stretch of least / 2 words within its text: texts without one have no run and need no
grammar, and boundaries away from such stretches need no search.

Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words, no runs and an empty collapsed text. Repeated rows each get a
row; an empty table gives none. Columns other than doc_id and text aren't read. A task holds a block of texts (2 MB, or one text): for texts with
repeats some 4 bytes for each word and doubling of length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import Hasher, mix, slices, text_bytes
from millrace.llm.common import tidied

BLOCK_BYTES = 2 << 20
#: Pairs of a boundary and a word that are looked at together.
PIECE = 1 << 21


def blank_bytes() -> np.ndarray:
    """Bytes that part words: [\\x20\\x09-\\x0D]."""
    table = np.zeros(256, bool)
    table[0x20] = table[0x09:0x0E] = True
    return table


def stretches(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """64-bit values of the n words from each word on, different in different rows; stretches that leave their row are zero."""
    out = np.zeros(len(hashes), np.uint64)
    whole = len(hashes) - n + 1
    if whole > 0:
        value = mix(rows[:whole].astype(np.uint64) + np.uint64(1))
        for i in range(n):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + whole])
        out[:whole] = np.where(rows[:whole] == rows[n - 1 :], value | np.uint64(1), np.uint64(0))
    return out


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once; zeros don't count."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][(ordered[1:] == ordered[:-1]) & (ordered[1:] != 0)])
    if not len(twice):
        return np.zeros(len(values), bool)
    return twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values


@dataclass
class Nodes:
    """Nodes of grammars: the first place of each as words first <= ... < last with the boundary before word `cut`, and all places as (node, word)."""

    first: np.ndarray
    cut: np.ndarray
    last: np.ndarray
    node: np.ndarray
    place: np.ndarray


def chosen(rank: np.ndarray) -> np.ndarray:
    """Places that are taken if they're taken by falling rank and none beside one that is taken. rank has -1 at both ends and at places that can't be taken, and no two equal neighbours; it is used up."""
    out = np.zeros(len(rank), bool)
    left = np.flatnonzero(rank >= 0)
    while len(left):
        best = left[(rank[left] > rank[left - 1]) & (rank[left] > rank[left + 1])]
        out[best] = True
        rank[best] = rank[best - 1] = rank[best + 1] = -1
        left = left[rank[left] >= 0]
    return out


def grammar(ids: np.ndarray, rows: np.ndarray) -> Nodes:
    """Re-Pair over ids (which differ between rows), then a tree over what is left of each row."""
    symbols, starts, ends, size = ids.astype(np.int64), np.arange(len(ids)), np.arange(1, len(ids) + 1), int(ids.max(initial=0)) + 1
    spans, of, places, count = [], [], [], 0

    def replace(at: np.ndarray, nodes: np.ndarray, one: np.ndarray) -> None:
        """Takes the symbols at `at` and behind them for the nodes (numbered from 0), of which `one` has a place each."""
        nonlocal symbols, starts, ends, count
        spans.append(np.stack([starts[one], starts[one + 1], ends[one + 1]]))
        of.append(nodes + count)
        places.append(starts[at])
        count += len(one)
        symbols[at] = size + nodes
        ends[at] = ends[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, starts, ends = symbols[keep], starts[keep], ends[keep]

    while len(symbols) > 1:
        key = symbols[:-1] * size + symbols[1:]
        at = np.arange(len(key))
        new = np.concatenate([[True], key[1:] != key[:-1]])  # of equal pairs that overlap every other one counts
        free = (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0
        pairs, which, times = np.unique(key[free], return_inverse=True, return_counts=True)
        order = np.empty(len(pairs), np.int64)
        order[np.lexsort((-np.arange(len(pairs)), times))] = np.arange(len(pairs))
        rank, pair = np.full(len(key) + 2, -1), np.full(len(key), -1)
        pair[free] = which
        rank[1:-1][free] = np.where(times[which] > 1, order[which], -1)
        taken = np.flatnonzero(chosen(rank)[1:-1])
        taken = taken[np.bincount(pair[taken], minlength=len(pairs))[pair[taken]] > 1]
        if not len(taken):
            break
        _, one, nodes = np.unique(pair[taken], return_index=True, return_inverse=True)
        replace(taken, nodes, taken[one])
        size += len(one)
    while True:
        row = rows[starts]
        at = np.arange(len(row))
        place = at - np.maximum.accumulate(np.where(np.concatenate([[True], row[1:] != row[:-1]]), at, 0)) if len(row) else at
        taken = np.flatnonzero((place[:-1] % 2 == 0) & (row[1:] == row[:-1]))
        if not len(taken):
            break
        replace(taken, np.arange(len(taken)), taken)
    first, cut, last = np.concatenate([np.zeros((3, 0), np.int64), *spans], axis=1)
    return Nodes(first, cut, last, np.concatenate([np.zeros(0, np.int64), *of]), np.concatenate([np.zeros(0, np.int64), *places]))


def ranks(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words (up to the longest asked for) from each word on: equal ranks mean equal words."""
    out = [ids]
    while (step := 1 << (len(out) - 1)) * 2 <= longest and len(out[-1]) > step:
        low = out[-1]
        _, rank = np.unique(low[:-step].astype(np.int64) * (int(low.max()) + 1) + low[step:], return_inverse=True)
        out.append(rank.astype(np.int32))
    return out


def agreement(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from x and y on (backwards: before them) agree, `most` at most."""
    n = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        while len(some := np.flatnonzero(n + step <= most)):
            shift = -n[some] - step if back else n[some]
            same = level[x[some] + shift] == level[y[some] + shift]
            n[some[same]] += step
            if k < len(levels) - 1 or not same.any():  # below the highest level a step is taken once at the most
                break
    return n


def crossing(nodes: Nodes, levels: list[np.ndarray], near: np.ndarray, wide: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """node, start, end and period of the runs across the boundary of each node, at its first place.

    near: words at which a stretch of ceil(least / 2) words begins that its text repeats. wide: values of the stretches of half that length.
    """
    half = -(-least // 2)
    part = -(-half // 2)
    sums = np.concatenate([[0], np.cumsum(near)])
    some = np.flatnonzero((nodes.last - nodes.first >= least) & (sums[np.minimum(nodes.cut + 1, len(near))] > sums[np.maximum(nodes.cut - half, nodes.first)]))
    found = []
    lengths = np.concatenate([[0], np.cumsum(nodes.last[some] - nodes.first[some])])
    for low, high in slices(lengths, PIECE):
        node = np.repeat(some[low:high], np.diff(lengths[low : high + 1]))
        y = np.arange(lengths[high] - lengths[low]) - np.repeat(lengths[low:high] - lengths[low], np.diff(lengths[low : high + 1])) + nodes.first[node]
        cut = nodes.cut[node]
        alike = (wide[y] == wide[cut]) | (wide[np.maximum(y - part, 0)] == wide[np.maximum(cut - part, 0)])
        alike &= y != cut
        node, y, cut = node[alike], y[alike], cut[alike]
        x, period = np.minimum(y, cut), np.abs(y - cut)
        ahead = agreement(levels, x, x + period, nodes.last[node] - x - period, False)
        before = agreement(levels, x, x + period, x - nodes.first[node], True)
        good = (ahead + before >= period) & (period + ahead + before >= least)
        found.append(np.stack([node, x - before, x + period + ahead, period])[:, good])
    node, start, end, period = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
    order = np.lexsort((period, end, start, node))  # the smallest period of an interval is its own; the others are multiples
    node, start, end, period = node[order], start[order], end[order], period[order]
    own = np.ones(len(node), bool)
    own[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[own], start[own], end[own], period[own]


def everywhere(nodes: Nodes, node: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end and period of the runs, moved to all places of their nodes and merged, by start and period."""
    order = np.argsort(nodes.node, kind="stable")
    edges = np.searchsorted(nodes.node[order], np.arange(len(nodes.first) + 1))
    times = edges[node + 1] - edges[node]
    at = np.repeat(edges[node] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    shift = nodes.place[order][at] - np.repeat(nodes.first[node], times)
    start, end, period = np.repeat(start, times) + shift, np.repeat(end, times) + shift, np.repeat(period, times)
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    new = np.concatenate([[True], period[1:] != period[:-1]])
    room = int(end.max()) + 1  # running maxima of ends within a period
    reach = np.maximum.accumulate(np.cumsum(new) * room + end) - np.cumsum(new) * room
    new[1:] |= start[1:] > reach[:-1] - period[1:]
    begin = np.flatnonzero(new)
    start, period = start[begin], period[begin]
    end = np.maximum.reduceat(end, begin)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def word_runs(hashes: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """start, end and period of all runs of words, numbered through all rows (which are in order)."""
    half = -(-least // 2)
    near = repeated(stretches(hashes, rows, half))
    kept = np.isin(rows, rows[near])  # other rows have no run
    words, hashes, rows, near = np.flatnonzero(kept), hashes[kept], rows[kept], near[kept]
    _, ids = np.unique(stretches(hashes, rows, 1), return_inverse=True)
    nodes = grammar(ids, rows)
    levels = ranks(ids.astype(np.int32), int(np.bincount(rows).max(initial=1)))
    start, end, period = everywhere(nodes, *crossing(nodes, levels, near, stretches(hashes, rows, -(-half // 2)), least))
    return (words[start], words[end - 1] + 1, period) if len(start) else (start, end, period)


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period) and collapsed: the words without those behind the first period of a run, joined by single spaces."""
    if least < 2:
        raise ValueError("a run has two words at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    inside = ~blank_bytes()

    def act(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> pa.RecordBatch:
        _, _, hashes, rows = hasher.words(raw, offsets, inside)
        n = len(batch)
        firsts = np.searchsorted(rows, np.arange(n + 1))
        start, end, period = word_runs(hashes, rows, least)
        change = np.zeros(len(rows) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change)[:-1] == 0
        of = np.searchsorted(rows[start], np.arange(n + 1)) if len(start) else np.zeros(n + 1, np.int64)
        texts = []
        for i in range(n):
            words = raw[offsets[i] : offsets[i + 1]].tobytes().split()  # at the same bytes
            if of[i] < of[i + 1]:
                words = [words[k] for k in np.flatnonzero(kept[firsts[i] : firsts[i + 1]])]
            texts.append(b" ".join(words))
        own = start - firsts[rows[start]] if len(start) else start
        found = pa.StructArray.from_arrays([pa.array(own), pa.array(end - start), pa.array(period)], fields=list(kind.value_type))
        runs = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), found)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(firsts)), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            raw, offsets = text_bytes(batch["text"])
            for first, last in slices(offsets, BLOCK_BYTES):
                yield act(batch.slice(first, last - first), raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], hasher)

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by h = crc32 of the decimal doc_id, h % 10 = 0) repeat themselves from a word on.

    With g = floor(h / 10) and n words, word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Texts without a doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    cut = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"))
    a = F.col("g") % F.size("words")
    cut = cut.select("*", F.when(F.size("words") > 0, a).cast("int").alias("a"))
    p = F.lit(1) + F.floor((F.size("words") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    cut = cut.select("*", p.cast("int").alias("p"))
    turned = F.transform(F.sequence("a", F.size("words") - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    new = F.array_join(F.concat(F.slice("words", 1, F.col("a")), turned), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, least: int = 12) -> DataFrame:
    """find_runs() of looped documents, as counts and digests: the longest run (ties: smallest start, then period), the digest of all runs and that of the collapsed text."""
    found = find_runs(looped(docs), least)
    first = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("longest", F.get(first, F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length = -F.col("longest.short")
    return found.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * -longest.short div longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
