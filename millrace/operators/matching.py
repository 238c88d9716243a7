"""Titles of a group matched one to one, or merged, where the order of rows decides (JOIN-15, JOIN-16).

Titles are compared in blocks, each a task of its own however large its group is. For matching, each distinct title gets a list of the best that it may take, a little longer than it has rows;
a list that turns out too short is continued. For merging, all pairs of distinct titles that are alike enough are kept. What the order decides follows from these: in one task for groups of few
lines of lists or pairs, else in rounds over all groups at once.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranges import by_key, stored

#: Rows of a block's side, and pairs of a group that one task settles.
BLOCK, MOST = 256, 500_000
#: Blocks that one call of Python compares, about.
BLOCKS_PACKED = 64
#: Titles of either side of a block where lists of the best are made; what a list has beyond the rows of its own title, at first and at the most.
EXPECTED, OFFERED, SPARE, MOST_SPARE = 256, 65_536, 16, 1_024
#: White space, as plain() takes it off, and ratios of pairs that a worker remembers at the most: pages have titles in common.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
REMEMBERED = 1 << 17
#: Bounds of ratios and ratios are quotients of small numbers: less than this apart they are equal.
CLOSE = 1e-12
#: Beyond every pos, and before.
LAST, FIRST = 2**63 - 1, -(2**63)


def plain(title: str | None) -> str:
    return (title or "").strip().lower()


def letters(titles: list[str], width: int = 64) -> np.ndarray:
    """How often letters (in `width` classes) stand in each title."""
    out = np.zeros((len(titles), width), np.int16)
    for i, t in enumerate(titles):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % width, 1)
    return out


def bounds(a: list[str], b: list[str]) -> np.ndarray:
    """Upper bounds of the ratios of all pairs: letters in common, by class, can't be fewer than those that match."""
    x, y = letters(a), letters(b)
    common = np.stack([np.minimum(row, y).sum(axis=1) for row in x]) if len(a) else np.zeros((0, len(b)))
    sizes = np.array([len(t) for t in a])[:, None] + np.array([len(t) for t in b])[None, :]
    return 2.0 * common / np.maximum(sizes, 1)


def similarity(title: str, other: str) -> float:
    """A title that holds the other is worth the ratio of their lengths, 0.6 at least."""
    if title in other or other in title:
        return max(0.6, min(len(title), len(other)) / max(len(title), len(other)))
    return SequenceMatcher(None, title, other).ratio()


class Offers:
    """Titles of a block in order of pos, laid out to bound their similarities to a title all at once."""

    def __init__(self, titles: list[str], classes: int = 128) -> None:
        self.titles, self.classes = titles, classes
        self.size = np.array([len(t) for t in titles], np.int64)
        codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(len(titles)), self.size)
        self.kinds, kind = np.unique(codes % classes, return_inverse=True)  # those that stand in a title
        counts = np.bincount(kind * len(titles) + rows, minlength=len(self.kinds) * len(titles)).reshape(len(self.kinds), len(titles))
        self.counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
        self.most, self.varied = counts.max(axis=1, initial=0), counts.min(axis=1, initial=2**40) < counts.max(axis=1, initial=0)
        known, flat = np.unique(codes, return_inverse=True)
        self.known = {int(c): i for i, c in enumerate(known)}
        self.flat = np.append(flat, len(known))  # behind all titles stands what is no letter of any
        self.start = np.cumsum(self.size) - self.size

    def common(self, title: str) -> np.ndarray:
        """Letters in common, by class: no fewer than those that match."""
        codes = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.minimum(np.bincount(codes % self.classes, minlength=self.classes)[self.kinds], self.most)
        out = np.full(len(self.titles), own[~self.varied].sum(), np.int32)
        for c in np.flatnonzero((own > 0) & self.varied):
            out += np.minimum(self.counts[c], self.counts.dtype.type(own[c]))
        return out

    def in_order(self, title: str, rows: np.ndarray) -> np.ndarray:
        """Letters in common in one order, of each 64 letters of the title: no fewer than those that match. The longest common subsequence by the bits of a word."""
        start, size, out = self.start[rows], self.size[rows], np.zeros(len(rows), np.int64)
        for at in range(0, len(title), 64):
            masks = np.zeros(len(self.known) + 1, np.uint64)
            for i, letter in enumerate(title[at : at + 64]):
                if (k := self.known.get(ord(letter))) is not None:
                    masks[k] |= np.uint64(1 << i)
            left = np.full(len(rows), 2**64 - 1, np.uint64)
            for j in range(int(size.max(initial=0))):
                hit = left & masks[self.flat[np.where(j < size, start + j, len(self.flat) - 1)]]
                left = (left + hit) | (left - hit)
            out += np.bitwise_count(~left)
        return out

    def bound(self, title: str, common: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of similarities, by letters in common: one title can hold the other only if all its letters are there."""
        ratio = 2.0 * common / np.maximum(len(title) + size, 1)
        return np.where(common >= np.minimum(len(title), size), np.maximum(ratio, 0.6), ratio)

    def best(self, title: str, k: int, least: float, usable: np.ndarray, behind: Callable[[float, int], bool]) -> list[tuple[float, int]]:
        """(-similarity, row) of the k best usable ones for which behind() holds; of equals the first.

        Rows come by falling bounds, and the similarity itself is worked out only where the bound says that the row may still be among the k."""
        upto = self.bound(title, self.common(title), self.size)
        rows = np.flatnonzero((upto >= least - 1e-9) & usable & (self.size > 0)) if title else np.zeros(0, np.int64)
        rows = rows[np.argsort(-np.ceil(upto[rows] * 30_000).astype(np.int16), kind="stable")]
        found, known, at, step = [], {}, 0, 256

        def hopeful(bound: np.ndarray | float, row: np.ndarray | int) -> np.ndarray | bool:
            if len(found) < k:
                return bound >= least - 1e-9
            s, last = -found[-1][0], found[-1][1]
            return (bound > s + CLOSE) | (bound >= s - CLOSE) & (row < last)

        while at < len(rows):
            if len(found) == k and upto[rows[at]] + 1 / 30_000 < -found[-1][0]:
                break
            part = rows[at : at + step]
            at, step = at + step, step * 2
            part = part[hopeful(upto[part], part)]
            tight = upto[part]
            near = 2.0 * np.minimum(len(title), self.size[part]) / (len(title) + self.size[part]) >= least - 1e-9  # else one can only hold the other
            tight[near] = np.minimum(tight[near], self.bound(title, self.in_order(title, part[near]), self.size[part[near]]))
            part, tight = part[kept := np.asarray(hopeful(tight, part), bool)], tight[kept]
            for i in np.argsort(-tight, kind="stable").tolist():
                row = int(part[i])
                if not hopeful(float(tight[i]), row):
                    continue
                other = self.titles[row]
                if other not in known:
                    known[other] = similarity(title, other)
                if (s := known[other]) >= least and behind(s, row):
                    insort(found, (-s, row))
                    del found[k:]
        return found


_ratios: dict[tuple[str, str], float] = {}


def repeats(a: list[str], b: list[str], upto: np.ndarray, alike: float) -> tuple[list, list, list]:
    """Places of pairs of which the one of b repeats the one of a: one begins with the other, or their ratio is over `alike`."""
    rows, cols = [], []
    hopeful = bounds(a, b) > alike - 1e-9
    if len(_ratios) > REMEMBERED:
        _ratios.clear()
    for j, other in enumerate(b):
        matcher = None  # its index is made once for all of a
        for i, title in enumerate(a[: upto[j]]):
            if not title or not other:
                continue
            near = title.startswith(other) or other.startswith(title)
            if not near and hopeful[i, j]:
                ratio = _ratios.get((title, other))
                if ratio is None:
                    matcher = matcher or SequenceMatcher(None, "", other)
                    matcher.set_seq1(title)
                    ratio = _ratios[title, other] = matcher.ratio()
                near = ratio > alike
            if near:
                rows.append(i)
                cols.append(j)
    return rows, cols, [1.0] * len(rows)


def group_id(group: str) -> Column:
    """A group as text that is never null: rows without one form a group of their own."""
    return F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))


def blocked(one: DataFrame, other: DataFrame, compare: Callable[[list, list, np.ndarray], tuple[list, list, list]], block: int = BLOCK, later: bool = False) -> DataFrame:
    """_g, e, x and s of pairs of rows (_g, pos, title) that compare() finds, of one side and the other; later: the other's row comes behind. pos tells rows of a group apart."""
    sizes = lambda df, name: df.groupBy(F.col("_g").alias("_own")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    both = sizes(one, "_lefts").join(sizes(other, "_rights"), "_own")
    at = lambda n: F.expr(f"cast(pmod(xxhash64(pos), {n}) as int)")
    side = lambda df, left, mine, theirs, i, j: df.join(both, F.col("_g") == F.col("_own")).select("_g", "pos", "title", F.lit(left).alias("_left"), at(mine).alias(i), F.explode(F.expr(f"sequence(0, {theirs} - 1)")).alias(j))
    columns = ["_g", "pos", "title", "_left", "_i", "_j"]
    paired = side(one, True, "_lefts", "_rights", "_i", "_j").select(columns).union(side(other, False, "_rights", "_lefts", "_j", "_i").select(columns))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_left"]], pdf[~pdf["_left"]]
        e, x = a["pos"].to_numpy(), b["pos"].to_numpy()
        rows, cols, scores = compare([plain(t) for t in a["title"]], [plain(t) for t in b["title"]], np.searchsorted(e, x) if later else np.full(len(x), len(e)))
        return pd.DataFrame({"_g": pdf["_g"].iloc[0], "e": e[rows], "x": x[cols], "s": scores})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        return pd.concat([compared(own) for _, own in pdf.groupby(["_g", "_i", "_j"], sort=False)])

    n = both.agg(F.sum(F.col("_lefts").cast("bigint") * F.col("_rights"))).first()[0] or 0
    packed = in_packs(paired, n, BLOCKS_PACKED, "_g", "_i", "_j")
    return stored(packed.groupBy("_pack").applyInPandas(run, "_g string, e bigint, x bigint, s double"), "pairs")


def in_packs(df: DataFrame, n: int, size: int, *by: str) -> DataFrame:
    """df with `_pack`: small groups (n in all) by the size of a pack or so, since each call of Python costs as much as a small group; as many partitions as are set at the least. Adaptive
    execution would join partitions by their bytes, which say nothing of the work behind."""
    packs = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // size))
    return df.withColumn("_pack", F.pmod(F.xxhash64(*by), F.lit(packs))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_pack")


def apart(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of groups of few, and those of groups of many (None if there are none)."""
    large = pairs.groupBy("_g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("_g")
    if large.isEmpty():
        return pairs, None
    large = stored(large, "large-groups")
    return by_key(pairs, large, ["_g"], "left_anti"), by_key(pairs, large, ["_g"], "left_semi")


def listed(wanted: DataFrame, offered: DataFrame, least: float) -> DataFrame:
    """_g, c, x and s: for each title c of wanted (_g, c, title, k, s_last, x_last) the k best of offered (_g, pos, title, held) behind (s_last, x_last), of equals the first; without those held by one before c."""
    sizes = lambda df, n, name: df.groupBy(F.col("_g").alias("_own")).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    both = stored(sizes(wanted, EXPECTED, "_lefts").join(sizes(offered, OFFERED, "_rights"), "_own"), "sizes")
    at = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    sides = lambda df: df.join(both, F.col("_g") == F.col("_own"))
    left = sides(wanted).select("_g", at("c", "_lefts").alias("_i"), each("_rights").alias("_j"), F.lit(True).alias("_left"), F.col("c").alias("pos"), "title", "k", "s_last", F.col("x_last").alias("other"))
    right = sides(offered).select("_g", at("pos", "_rights").alias("_j"), each("_lefts").alias("_i"), F.lit(False).alias("_left"), "pos", "title", F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("s_last"), F.col("held").alias("other"))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_left"]], pdf[~pdf["_left"]].sort_values("pos", kind="stable")
        offers, pos, held, out = Offers([plain(t) for t in b["title"]]), b["pos"].to_numpy(), b["other"].to_numpy(), []
        for c, title, k, s_last, x_last in zip(a["pos"].tolist(), a["title"], a["k"].tolist(), a["s_last"].tolist(), a["other"].tolist(), strict=True):
            found = offers.best(plain(title), k, least, held >= c, lambda s, row, s_last=s_last, x_last=x_last: s < s_last or s == s_last and pos[row] > x_last)
            out += [(c, pos[row], -s) for s, row in found]
        out = pd.DataFrame(out, columns=["c", "x", "s"]).astype({"c": np.int64, "x": np.int64, "s": np.float64})
        return out.assign(_g=pdf["_g"].iloc[0])[["_g", "c", "x", "s"]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compared(own) for _, own in pdf.groupby(["_g", "_i", "_j"], sort=False)])

    n = both.agg(F.sum(F.col("_lefts").cast("bigint") * F.col("_rights"))).first()[0] or 0
    parts = in_packs(left.unionByName(right), n, BLOCKS_PACKED, "_g", "_i", "_j").groupBy("_pack").applyInPandas(run, "_g string, c bigint, x bigint, s double")
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_g", "c").orderBy(F.desc("s"), "x")))  # k rows of each block
    return stored(ranked.join(wanted.select(F.col("_g").alias("_own"), F.col("c").alias("_c"), "k"), (F.col("_g") == F.col("_own")) & (F.col("c") == F.col("_c"))).where("_rank <= k").select("_g", "c", "x", "s"), "lists")


_ROWS = "_g string, c bigint, e bigint, x bigint, s double"


def settled(members: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    """_g, c, e, x and s: in the order of e each member (_g, c, e) takes the first of the list of c (_g, c, x, s) that is left; those that get nothing aren't there.

    In rounds, for large groups: of the members of one c each asks for another of its list, the first member for the first; an x stays with the first that asks and turns all later ones down,
    for good. That is where the order leads too: what the first takes nobody can take from it.
    """

    def listing(pdf: pd.DataFrame) -> dict:
        own = pdf[pdf["_list"]].sort_values(["_g", "c", "s", "x"], ascending=[True, True, False, True], kind="stable")
        return {key: list(zip(x["x"].tolist(), x["s"].tolist(), x["e"].tolist(), strict=True)) for key, x in own.groupby(["_g", "c"], sort=False)}

    def asking(pdf: pd.DataFrame) -> zip:
        own = pdf[~pdf["_list"]].sort_values(["_g", "e"], kind="stable")
        return zip(own["_g"].tolist(), own["c"].tolist(), own["e"].tolist(), strict=True)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["_g", "c", "e", "x", "s"]).astype({"c": np.int64, "e": np.int64, "x": np.int64, "s": np.float64})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        lists, next_at, taken, out = listing(pdf), {}, set(), []
        for g, c, e in asking(pdf):
            own, at = lists.get((g, c), ()), next_at.get((g, c), 0)
            while at < len(own) and (g, own[at][0]) in taken:
                at += 1
            next_at[g, c] = at
            if at < len(own):
                taken.add((g, own[at][0]))
                out.append((g, c, e, *own[at][:2]))
        return frame(out)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        lists, next_at, out = listing(pdf), {}, []
        for g, c, e in asking(pdf):
            own, at = lists.get((g, c), ()), next_at.get((g, c), 0)
            while at < len(own) and own[at][2] < e:  # who holds it comes before
                at += 1
            if at < len(own):
                out.append((g, c, e, *own[at][:2]))
            next_at[g, c] = at + 1
        return frame(out)

    rows = members.select("_g", "c", "e", F.lit(0).cast("bigint").alias("x"), F.lit(0.0).alias("s"), F.lit(False).alias("_list")).unionByName(lists.select("_g", "c", F.lit(LAST).alias("e"), "x", "s", F.lit(True).alias("_list")))
    few, many = apart(rows, most)
    out = in_packs(few, few.count(), MOST, "_g").groupBy("_pack").applyInPandas(settle, _ROWS)
    if many is None:
        return out
    many, held = stored(many, "left"), None
    while True:
        known = many if held is None else many.drop("e").where("_list").join(held.select("_g", "x", "e"), ["_g", "x"], "left").withColumn("e", F.coalesce("e", F.lit(LAST))).unionByName(many.where("not _list"))
        asked = in_packs(known, known.count(), MOST, "_g", "c").groupBy("_pack").applyInPandas(ask, _ROWS)
        asked = stored(asked, "asked")
        held = stored(asked.groupBy("_g", "x").agg(F.min("e").alias("e"), F.count("*").alias("_n")), "held")
        if held.where("_n > 1").isEmpty():
            return out.unionByName(asked)


def assigned(expected: DataFrame, offered: DataFrame, least: float, most: int = MOST) -> DataFrame:
    """_g, e, x and s: in the order of pos each of expected (_g, pos, title) takes the most similar of offered that is left, if it is similar enough; of equals the first.

    Each distinct title c (the pos of its first row) has a list of the best, as long as it has rows and somewhat longer. Where rows come away empty from a list that may go on, it is continued and all is settled
    again; what one before c holds by then stays with it or with one before it, so the list leaves it out.
    """
    expected, offered = (df.where("pos is not null and title is not null") for df in (expected, offered))
    expected = expected.groupBy("_g", "pos").agg(F.min("title").alias("title"))  # what joins by pos can't tell rows of one pos apart
    classes = stored(expected.groupBy("_g", "title").agg(F.min("pos").alias("c"), F.count("*").alias("n")), "titles")
    key = lambda a, b: (F.col(f"{a}._g") == F.col(f"{b}._g")) & (F.col(f"{a}.title") == F.col(f"{b}.title"))
    members = stored(expected.alias("a").join(classes.alias("b"), key("a", "b")).select("a._g", "b.c", F.col("a.pos").alias("e")), "members")
    wanted = classes.select("_g", "c", "title", (F.col("n") + SPARE).alias("k"), F.lit(2.0).alias("s_last"), F.lit(FIRST).alias("x_last"))
    lists, told, spare, free = None, wanted.select("_g", "c", "k"), SPARE, offered.withColumn("held", F.lit(LAST))
    while True:
        more = listed(wanted, free, least)
        lists = more if lists is None else lists.unionByName(more)
        taken = stored(settled(members, lists, most), "taken")
        empty = members.join(taken.select("_g", "e"), ["_g", "e"], "left_anti").groupBy("_g", "c").agg(F.count("*").alias("n"))
        ends = lists.groupBy("_g", "c").agg(F.count("*").alias("_length"), F.max(F.struct((-F.col("s")).alias("s"), "x")).alias("last"))
        short = empty.join(ends, ["_g", "c"]).join(told.groupBy("_g", "c").agg(F.sum("k").alias("_asked")), ["_g", "c"]).where("_length >= _asked")
        spare = min(4 * spare, MOST_SPARE)
        wanted = stored(short.join(classes.drop("n"), ["_g", "c"]).select("_g", "c", "title", (F.col("n") + spare).alias("k"), (-F.col("last.s")).alias("s_last"), F.col("last.x").alias("x_last")), "wanted")
        if wanted.isEmpty():
            return taken.select("_g", "e", "x", "s")
        told = told.unionByName(wanted.select("_g", "c", "k"))
        free = offered.join(taken.select("_g", F.col("x").alias("pos"), F.col("e").alias("held")), ["_g", "pos"], "left").withColumn("held", F.coalesce("held", F.lit(LAST)))


def bases(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """_g, x and e: rows that repeat an earlier one, with the first base that they repeat. A row that repeats no base is one.

    In rounds: a row that repeats a known base is none; one whose earlier rows are all known as none is a base.
    """

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_g", "x", "e"], kind="stable").drop(columns="_pack")
        none, last, keep = set(), None, []
        for k, (g, x, e) in enumerate(zip(pdf["_g"].tolist(), pdf["x"].tolist(), pdf["e"].tolist(), strict=True)):
            if (g, x) != last and (g, e) not in none:
                none.add((g, x))
                last = g, x
                keep.append(k)
        return pdf.iloc[keep]

    few, many = apart(pairs, most)
    out = in_packs(few, few.count(), MOST, "_g").groupBy("_pack").applyInPandas(settle, pairs.schema).select("_g", "x", "e")
    if many is None:
        return out
    left, found = stored(many.select("_g", "e", "x"), "left"), None
    while not left.isEmpty():
        # Of the rows that an open row may repeat those are bases for sure which have no earlier row left to repeat.
        open_rows = left.select("_g", F.col("x").alias("e")).distinct()
        sure = left.select("_g", "e").distinct().join(open_rows, ["_g", "e"], "left_anti")
        marked = left.join(sure.withColumn("_base", F.lit(True)), ["_g", "e"], "left")
        # Settled once the first row that it may still repeat is a base; rows that can't come first for anything any more go.
        first = marked.groupBy("_g", "x").agg(F.min("e").alias("_least"), F.min(F.when(F.col("_base"), F.col("e"))).alias("_base_at"))
        first = stored(first, "first")
        done = first.where("_least = _base_at").select("_g", "x", F.col("_base_at").alias("e"))
        found = done if found is None else found.unionByName(done)
        # A row with a known base repeats something: as an earlier row it drops out for others, as a later one only rows before that base matter.
        repeat = first.where("_base_at is not null").select("_g", F.col("x").alias("e"))
        rest = left.join(first, ["_g", "x"]).where("_base_at is null or (_least < _base_at and e <= _base_at)").select("_g", "e", "x")
        left = stored(rest.join(repeat, ["_g", "e"], "left_anti"), "left")
    return out if found is None else out.unionByName(found)
