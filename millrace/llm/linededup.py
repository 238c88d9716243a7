"""Line dedup by a segment-partition edit join (operator 1), in DataFrame operations alone.

Lines are the texts' parts between line feeds, without blanks at either end; blank ones don't count. Exact copies are one
line. Two lines link when at most as many edits apart as the shorter one allows: one for every PER_EDIT of its characters, EDITS at the most
(so a line of fewer characters links with nothing but its exact copies). Each line is cut into
one segment more than it allows edits, of even length, of which at least one stays whole in any line so near. Segments are indexed by
line length, number and content; a line probes, for every length that a shorter or equal partner may have, only the
substrings at the offsets that edits on both sides of the segment allow. Candidates have their common ends
cut off and the rest is verified by an automaton over the band of diagonals, whose states are bits.

Near lines form classes (connected components), whose first line by doc_id, text and place is kept. Classes grow in three steps: a line is
compared with one indexed line of each key it probes, then with one of another class of each key that still has several, and last
the few keys left open are compared in full, between classes only; so a crowd of near lines never makes all pairs for its class. Links are
counted apart from that, all of them: every line is compared with all lines of each key, whatever their class, and only the counts are stored.

Null and empty texts have no lines and get a row with zeros; rows that repeat both doc_id and text are one document. An empty
table gives no rows. Lines are told apart by 128-bit hashes (64-bit ones only propose candidates). Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, stored

EDITS = 2
PER_EDIT = 6


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_id(line: str) -> Column:
    return F.unhex(F.md5(line))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, place, line of every line; documents without lines have one row with null line."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(lines_of(F.col("text"))).alias("place", "line"))


def places(most: int) -> list[tuple[int, int, int]]:
    """(shorter, number, move): segments of partners so much shorter that a line may hold, moved so far, for any number of edits up to `most`."""
    out = set()
    for edits in range(1, most + 1):
        for shorter in range(edits + 1):
            for number in range(edits + 1):
                left, right = number, edits - number  # edits that may lie before and behind the segment
                out |= {(shorter, number, move) for move in range(max(-left, shorter - right), min(left, shorter + right) + 1)}
    return sorted(out)


def keys_at(lines: DataFrame, at: list[tuple[int, int, int]], most: int, per_edit: int) -> DataFrame:
    """code, key and own of the substrings of lines (code, n, wide) at the given places; `own` marks a line's own segments, under which it is indexed.

    The places are rows and their key is one short expression, so that all of it is compiled. `wide` has four bytes for each character, so that a
    substring is found without reading the line from its beginning.
    """
    c, here = F.col, F.array(*(F.struct(*(F.lit(v).alias(name) for v, name in zip(one, ("shorter", "number", "move"), strict=True))) for one in at))
    rows = lines.select("code", "n", "wide", F.inline(here)).withColumn("length", c("n") - c("shorter")).where(c("length") >= per_edit)
    rows = rows.withColumn("edits", F.least(F.lit(most), F.floor(c("length") / per_edit).cast("int")))
    left, right = c("number"), c("edits") - c("number")
    rows = rows.where((right >= 0) & (c("shorter") <= c("edits")) & c("move").between(F.greatest(-left, c("shorter") - right), F.least(left, c("shorter") + right)))
    # Segments are of even length; the last ones, from `longer` on, take what is left over.
    rows = rows.withColumn("size", F.floor(c("length") / (c("edits") + 1)).cast("int")).withColumn("longer", c("edits") + 1 - c("length") % (c("edits") + 1))
    rows = rows.withColumn("start", c("size") * c("number") + F.greatest(F.lit(0), c("number") - c("longer")) + c("move")).withColumn("size", c("size") + (c("number") >= c("longer")).cast("int"))
    rows = rows.where((c("start") >= 0) & (c("start") + c("size") <= c("n")))
    key = F.xxhash64("number", "length", F.substring("wide", c("start") * 4 + 1, c("size") * 4))
    return rows.select("code", key.alias("key"), ((c("shorter") == 0) & (c("move") == 0)).alias("own"))


def long_lines(docs: DataFrame, per_edit: int) -> DataFrame:
    """line and code (a 64-bit hash) of all lines that may link, repeated ones too."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).where(F.length("line") >= per_edit)
    return lines.withColumn("code", F.xxhash64("line"))


def meetings(docs: DataFrame, most: int, per_edit: int) -> DataFrame:
    """key, own and code of the lines that meet another line under a key, with the lowest and highest code indexed there.

    The index goes in with one row for each key, so a key of many lines makes no pairs here.
    """
    lines = long_lines(docs, per_edit).select("code", F.length("line").alias("n"), F.encode("line", "UTF-32").alias("wide"))
    index = keys_at(lines, [p for p in places(most) if p[0] == p[2] == 0], most, per_edit).groupBy("key").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    probe = keys_at(lines, places(most), most, per_edit)
    # Repeated lines are dropped behind the join, so that a key of a very common line can be split before it.
    met = stored(probe.join(index.hint("shuffle_hash"), "key").where("code != low or code != high"), "line-meetings")
    return met.groupBy("key", "code").agg(F.max("own").alias("own"), F.min("low").alias("low"), F.max("high").alias("high"))


#: Indexed lines of a key that are compared under one join key. Those of larger keys are dealt over blocks, and each block meets all lines of the key.
BLOCK = 1024

#: Up to so many codes of lines that meet others are broadcast (16 MB of them); more are joined by a shuffle of all lines.
MOST_BROADCAST = 2_000_000


def odd_bits(hashes: Column) -> Column:
    """64 bits: which of the numbers 0 to 63 stand in hashes an odd number of times; other numbers don't count."""
    one = lambda h: F.when(h.between(0, 63), F.call_function("shiftleft", F.lit(1).cast("bigint"), h)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda bits, h: bits.bitwiseXOR(one(h)))


def signature(line: str) -> Column:
    """Struct of which characters, and which pairs of neighbours, stand in the line an odd number of times, by hashes of 64 and 128 values."""
    bucket = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")

    def bits(chars: Column) -> Column:
        pairs = F.transform(chars, lambda c, i: bucket(F.concat(c, F.coalesce(F.get(chars, i + 1), F.lit(""))), 128))
        return F.struct(odd_bits(F.transform(chars, lambda c: bucket(c, 64))).alias("chars"), odd_bits(pairs).alias("pairs"), odd_bits(F.transform(pairs, lambda h: h - 64)).alias("more"))

    return let(F.split(line, ""), bits)


def may_link(a: Column, b: Column, edits: int) -> Column:
    """Whether two signatures may be so few edits apart: an edit changes two characters and four pairs at most."""
    differ = lambda name: F.bit_count(a[name].bitwiseXOR(b[name]))
    return (differ("chars") <= 2 * edits) & (differ("pairs") + differ("more") <= 4 * edits)


def apart(a: Column, b: Column, edits: int, by: str = "part") -> Column:
    """Whether two places (structs of part, id and signature) lie in different parts (or, by id, are different lines) and may link."""
    return (a[by] != b[by]) & may_link(a["signature"], b["signature"], edits)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def common_start(a: Column, b: Column) -> Column:
    """Characters that both strings begin with, found by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))
    least = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= least) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step)), at + step).otherwise(at))


def band_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of arrays of characters whose sizes differ by at most `edits`, if it is at most `edits`; else edits + 1.

    Bit k + edits of state d says that with d edits as many characters of a are read as of b, plus k. One step reads one character of b.
    """
    full = (1 << (2 * edits + 1)) - 1
    names = [f"s{d}" for d in range(edits + 1)]
    begin = F.struct(*(F.lit(sum(1 << (edits + k) for k in range(d + 1))).alias(names[d]) for d in range(edits + 1)))

    def masks(padded: Column) -> Column:
        """For each character of b, which of the characters of a that the band lets it meet are equal to it."""
        def one(char: Column, j: Column) -> Column:
            bits = [F.when(F.get(padded, j + i) == char, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(2 * edits + 1)]
            return reduce(lambda x, y: x.bitwiseOR(y), bits)

        return F.transform(b, one)

    def step(acc: Column, hit: Column) -> Column:
        out = [acc[names[0]].bitwiseAND(hit)]
        for before, name in zip(names, names[1:], strict=False):
            was, new = acc[before], out[-1]
            out.append(acc[name].bitwiseAND(hit).bitwiseOR(was).bitwiseOR(F.shiftright(was, 1)).bitwiseOR(F.shiftleft(new, 1).bitwiseAND(F.lit(full))))
        # The last state holds all that the others hold: when it is empty, nothing is left to do.
        return F.when(acc[names[-1]] == 0, acc).otherwise(F.struct(*(v.alias(n) for v, n in zip(out, names, strict=True))))

    def finish(acc: Column) -> Column:
        end, out = F.lit(edits) + F.size(a) - F.size(b), F.lit(edits + 1)
        for d in range(edits, -1, -1):
            out = F.when(F.call_function("shiftright", acc[names[d]], end).bitwiseAND(F.lit(1)) == 1, F.lit(d)).otherwise(out)
        return out

    pad = F.array(*[F.lit("")] * edits)
    return let(F.concat(pad, a, pad), lambda padded: F.aggregate(masks(padded), begin, step, finish))


def distance(left: Column, right: Column, edits: int) -> Column:
    """Edit distance of two strings up to `edits`, else edits + 1: their common ends are cut off first."""
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    chars = lambda x: F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.lit([]).cast("array<string>"))
    rest = lambda x, at: F.substring(x, at + 1, F.length(x))

    def middle(p: Column) -> Column:
        return F.when(F.abs(F.length(p["x"]) - F.length(p["y"])) > edits, F.lit(edits + 1)).otherwise(let(pair(chars(p["x"]), chars(p["y"])), lambda c: band_distance(c["x"], c["y"], edits)))

    def cut(p: Column, then: Callable[[Column], Column]) -> Column:
        return let(common_start(p["x"], p["y"]), lambda at: let(pair(rest(p["x"], at), rest(p["y"], at)), then))

    return let(pair(left, right), lambda p: cut(p, lambda q: let(pair(F.reverse(q["x"]), F.reverse(q["y"])), lambda r: cut(r, middle))))


def verified(pairs: DataFrame, texts: DataFrame, most: int, per_edit: int) -> DataFrame:
    """Those of the pairs (a, b) of line ids that link, with their distance."""
    sides = [texts.select(F.col("id").alias(name), F.col("line").alias(line)) for name, line in (("a", "left"), ("b", "right"))]
    told = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", distance(F.col("left"), F.col("right"), most).alias("distance"), F.least(F.length("left"), F.length("right")).alias("n"))
    return told.where(F.col("distance") <= F.least(F.lit(most), F.floor(F.col("n") / per_edit))).drop("n")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Meetings:
    """The lines of docs that meet others under a key, and the candidates among them."""

    def __init__(self, docs: DataFrame, most: int, per_edit: int) -> None:
        self.most, self.per_edit = most, per_edit
        self.met = stored(meetings(docs, most, per_edit), "line-meetings")
        codes = self.met.select("code").union(self.met.select("low")).union(self.met.select("high")).distinct()
        codes = stored(codes, "line-codes")
        codes = F.broadcast(codes) if codes.count() <= MOST_BROADCAST else codes.hint("merge")
        texts = long_lines(docs, per_edit).join(codes, "code", "left_semi").groupBy("code", "line").agg(F.count("*").alias("times"))
        self.texts = stored(texts.select("code", line_id("line").alias("id"), "line", signature("line").alias("signature")), "line-texts")

    def first_pairs(self) -> DataFrame:
        """Each line with one line that is indexed under each of its keys."""
        pairs = self.met.select("code", F.when(F.col("code") != F.col("low"), F.col("low")).otherwise(F.col("high")).alias("other")).distinct()
        one = self.texts.select("code", F.struct("id", "signature").alias("x"))
        other = self.texts.select(F.col("code").alias("other"), F.struct("id", "signature").alias("y"))
        near = pairs.join(one, "code").join(other, "other").where(may_link(F.col("x")["signature"], F.col("y")["signature"], self.most) & (F.col("x")["id"] != F.col("y")["id"]))
        return near.select(*ordered(F.col("x")["id"], F.col("y")["id"])).distinct()

    def placed(self, parts: DataFrame | None) -> DataFrame:
        """key, own and place (part, id, signature) of all lines of a key; without parts (node, component) each line is its own part."""
        nodes = self.texts.select("code", "id", "signature")
        nodes = nodes.withColumn("part", F.col("id")) if parts is None else nodes.join(parts, nodes["id"] == parts["node"], "left").withColumn("part", F.coalesce("component", "id"))
        nodes = nodes.select("code", F.struct("part", "id", "signature").alias("place"))
        rows = F.array(F.struct("own", "code"), F.struct(F.lit(True).alias("own"), F.col("low").alias("code")))
        return self.met.select("key", F.inline(rows)).groupBy("key", "code").agg(F.max("own").alias("own")).join(nodes, "code").select("key", "own", "place")

    def next_pairs(self, placed: DataFrame) -> DataFrame:
        """Each line with one line of another part that is indexed under each of its keys."""
        far = F.when(F.col("first")["part"] != F.col("place")["part"], F.col("first")).otherwise(F.col("last"))
        pairs = placed.join(mixed_keys(placed), "key").where(apart(F.col("place"), far, self.most))
        return pairs.select(*ordered(F.col("place")["id"], far["id"])).distinct()

    def all_pairs(self, placed: DataFrame, by: str = "part", block: int = BLOCK) -> DataFrame:
        """All lines of a key with all lines of another part (by id: all other lines) that are indexed under it."""
        keys = placed.groupBy("key").agg(F.ceil(F.count_if("own") / block).alias("blocks"))
        open_ = placed.join(keys if by == "id" else keys.join(mixed_keys(placed), "key", "left_semi"), "key")
        indexed = open_.where("own").select("key", F.pmod(F.xxhash64("place.id"), "blocks").alias("block"), F.col("place").alias("indexed"))
        probes = open_.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "place")
        pairs = indexed.join(probes, ["key", "block"]).where(apart(F.col("place"), F.col("indexed"), self.most, by))
        return pairs.select(*ordered(F.col("place")["id"], F.col("indexed")["id"])).distinct()

    def direct(self, placed: DataFrame, block: int = BLOCK) -> DataFrame:
        """id and direct (the other lines that it links with) of every line that has links; neither pairs nor links are stored."""
        links = verified(self.all_pairs(placed, "id", block), self.texts, self.most, self.per_edit)
        return stored(links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("direct")), "line-direct")

    def classes(self) -> DataFrame:
        """node and component (its class) of every line id that links with another; made from a few links for each line."""
        edges = self.links(self.first_pairs()).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        for pairs in (self.next_pairs, self.all_pairs):
            placed = stored(self.placed(stored(connected_components(edges), "line-parts")), "line-placed")
            edges = edges.union(self.links(pairs(placed)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        return connected_components(edges)

    def links(self, pairs: DataFrame) -> DataFrame:
        return stored(verified(stored(pairs, "line-pairs"), self.texts, self.most, self.per_edit), "line-links")


def mixed_keys(placed: DataFrame) -> DataFrame:
    """The keys under which lines of several parts meet, with the indexed line of the lowest and of the highest part."""
    indexed, part = F.when(F.col("own"), F.col("place")), F.col("place")["part"]
    ends = placed.groupBy("key").agg(F.min(indexed).alias("first"), F.max(indexed).alias("last"), F.min(part).alias("lowest"), F.max(part).alias("highest"))
    return ends.where((F.col("lowest") != F.col("last")["part"]) | (F.col("highest") != F.col("first")["part"]))


def near_lines(docs: DataFrame, most: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """All links (a, b, distance) between ids of distinct lines. Their number grows with the square of a crowd; near_classes() doesn't make them."""
    found = Meetings(docs, most, per_edit)
    return found.links(found.all_pairs(stored(found.placed(None), "line-placed"), "id"))


def near_classes(docs: DataFrame, most: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """Meetings.classes() of the lines of docs."""
    return Meetings(docs, most, per_edit).classes()


def dedup_lines(docs: DataFrame, most: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """One row for each line: doc_id, text_hash, place, class_id, kept, exact (it repeats a line to the letter), head (the class's first line, null for a line
    that no other repeats), linked (the other distinct lines of its class) and direct (those of them that it links with itself); place is null for a document
    without lines."""
    found = Meetings(docs, most, per_edit)
    parts, direct = found.classes(), found.direct(stored(found.placed(None), "line-placed"))
    seen = stored(occurrences(docs).select("doc_id", "text_hash", "place", line_id("line").alias("id")), "line-places")
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "place")
    own = seen.where("id is not null").groupBy("id").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    placed = own.join(parts, own["id"] == parts["node"], "left").select("id", "first", "n", F.coalesce("component", "id").alias("class_id"))
    heads = placed.groupBy("class_id").agg(F.min("first").alias("head"), F.sum("n").alias("members"), F.count("*").alias("lines")).where("members > 1")
    classes = placed.join(heads, "class_id").select("id", "class_id", "first", "head", (F.col("lines") - 1).alias("linked")).join(direct, "id", "left")
    joined = seen.join(classes, "id", "left")
    kept, exact = F.col("head").isNull() | (F.col("head") == here), F.col("first").isNotNull() & (F.col("first") != here)
    return joined.select("doc_id", "text_hash", "place", F.coalesce("class_id", "id").alias("class_id"), kept.alias("kept"), exact.alias("exact"), "head", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("linked", "direct")))


def report(docs: DataFrame, most: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """One row for each document.

    doc_id, n_lines, n_exact and n_near (lines dropped as copies to the letter, and as near), dropped (their places), classes (of its lines that others repeat,
    the kept ones too: class_id and the doc_id of the class's first line, in order), n_links (other distinct lines that its lines reach by links, summed over its lines), n_direct_links (those that are few enough edits from the line itself,
    summed likewise) and text_hash.
    """
    lines = dedup_lines(docs, most, per_edit)
    shared = F.struct(F.lower(F.hex("class_id")).alias("class_id"), F.col("head")["doc_id"].alias("head_doc"))
    sets = {"lines": F.when(F.col("place").isNotNull(), F.col("place")), "dropped": F.when(~F.col("kept"), F.col("place")), "same": F.when(~F.col("kept") & F.col("exact"), F.col("place")), "classes": F.when(F.col("head").isNotNull(), shared)}
    links = F.struct("place", "linked", "direct")
    one = lines.groupBy("doc_id", "text_hash").agg(*(F.array_sort(F.collect_set(c)).alias(name) for name, c in sets.items()), F.collect_set(F.when(F.col("linked") > 0, links)).alias("links"))
    count = lambda c: F.size(c).cast("bigint")
    total = lambda c: F.aggregate("links", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x[c])
    return one.select(
        "doc_id",
        count("lines").alias("n_lines"),
        count("same").alias("n_exact"),
        (count("dropped") - count("same")).alias("n_near"),
        "dropped",
        "classes",
        total("linked").alias("n_links"),
        total("direct").alias("n_direct_links"),
        "text_hash",
    )


def kept_texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs with text cut down to its kept lines (the result of dedup_lines for them); other columns stay, whatever their names."""
    gone = lines.where("not kept").groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(gone, F.col("row.doc_id").eqNullSafe(gone["doc_id"]) & (F.xxhash64("row.text") == gone["text_hash"]), "left")
    left = F.array_join(F.filter(lines_of(F.col("row.text")), lambda x, i: ~F.array_contains("places", i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(left)
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
