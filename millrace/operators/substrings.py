"""Joins by what texts hold (JOIN-18, JOIN-20, JOIN-22): stretches of texts that may be patterns are cut out and joined as they are, so no task compares all texts with all patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.functions import urls
from millrace.operators.ranges import stored


#: Values by which the hash of a stretch of bytes is made: of single bytes, and factors that join two halves, or the beginning and the end of a pattern.
_DICE = np.random.default_rng(20)
_BYTES = _DICE.integers(0, 2**64, 256, np.uint64)
_HALVES, _ENDS, _WHOLE = _DICE.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of texts that are hashed at a time, bits for each pattern in the filter and bits of a filter at the most (32 MB).
PIECE, BITS_EACH, MOST_BITS = 2 << 20, 32, 1 << 28


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashes(data: np.ndarray, upto: int) -> Iterator[tuple[int, np.ndarray]]:
    """For 1, 2, 4, ... bytes (upto at the most) the hashes of all stretches of so many."""
    size, k, h = 1, 0, _BYTES[data]
    while True:
        yield size, h
        if size * 2 > upto or len(h) <= size:
            return
        h = h[:-size] * _HALVES[k] + h[size:]
        size, k = size * 2, k + 1


def whole(h: np.ndarray, at: np.ndarray, size: int, length: int) -> np.ndarray:
    """Hashes of stretches of `length` bytes, of those of their first and last `size` bytes."""
    return (h[at] * _ENDS + h[at + (length - size)] + np.uint64(length)) * _WHOLE


def bit_of(h: np.ndarray, size: int, bits: int) -> np.ndarray:
    return ((h ^ np.uint64(size)) * _ENDS) >> np.uint64(64 - bits.bit_length() + 1)


def pattern_bits(patterns: pa.Array, bits: int) -> np.ndarray:
    """For each pattern two bits: of its beginning, as long as a power of two allows, and of all of it."""
    data, offsets = laid_out(patterns)
    lengths, out = np.diff(offsets), []
    for size, h in hashes(data, int(lengths.max(initial=1))):
        for length in np.unique(lengths[(lengths >= size) & (lengths < 2 * size)]).tolist():
            at = offsets[:-1][lengths == length]
            out += [bit_of(h[at], size, bits), bit_of(whole(h, at, size, length), 0, bits)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_hits(data: np.ndarray, offsets: np.ndarray, lengths: list[int], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and length of stretches that are patterns by the filter: all that are, and few others."""
    bits, out = len(known) * 8, []
    has = lambda bit: (known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
    for size, h in hashes(data, lengths[-1]):
        mine = [n for n in lengths if size <= n < 2 * size]
        if not mine:
            continue
        at = np.flatnonzero(has(bit_of(h, size, bits)))
        row = np.searchsorted(offsets, at, "right") - 1
        for length in mine:
            some = at + length <= offsets[row + 1]
            here, own = at[some], row[some]
            good = has(bit_of(whole(h, here, size, length), 0, bits))
            out.append((own[good], here[good], np.full(int(good.sum()), length)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of PIECE bytes or so, or one row."""
    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, upto
        at = upto


def pattern_filter(named: DataFrame, pattern: str, n: int) -> np.ndarray:
    """Bytes of a filter of patterns, put together by words so that the driver holds no pattern."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_EACH * n - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = pattern_bits(batch.column(0), bits)
            word, group = np.unique(bit >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, group, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    told = named.select(pattern).mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[told["word"].to_numpy()] = told["bits"].to_numpy()
    return out.view(np.uint8)


def holding(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, *keys: tuple[str, str]) -> DataFrame:
    """text, pattern: distinct pairs in which the text holds the pattern; with keys (a column of texts and one of patterns), those that agree in them, and the columns of patterns. Null and empty patterns are in nothing.

    Texts are cut where a filter of all patterns says that one may stand, and what is cut out is joined by its bytes: the work follows the length of the texts and what they hold, however many patterns there are."""
    theirs = [b for _, b in keys]
    named = patterns.select(F.col(pattern).alias("pattern"), *(F.col(b) for b in theirs)).where("pattern <> ''").distinct()
    named = stored(named, "patterns")
    told = texts.select(F.col(text).alias("text"), *(F.col(a).alias(b) for a, b in keys)).where("text <> ''")
    lengths = sorted(r[0] for r in named.select(F.octet_length("pattern")).distinct().collect())
    if not lengths:
        return told.select("text", F.col("text").alias("pattern"), *theirs).limit(0)
    known = texts.sparkSession.sparkContext.broadcast(pattern_filter(named, "pattern", named.count()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = laid_out(batch.column(0))
            for at, upto in pieces(offsets):
                own = data[offsets[at] : offsets[upto]]
                row, place, size = text_hits(own, offsets[at : upto + 1] - offsets[at], lengths, known.value)
                view = memoryview(own)
                parts = pa.array([bytes(view[p : p + n]) for p, n in zip(place.tolist(), size.tolist(), strict=True)], pa.binary())
                taken = batch.take(pa.array(row + at))
                yield pa.RecordBatch.from_arrays([*taken.columns, parts], [*batch.schema.names, "part"])

    found = told.mapInArrow(cut, StructType([*told.schema.fields, StructField("part", BinaryType())]))
    joined = found.join(named.withColumnsRenamed({b: f"_own_{b}" for b in theirs}), [F.col("part") == F.col("pattern").cast("binary"), *(F.col(b) == F.col(f"_own_{b}") for b in theirs)])
    return joined.select("text", "pattern", *theirs).distinct()


def services(requests: DataFrame, hosts: DataFrame, key: str, url: str) -> DataFrame:
    """JOIN-20: for each key the providers (hosts: pattern, provider, category) one of whose patterns a requested host holds, once each; of several categories the first by name."""
    asked = requests.select(key, urls.host(url).alias("host")).distinct()
    pairs = holding(asked, "host", hosts, "pattern")
    known = asked.join(pairs, F.col("host") == F.col("text")).select(key, "pattern").distinct().join(hosts, "pattern")
    return known.groupBy(key, "provider").agg(F.min("category").alias("category"))


def erase_shops(gone: DataFrame, products: DataFrame, profiles: DataFrame, progress: DataFrame, letters: DataFrame) -> dict[str, DataFrame]:
    """JOIN-22: what is left when shops (shop_id: normalized addresses) go: products and profiles by their shop_id, progress by its normalized shop_url, dead letters by a shop_id anywhere in their `body`. Nulls stay."""
    shops = gone.select(urls.normalized("shop_id").alias("_gone")).where("_gone <> ''").distinct()
    held = holding(letters, "body", shops, "_gone").select(F.col("text").alias("_gone")).distinct()
    return {
        "products": products.join(shops, F.col("shop_id") == F.col("_gone"), "left_anti"),
        "profiles": profiles.join(shops, F.col("shop_id") == F.col("_gone"), "left_anti"),
        # Normalized before the join, which would do it again for each comparison of its sort.
        "progress": progress.withColumn("_place", urls.normalized("shop_url")).join(shops, F.col("_place") == F.col("_gone"), "left_anti").drop("_place"),
        "letters": letters.join(held, F.col("body") == F.col("_gone"), "left_anti"),
    }


def patch_places(own: DataFrame, useful: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """For each shop and key (own: shop_id, match_key) that changes find, how many do and of each column the last of them with its pos (_column, null if none changes it); and the pos of all changes that find one.

    A change finds its own shop with its key, else all shops with its key whose shop_id holds its domain (its % and _ are wildcards). Changes of one place are summed up here, so that nothing grows with changes times products."""
    summed = [F.count("*").alias("_changes"), *(F.max_by(F.struct("pos", F.col(c).alias("value")), F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in columns)]
    named = own.select("shop_id", F.col("match_key").alias("_key"))
    exact = useful.join(named, (F.col("shop") == F.col("shop_id")) & (F.col("match_key") == F.col("_key")), "left_semi")
    exact = stored(exact, "exact-changes")
    rest = stored(useful.join(exact.select("pos").distinct(), "pos", "left_anti"), "other-changes")
    by_domain = stored(rest.groupBy("domain", "match_key").agg(*summed), "domains")
    wild = (F.col("domain") == "") | F.col("domain").rlike(r"[%_\\]")
    held = holding(named, "shop_id", by_domain.where(~wild), "domain", ("_key", "match_key")).select(F.col("text").alias("shop_id"), F.col("pattern").alias("domain"), "match_key")
    like = by_domain.where(wild).join(named, (F.col("match_key") == F.col("_key")) & F.like(F.col("shop_id"), F.concat(F.lit("%"), "domain", F.lit("%")))).select("shop_id", "domain", "match_key")
    loose = stored(held.unionByName(like), "shops-of-domains")
    places = exact.groupBy(F.col("shop").alias("shop_id"), "match_key").agg(*summed).unionByName(loose.join(by_domain, ["domain", "match_key"]).drop("domain"))
    places = places.groupBy("shop_id", "match_key").agg(F.sum("_changes").alias("_changes"), *(F.max_by(f"_{c}", F.col(f"_{c}.pos")).alias(f"_{c}") for c in columns))
    found = exact.select("pos").unionByName(rest.join(loose, ["domain", "match_key"], "left_semi").select("pos"))
    return places, found


def patch_shops(products: DataFrame, changes: DataFrame, identity: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """JOIN-18: products (identity, shop_id, match_key, columns) after changes (pos, shop, domain, match_key, columns; nulls change nothing, of two changes of a column the later stands), and the counts matched, not_found, invalid (no key, or nothing to change) and total."""
    useful = changes.where((F.col("match_key") != "") & F.expr(" or ".join(f"`{c}` is not null" for c in columns)))
    useful = stored(useful.select("pos", "shop", "domain", "match_key", *columns), "changes")
    own = stored(products.where("match_key <> '' and shop_id is not null").groupBy("shop_id", "match_key").agg(F.count("*").alias("_products")), "places")
    places, found = patch_places(own, useful, columns)
    places = stored(places, "patches").withColumnsRenamed({"shop_id": "_shop", "match_key": "_key"})
    hits = products.select(F.col(identity).alias("_id"), "shop_id", "match_key").join(places, (F.col("shop_id") == F.col("_shop")) & (F.col("match_key") == F.col("_key")))
    last = hits.groupBy("_id").agg(*(F.max_by(f"_{c}", F.col(f"_{c}.pos")).alias(f"_{c}") for c in columns))
    joined = products.join(last, F.col(identity) == F.col("_id"), "left")
    patched = joined.select(*(F.coalesce(f"_{c}.value", c).alias(c) if c in columns else F.col(c) for c in products.columns))
    matched = places.join(own, (F.col("_shop") == F.col("shop_id")) & (F.col("_key") == F.col("match_key"))).agg(F.coalesce(F.sum(F.col("_changes") * F.col("_products")), F.lit(0)).alias("matched"))
    counts = changes.agg(F.count("*").alias("total")).join(F.broadcast(useful.agg(F.count("*").alias("useful")))).join(F.broadcast(found.agg(F.count_distinct("pos").alias("found")))).join(F.broadcast(matched))  # one row each
    return patched, counts.select("matched", (F.col("useful") - F.col("found")).alias("not_found"), (F.col("total") - F.col("useful")).alias("invalid"), "total")
