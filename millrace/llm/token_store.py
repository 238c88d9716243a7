"""Token ids in binary shards, with a minimal perfect hash index for keyed access (operator 2).

Layout under one folder of the shared store:

* `shard-*.ids`: 16 bytes of head (`TOKS`, version, bytes per id, zero), then the raw
  little-endian ids of documents in ascending key order. An id takes 2 bytes where
  the vocabulary has at most 65,536 ids, else 4.
* `index-*.mph`: for one part of the keys, a cascade of bit arrays that gives each key a
  slot of its own with no slot to spare, and for each slot a 32-bit fingerprint, the shard,
  the offset in ids and the count.
* `entries`, `shards`, `parts`: tables that name the files that count. Tasks that are run again
  write under new names, so a lost executor leaves files that no table names.

A key is (doc_id, occurrence): rows that repeat a doc_id are kept, ordered by their text, and
numbered from 0. Null doc_id is a key like any other and comes first. Null text is empty: such a
document has the end id alone. An empty table gives no shard and no rows. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytewords import mix, slices, text_bytes
from millrace.llm.common import tidied
from millrace.session import fresh_dir

#: Fixed value: the pattern by which byte-level tokenizers of this kind split texts.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD, HEAD_BYTES = "<4sIII", 16
NO_KEY = "doc_id bigint, occurrence int"


def open_store(path: str):
    """File system and path of a URI, for tasks as well as the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer of the tokenizers library.

    The tokenizer always breaks before a blank that a non-blank follows, so texts are cut there; each
    distinct cut is split into the tokenizer's words, and each distinct word is merged once by the library's
    model. Texts in which a blank meets another white space or the end, or that hold a token added to the vocabulary, go to the
    tokenizer whole. `most` bounds the cuts remembered. With `special` the special tokens that a text spells out
    get their own ids, as the library gives them by default; without it they are text like any other.
    """

    def __init__(self, path: str, special: bool = False, most: int = 400_000) -> None:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.added = "|".join(map(re.escape, added))
        self.split = regex.compile(BYTE_LEVEL_WORDS).findall
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # other bytes are written as characters from 256 on
        others = (b for b in range(256) if b not in plain)
        names = {b: chr(256 + i) for i, b in enumerate(others)}
        self.letters = [names.get(b, chr(b)) for b in range(256)]
        self.most = most
        self.clear()

    def clear(self) -> None:
        #: Cuts that follow a blank (without it), and as 1-tuples those that begin a text.
        self.known: dict[str | tuple[str], int] = {}
        self.words: dict[str, bytes] = {}  # ids of the tokenizer's words, 4 bytes each
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.used = 0

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row and the count of each, by the tokenizer itself."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def remember(self, cuts: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(cuts) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first + 1 : first + 1 + len(cuts)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.known.update(zip(cuts, range(first, first + len(cuts)), strict=True))

    def word_ids(self, word: str) -> bytes:
        """Ids of one word of the tokenizer's own splitting, by its merges."""
        got = self.words.get(word)
        if got is None:
            letters = word.replace(" ", "\u0120") if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
            got = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return got

    def learn(self, cuts: list[str | tuple[str]]) -> None:
        get, split, own = self.words.get, self.split, self.word_ids
        out = bytearray()
        sizes = []
        for x in cuts:
            text = x[0] if x.__class__ is tuple else " " + x
            before = len(out)
            if x.__class__ is str and x.isalpha():
                out += get(text) or own(text)
            else:
                for word in split(text):
                    out += get(word) or own(word)
            sizes.append(len(out) - before)
        self.remember(cuts, np.frombuffer(out, np.uint32), np.array(sizes, np.int64) // 4)

    def places(self, cuts: pa.Array, first: bool) -> np.ndarray:
        """Where each cut is remembered; new ones are learnt. Distinct cuts alone become Python objects."""
        coded = cuts.dictionary_encode()
        values = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if first:
            values = [(x,) for x in values]
        got = list(map(self.known.get, values))
        if None in got:
            self.learn([x for x, place in zip(values, got, strict=True) if place is None])
            got = list(map(self.known.__getitem__, values))
        return np.array(got, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) in a row, and the count of each text."""
        import pyarrow.compute as pc

        if len(self.known) > self.most:
            self.clear()
        odd = pc.match_substring_regex(texts, r" ([\s\p{Z}\x0b\x1c-\x1f\x{85}]|$)").to_numpy(zero_copy_only=False)
        if self.added:
            odd = odd | pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        whole = {int(i): self.plain([texts[int(i)].as_py()])[0] for i in np.flatnonzero(odd)}
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if whole else texts, " ")
        cuts, edges = lists.flatten(), np.asarray(lists.offsets, np.int64)
        edges = edges - edges[0]
        head = np.zeros(len(cuts), bool)
        head[edges[:-1]] = True
        which = np.empty(len(cuts), np.int64)
        which[head] = self.places(cuts.filter(pa.array(head)), True)
        which[~head] = self.places(cuts.filter(pa.array(~head)), False)
        sizes = self.at[which + 1] - self.at[which]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.at[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[edges]
        if not whole:
            return flat, np.diff(bounds)
        parts = [whole[i] if i in whole else flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257, shard_rows: int = 16_384, path: str | None = None, special: bool = False) -> str:
    """Encodes docs (doc_id, text) and writes shards, entries and index; returns the folder.

    Rows are dealt to shards by ranges of doc_id of about shard_rows rows each and sorted there, so a
    task streams its shard and holds one batch. Rows that share a doc_id stay in one shard. special: see Encoder.
    """
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "tokens")
    width = 2 if vocabulary <= 1 << 16 else 4
    ordered = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(max(1, math.ceil(docs.count() / shard_rows)), "doc_id").sortWithinPartitions("doc_id", "text")
    filesystem, folder = open_store(path)
    filesystem.create_dir(folder)

    @tidied
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(path)
        shard, name = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}.ids"
        encoder, out, offset, before, seen = Encoder(tokenizer, special), None, 0, (), 0
        try:
            for batch in batches:
                keys, texts = batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_string())
                occurrence = []
                for key in keys:
                    seen = seen + 1 if before == (key,) else 0
                    before = (key,)
                    occurrence.append(seen)
                counts = []
                if out is None and keys:
                    out = store.open_output_stream(f"{place}/{name}")
                    out.write(struct.pack(HEAD, b"TOKS", 1, width, 0))
                for first, last in slices(np.asarray(text_bytes(texts)[1]), 8 << 20):
                    ids, sizes = encoder.encode(texts.slice(first, last - first))
                    ends = np.cumsum(sizes)
                    out.write(np.insert(ids, ends, end_id).astype(f"<u{width}").tobytes())
                    counts.append(sizes + 1)
                if counts:
                    n = np.concatenate(counts)
                    at = offset + np.cumsum(n) - n
                    offset += int(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(occurrence, pa.int32()), pa.array(np.full(len(n), shard), pa.int32()), pa.array([name] * len(n)), pa.array(at), pa.array(n)], names=["doc_id", "occurrence", "shard", "file", "offset", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    ordered.mapInArrow(write, f"{NO_KEY}, shard int, file string, offset bigint, n_tokens bigint").write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    sizes = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sizes.select("*", F.expr("sum(tokens) over (order by shard) - tokens as start")).write.parquet(f"{path}/shards")
    write_index(entries, path)
    return path


def key_columns() -> list[F.Column]:
    """Two independent 64-bit values of a key."""
    return [F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "occurrence", F.col("doc_id").isNull(), F.lit(seed)).alias(name) for seed, name in ((11, "h1"), (23, "h2"))]


def level_slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each key falls in the bit array of a level."""
    return (mix(h1 + np.uint64(level + 1) * h2) % np.uint64(size)).astype(np.int64)


def build_hash(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash: at each level a key takes its bit if no other key falls on it; the rest go on."""
    levels: list[np.ndarray] = []
    while len(h1):
        if len(levels) > 200:
            raise ValueError("keys with equal hash pairs: the key columns repeat")
        size = (2 * len(h1) + 7) // 8 * 8
        slots = level_slots(h1, h2, len(levels), size)
        alone = np.bincount(slots, minlength=size) == 1
        levels.append(alone)
        stay = ~alone[slots]
        h1, h2 = h1[stay], h2[stay]
    return levels


def find_slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each key: the rank of its bit among all set bits; -1 for keys that fall through."""
    out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, bits in enumerate(levels):
        slots = level_slots(h1[left], h2[left], level, len(bits))
        hit, rank = bits[slots], np.cumsum(bits)
        out[left[hit]] = base + rank[slots[hit]] - 1
        left, base = left[~hit], base + int(rank[-1])
    return out


def write_index(entries: DataFrame, path: str, part_keys: int = 16_384) -> None:
    """Index files for the entries, about part_keys keys in each, and the table parts that names them."""
    spark = entries.sparkSession
    parts = max(1, math.ceil(entries.count() / part_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        levels = build_hash(h1.copy(), h2.copy())
        slots = find_slots(levels, h1, h2)
        table = np.empty(len(pdf), np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")]))
        for name, values in (("print", h2 >> np.uint64(32)), ("shard", pdf["shard"]), ("offset", pdf["offset"]), ("n", pdf["n_tokens"])):
            table[name][slots] = np.asarray(values)
        name = f"index-{uuid.uuid4().hex}.mph"
        store, place = open_store(path)
        with store.open_output_stream(f"{place}/{name}") as out:
            out.write(struct.pack(f"<4sI{len(levels)}Q", b"MPHX", len(levels), *map(len, levels)))
            for bits in levels:
                out.write(np.packbits(bits).tobytes())
            out.write(table.tobytes())
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "index_file": [name], "keys": [len(pdf)]})

    keyed = entries.select(*key_columns(), "shard", "offset", "n_tokens").withColumn("part", F.expr(f"cast(pmod(h1, {parts}) as int)"))
    keyed.groupBy("part").applyInPandas(build, "part int, index_file string, keys bigint").write.parquet(f"{path}/parts")


def read_index(raw: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays and slot table of an index file."""
    _, n = struct.unpack_from("<4sI", raw)
    sizes = struct.unpack_from(f"<{n}Q", raw, 8)
    at, levels = 8 + 8 * n, []
    for size in sizes:
        levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at)).astype(bool))
        at += size // 8
    return levels, np.frombuffer(raw, np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")]), offset=at)


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """shard, offset and n_tokens of keys (doc_id, occurrence) by the index; keys that it doesn't hold are left out (but for one in 2**32)."""
    parts = spark.read.parquet(f"{path}/parts")
    count = max(1, parts.count())

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        store, place = open_store(path)
        with store.open_input_stream(f"{place}/{pdf['index_file'].iloc[0]}") as source:
            levels, table = read_index(source.read())
        h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        slots = find_slots(levels, h1, h2)
        good = (slots >= 0) & (table["print"][slots] == (h2 >> np.uint64(32)))
        found = table[slots[good]]
        return pdf.loc[good, ["doc_id", "occurrence"]].assign(shard=found["shard"].astype(np.int32), offset=found["offset"].astype(np.int64), n_tokens=found["n"].astype(np.int64))

    hashed = keys.select(F.col("doc_id").cast("bigint").alias("doc_id"), "occurrence", *key_columns()).withColumn("part", F.expr(f"cast(pmod(h1, {count}) as int)"))
    return hashed.join(parts, "part").groupBy("part").applyInPandas(look, f"{NO_KEY}, shard int, offset bigint, n_tokens bigint")


def read_documents(spark: SparkSession, path: str, located: DataFrame) -> DataFrame:
    """Reads located documents back from the shard files: doc_id, occurrence, start, n_tokens, ids_crc32.

    start counts the ids of all documents before. ids_crc32 is taken over the ids as little-endian unsigned 32-bit integers.
    """

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        store, place = open_store(path)
        sums = np.zeros(len(pdf), np.int64)
        with store.open_input_file(f"{place}/{pdf['file'].iloc[0]}") as source:
            _, _, width, _ = struct.unpack(HEAD, source.read_at(HEAD_BYTES, 0))
            at, n = pdf["offset"].to_numpy(), pdf["n_tokens"].to_numpy()
            first = 0
            while first < len(at):  # documents that follow one another are read together
                last = first + 1
                while last < len(at) and at[last] == at[last - 1] + n[last - 1] and at[last] + n[last] - at[first] < 1 << 21:
                    last += 1
                ids = np.frombuffer(source.read_at(int(at[last - 1] + n[last - 1] - at[first]) * width, HEAD_BYTES + int(at[first]) * width), f"<u{width}").astype("<u4")
                for i in range(first, last):
                    sums[i] = zlib.crc32(ids[at[i] - at[first] : at[i] - at[first] + n[i]])
                first = last
        return pdf.assign(start=pdf["offset"] + pdf["shard_start"], ids_crc32=sums)[["doc_id", "occurrence", "start", "n_tokens", "ids_crc32"]]

    shards = spark.read.parquet(f"{path}/shards").select("shard", "file", F.col("start").alias("shard_start"))
    return located.join(shards, "shard").groupBy("shard").applyInPandas(read, f"{NO_KEY}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_store(docs: DataFrame, tokenizer: str, **how: int) -> DataFrame:
    """Writes docs to a token store, then finds every document by its key and reads it back.

    Returns doc_id, start, n_tokens, ids_crc32, occurrence and the store's folder.
    """
    spark = docs.sparkSession
    path = write_tokens(docs, tokenizer, **how)
    keys = spark.read.parquet(f"{path}/entries").select("doc_id", "occurrence")
    found = read_documents(spark, path, locate(spark, path, keys))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "occurrence", F.lit(path).alias("store"))
