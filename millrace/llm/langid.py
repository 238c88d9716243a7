"""Language identification by string kernels (operator 4).

A text is the set of its distinct n-grams of bytes for several n (blended spectrum, presence only), hashed to
`width` bins. The kernel of two texts is the share of bins that both have, normalized by their sizes.
Nystroem landmarks span the space in which one-versus-rest kernel ridge regression is solved over all training texts: tasks sum up products of
their kernels, as whole numbers, so that the sums don't depend on how rows lie in files. Texts are scored by batched matrix products of their bins
with the landmarks' and of those kernels with the weights.

Only letters count: texts are lower-cased and everything else in ASCII becomes one blank. A text that is
null or has no letter gets `und` and score 0; so does every text where no labelled row can be learnt from.
Whole texts are read. Repeated rows each get a row; ties go to the label first in order; an empty
table gives no rows. Columns other than doc_id, text and lang are not read, and lang only for training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import slices, text_bytes
from millrace.llm.common import crc32_mod, hidden, stored, tidied
from millrace.operators.ranges import percentiles

UNKNOWN = "und"
LOW, LETTERS = "langid_low", "langid_letters"
#: How like a text is to the learnt texts of its language; see likeness().
USUAL, SEEN = "langid_usual", "langid_seen"
#: Kernels are summed in units of 1 / SCALE: products of two stay exact for some 8 * 10^9 texts of a language.
SCALE = 1 << 15
#: Sums are added up in pieces of so many numbers.
PIECE = 512


@dataclass
class Model:
    labels: list[str]
    landmarks: np.ndarray  # float32: bins of each landmark, divided by the root of their number
    weights: np.ndarray  # float32: landmarks x labels
    width: int
    grams: tuple[int, ...]
    profiles: np.ndarray  # float32: labels x bins, the share of a label's learnt texts that have the bin


def letter_table() -> np.ndarray:
    """Lower case for ASCII letters, a blank for all other ASCII; other bytes stay."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def presence(raw: np.ndarray, offsets: np.ndarray, width: int, grams: tuple[int, ...]) -> np.ndarray:
    """A row for each text: 1 in the bins of its n-grams, else 0."""
    out = np.zeros((len(offsets) - 1) * width, np.float32)
    for first in range(0, len(raw), 1 << 21):  # a long text goes in pieces that overlap by an n-gram
        last = min(len(raw), first + (1 << 21) + max(grams) - 1)
        rows = np.searchsorted(offsets, np.arange(first, last, dtype=np.int32 if last < 1 << 31 else np.int64), side="right") - 1
        codes = raw[first:last].astype(np.uint32)
        rolled = np.zeros(last - first, np.uint32)
        for n in range(1, max(grams) + 1):
            size = last - first - n + 1
            if size <= 0:
                break
            rolled = rolled[:size] * np.uint32(257) + codes[n - 1 :]
            if n in grams:
                whole = rows[:size] == rows[n - 1 :]
                bins = ((rolled * np.uint32(2654435761)) >> np.uint32(32 - (width.bit_length() - 1))).astype(np.int64)
                out[(rows[:size] * width + bins)[whole]] = 1
    return out.reshape(-1, width)


def kernel_scores(bins: np.ndarray, landmarks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(bins.sum(axis=1, keepdims=True), 1))
    return ((bins @ landmarks.T) / sizes) @ weights


def likeness(bins: np.ndarray, profiles: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """For each text the mean of its label's profile over its bins, and the share of its bins that over a hundredth of the label's learnt texts have.

    Both look at one label alone, so they don't depend on how many were learnt. The first falls for very long texts, which have rare bins too; the second doesn't.
    """
    sizes, each = np.maximum(bins.sum(axis=1), 1), np.arange(len(label))
    return [((bins @ p.T)[each, label] / sizes).astype(np.float64) for p in (profiles, (profiles > 0.01).astype(np.float32))]


def texts_of(docs: DataFrame, columns: list[str], *more: F.Column) -> DataFrame:
    """The named columns, the text in lower case and whether it has a letter."""
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*(F.col(f"`{c}`") for c in columns), *more, F.lower(F.coalesce("text", F.lit(""))).alias(LOW), has.alias(LETTERS))


def drawn(rows: DataFrame, counts: dict[str, int], most_rows: int, width: int, grams: tuple[int, ...]) -> tuple[np.ndarray, list[str]]:
    """Bins and langs of about most_rows rows, evenly over the labels and in the order of a hash of doc_id (of the text where it is null): the first are the landmarks.

    Rows that repeat one id are drawn together or not at all; where that leaves none, the first of all rows are taken.
    """
    each = max(1, most_rows // len(counts))
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(each / n)) for x, n in counts.items()), F.lit(0.0))
    dice = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(LOW, F.lit("draw"))).otherwise(F.xxhash64("doc_id", F.lit("draw"))), F.lit(1_000_003))
    every = rows.withColumn("dice", dice)

    @tidied
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, got in blocks(batch[LOW], width, grams):
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(first, last - first), batch["dice"].slice(first, last - first), pa.array([x.tobytes() for x in np.packbits(got.astype(bool), axis=1)])], names=["lang", "dice", "bins"])

    for some in (every.where(F.col("dice") < share * 1_000_003), every):
        got = some.select("lang", LOW, "dice").mapInArrow(bins, "lang string, dice bigint, bins binary").orderBy("dice", "lang", "bins").limit(2 * most_rows).collect()
        if got:
            break
    return np.unpackbits(np.frombuffer(b"".join(r["bins"] for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32), [r["lang"] for r in got]


def blocks(texts: pa.Array, width: int, grams: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, last row (not included) and bins of blocks of bounded size."""
    letters = letter_table()
    raw, offsets = text_bytes(texts)
    for first, last in ((k, min(hi, k + 512)) for lo, hi in slices(offsets, 1 << 21) for k in range(lo, hi, 512)):
        yield first, last, presence(letters[raw[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first], width, grams)


def kernel_sums(rows: DataFrame, labels: list[str], marks: np.ndarray, grams: tuple[int, ...]) -> np.ndarray:
    """For each label, over all its rows (lang and LOW): sums of products of two kernels (landmarks x landmarks), of kernels, and of bins, in one list.

    marks: bins of the landmarks. Kernels are whole numbers of 1 / SCALE. A task gives one list for each label, in pieces that are added up apart.
    """
    width, roots = marks.shape[1], np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float64), 1))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at = len(roots), {x: i for i, x in enumerate(labels)}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.array([at[x] for x in batch["lang"].to_pylist()], int)
            for first, last, bins in blocks(batch[LOW], width, grams):
                sizes = np.sqrt(np.maximum(bins.sum(axis=1, dtype=np.float64), 1))
                kernels = np.rint((bins @ marks.T).astype(np.float64) / sizes[:, None] / roots * SCALE)  # shared bins are counted exactly
                for label in np.unique(y[first:last]):
                    own = y[first:last] == label
                    k = kernels[own]
                    new = np.concatenate([(k.T @ k).ravel(), k.sum(axis=0), bins[own].sum(axis=0, dtype=np.float64)]).astype(np.int64)
                    sums[label] = sums[label] + new if label in sums else new
        for label, total in sums.items():
            pieces = [total[i : i + PIECE].tolist() for i in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.int64()))], names=["label", "piece", "sums"])

    def added(some: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in some["sums"]], axis=0)
        return pa.table({"label": some["label"][:1], "piece": some["piece"][:1], "sums": pa.array([total.tolist()], pa.list_(pa.int64()))})

    schema = "label int, piece int, sums array<bigint>"
    got = rows.select("lang", LOW).mapInArrow(run, schema).groupBy("label", "piece").applyInArrow(added, schema).collect()
    out = np.zeros((len(labels), len(roots) * (len(roots) + 1) + width), np.int64)
    for r in got:
        out[r["label"], r["piece"] * PIECE : r["piece"] * PIECE + len(r["sums"])] = r["sums"]
    return out


def fit(rows: DataFrame, most_rows: int = 2000, landmarks: int = 192, width: int = 1 << 13, grams: tuple[int, ...] = (2, 3), ridge: float = 0.05) -> Model:
    """Learns from all rows (doc_id, text, lang) without null langs that have a letter.

    The landmarks are the first of about most_rows texts drawn by a hash of doc_id and evenly over the labels, so that a rare label has some too. The
    regression and the profiles are over every row; the driver gets their sums (landmarks * landmarks + width numbers for each label).
    """
    rows = texts_of(rows, ["doc_id", "lang"]).where(LETTERS)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, width), np.float32), np.zeros((0, 0), np.float32), width, grams, np.zeros((0, width), np.float32))
    labels = sorted(counts)
    x, langs = drawn(rows, counts, most_rows, width, grams)
    seen: dict[str, int] = {}
    rank = [seen[lang] for lang in langs if [seen.update({lang: seen.get(lang, -1) + 1})]]
    marks = x[np.argsort(rank, kind="stable")[:landmarks]]
    n, each = len(marks), np.array([counts[label] for label in labels], float)
    sums = kernel_sums(rows, labels, marks, grams)
    profiles = (sums[:, n * (n + 1) :] / each[:, None]).astype(np.float32)
    means = sums[:, : n * (n + 1)] / each[:, None]  # each label counts alike
    among, kernels = means[:, : n * n].sum(axis=0).reshape(n, n) / SCALE**2, means[:, n * n :] / SCALE
    targets = 2 * np.eye(len(labels)) - 1
    marks = marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    own = (marks @ marks.T).astype(np.float64)
    solved = np.linalg.lstsq(among + ridge * own / n + 1e-8 * np.eye(n), kernels.T @ targets, rcond=None)[0]
    return Model(labels, marks, solved.astype(np.float32), width, grams, profiles)


def predict(docs: DataFrame, model: Model, columns: list[str], like: bool = False) -> DataFrame:
    """The named columns of every row, with lang_pred and score (0 to 1: the softmax of the sharpened regressions); with `like` also USUAL and SEEN."""
    more = [USUAL, SEEN] if like else []
    if not model.labels:
        return docs.select(*(F.col(f"`{c}`") for c in columns), F.lit(UNKNOWN).alias("lang_pred"), *(F.lit(0.0).alias(c) for c in ["score", *more]))
    profiles = model.profiles if like else None
    labels, marks, weights, width, grams = model.labels, model.landmarks, model.weights, model.width, model.grams

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(labels, object)
        for batch in batches:
            has = batch[LETTERS].to_numpy(zero_copy_only=False)
            for first, last, bins in blocks(batch[LOW], width, grams):
                fits = kernel_scores(bins, marks, weights).astype(np.float64)
                best = fits.argmax(axis=1)
                odds = np.exp(3 * (fits - fits.max(axis=1, keepdims=True)))
                seen = has[first:last]
                pred = np.where(seen, names[best], UNKNOWN)
                own = [batch[c].slice(first, last - first) for c in columns]
                alike = [] if profiles is None else likeness(bins, profiles, best)
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred.tolist(), pa.string()), pa.array(np.where(seen, 1 / odds.sum(axis=1), 0.0)), *map(pa.array, alike)], names=[*columns, "lang_pred", "score", *more])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return texts_of(docs, columns).mapInArrow(run, ", ".join([fields, "lang_pred string, score double", *(f"{c} double" for c in more)]))


def learnt(docs: DataFrame, **how: float) -> Model:
    """A model from the labelled rows outside the held-out fifth."""
    return fit(docs.where(crc32_mod("doc_id", 5) != 0).where("lang is not null and text is not null").select("doc_id", "text", "lang"), **how)


def identify(docs: DataFrame, **how: float) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    return predict(docs, learnt(docs, **how), ["doc_id"]).select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def bounds(docs: DataFrame, model: Model, lost: float = 0.005, slack: float = 0.9) -> tuple[float, float]:
    """The least USUAL and SEEN of a text in a learnt language: `slack` times what all but a share of `lost` of the held-out labelled rows reach.

    All held-out rows are looked at. Without any nothing can be measured: both bounds are 0 and refuse no text.
    """
    held = docs.where(crc32_mod("doc_id", 5) == 0).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    got = stored(predict(held, model, ["lang"], like=True).where("lang_pred = lang").select(USUAL, SEEN), "langid-held")
    reached = (percentiles(got, [], c, {"least": lost}).first() for c in (USUAL, SEEN))
    return tuple(slack * (r["least"] or 0.0) if r else 0.0 for r in reached)


def accepted(docs: DataFrame, **how: float) -> DataFrame:
    """The rows of docs that have a letter and are like the learnt texts of a language by either of bounds(); columns as they were, whatever their names.

    Texts of a few letters can't be told from junk with certainty: some junk of one or two words stays.
    """
    model = learnt(docs, **how)
    usual, seen = bounds(docs, model)
    plain, restored = hidden(docs, "text")
    named = predict(plain, model, plain.columns, like=True)
    return restored(named.where((F.col("lang_pred") != UNKNOWN) & ((F.col(USUAL) >= usual) | (F.col(SEEN) >= seen))))
