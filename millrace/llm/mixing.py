"""Mixing to target weights by soft membership (operator 7).

A classifier learnt from the labelled table gives each document a posterior over domains. Then
document rates r >= 0 are fitted by projected gradient so that, for every domain k, the expected tokens
sum_d r_d * tokens_d * p_dk match the target's share of the budget in least squares of the relative errors. A step needs only
one number for each domain from all documents, summed in the tasks; a document's rate follows from its own posterior
and the short list of those sums, so nothing else is kept between steps and a lost executor costs no more
than its tasks. Tokens are words (runs of letters and digits).

Domains follow from labels: `low` (quality 0), else `toxic` (toxic 1), else `clean`; rows in which either is null aren't
learnt from. Without labels all posteriors are even. A text without words has no tokens: its rate is kept
but changes no total. Null text is empty. Repeated rows each get a rate and each count. An empty table gives no
rows. Other columns of docs are passed through; mix() replaces those that have the names of its own results.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hidden, stored, tidied
from millrace.llm.features import Adam, Rows, batches_of, dimensions, labelled_sample, over_blocks

DOMAINS = ("low", "toxic", "clean")
#: Shares of all tokens that the mixture should have.
TARGETS = {"low": 0.05, "toxic": 0.05, "clean": 0.90}
POSTERIOR, TOKENS, RATE, COPIES = "mix_posterior", "mix_tokens", "mix_rate", "mix_copies"


def domain(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    return F.when(F.col(quality).isNull() | F.col(toxic).isNull(), None).when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).otherwise(2)


def fit(rows: Rows, target: np.ndarray, shares: np.ndarray, words: int, rounds: int = 12, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression; targets count so that each has its share of all labels. Returns biases and weights (bins x domains)."""
    size, k = dimensions(words), len(DOMAINS)
    bias, weights = np.zeros(k), np.zeros((size, k))
    if not len(target):
        return bias, weights
    drawn = np.bincount(target, minlength=k) / len(target)
    weight = np.where(drawn > 0, shares / np.maximum(drawn, 1e-9), 0)[target]
    steps = Adam(bias, rate), Adam(weights, rate)
    for some, batch in batches_of(rows, 128, rounds, 11):
        slope = (posteriors(batch, bias, weights) - (target[some][:, None] == np.arange(k))) * weight[some][:, None] / len(some)
        each = np.repeat(slope, np.diff(batch.edges), axis=0) * batch.values[:, None]
        steps[0].step(slope.sum(axis=0))
        steps[1].step(np.stack([np.bincount(batch.bins, each[:, j], size) for j in range(k)], axis=1) + decay * weights)
    return bias, weights


def posteriors(rows: Rows, bias: np.ndarray, weights: np.ndarray) -> np.ndarray:
    raw = bias + rows.sums(weights[rows.bins] * rows.values[:, None])
    odds = np.exp(raw - raw.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def with_posteriors(docs: DataFrame, labels: DataFrame, most_rows: int, words: int) -> DataFrame:
    """docs with the posterior and the tokens of each row."""
    known = labels.withColumn("mix_domain", domain())
    counts = {r["mix_domain"]: r["count"] for r in known.groupBy("mix_domain").count().collect() if r["mix_domain"] is not None}
    shares = np.array([counts.get(k, 0) for k in range(len(DOMAINS))], float) / max(1, sum(counts.values()))
    bias, weights = fit(*labelled_sample(docs, known, "mix_domain", most_rows, words), shares, words)

    def act(batch: pa.RecordBatch, rows: Rows) -> pa.RecordBatch:
        got = posteriors(rows, bias, weights)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32()), pa.array(got.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(rows.n_words)], names=[*batch.schema.names, POSTERIOR, TOKENS])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return over_blocks(batches, words, act)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {POSTERIOR} array<double>, {TOKENS} bigint")


def replay(p: np.ndarray, slopes: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps made so far, and the point at which the next slope is taken (with Nesterov's momentum)."""
    rate = ahead = np.ones(len(p))
    for t, slope in enumerate(slopes):
        new = np.maximum(0, ahead - step * (p @ slope))
        ahead, rate = new + t / (t + 3) * (new - rate), new
    return rate, ahead


def fit_rates(placed: DataFrame, targets: dict[str, float], budget: float, most_steps: int, close: float) -> tuple[np.ndarray, float]:
    """The slopes of all steps, and the step's length, that give each document's rate. budget: tokens wanted, as a share of those there."""
    wanted = np.array([targets[d] for d in DOMAINS])
    wanted = wanted / wanted.sum() * budget
    k = len(DOMAINS)
    small = placed.select(POSTERIOR, TOKENS)

    def total(of, width: int) -> np.ndarray:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for batch in batches:
                p = np.asarray(batch[POSTERIOR].flatten()).reshape(-1, k)
                out += of(p, batch[TOKENS].to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(out)], names=["i", "x"])

        got = {r["i"]: r["x"] for r in small.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        return np.array([got.get(i, 0.0) for i in range(width)])

    gram = total(lambda p, n: np.concatenate([[n.sum()], (p * n[:, None]).T.dot(p).ravel()]), 1 + k * k)
    tokens = gram[0]
    if not tokens:
        return np.zeros((0, k)), 0.0
    gram = gram[1:].reshape(k, k) / tokens
    scale = np.maximum(gram.sum(axis=1), 1e-6)  # each domain's share now: errors count relative to it
    step = 1 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale)))[-1]
    slopes = np.zeros((0, k))
    for _ in range(most_steps):
        def expected(p: np.ndarray, n: np.ndarray, slopes: np.ndarray = slopes) -> np.ndarray:
            rate, ahead = replay(p, slopes, step)
            return np.concatenate([(p * (n * x)[:, None]).sum(axis=0) for x in (rate, ahead)])

        got = total(expected, 2 * k) / tokens
        missing = np.abs(got[:k] - wanted).max()
        if missing <= close * budget:
            break
        slopes = np.vstack([slopes, (got[k:] - wanted) / scale])
    else:
        warnings.warn(f"after {most_steps} steps a domain's share of the tokens is {missing:.4f} off its target", stacklevel=3)
    return slopes, float(step)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, most_rows: int = 6000, words: int = 1 << 14, most_steps: int = 60, close: float = 1e-3) -> DataFrame:
    """docs with posterior, tokens, rate, and copies: the rate rounded up or down by a hash of doc_id and text, so that copies average to it.

    The fit ends when every domain's share is within `close` of its target, or after most_steps: a target that no nonnegative rates reach leaves the
    least squares of what is missing, and a warning says how much.
    """
    docs = docs.drop(POSTERIOR, TOKENS, RATE, COPIES)
    placed = stored(with_posteriors(docs, labels, most_rows, words), "mixing")
    slopes, step = fit_rates(placed, targets, budget, most_steps, close)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, _ = replay(np.asarray(batch[POSTERIOR].flatten()).reshape(-1, len(DOMAINS)), slopes, step)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, RATE])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    dice = F.pmod(F.xxhash64("doc_id", "text", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return placed.mapInArrow(run, f"{fields}, {RATE} double").withColumn(COPIES, F.floor(F.col(RATE) + dice).cast("int"))


def apply_mix(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as its copies say, with the given columns, whatever their names."""
    rows = mixed.where(f"{COPIES} > 0").select(F.array_repeat(F.struct(*(F.col(f"`{c}`") for c in columns)), F.col(COPIES)).alias("rows"))
    return rows.select(F.inline("rows"))


def mixed_rows(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """docs with each row as often as its copies say; columns as they were, whatever their names."""
    plain, restored = hidden(docs, "doc_id", "text")
    return restored(apply_mix(mix(plain, labels, **how), plain.columns))
