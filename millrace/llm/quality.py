"""Quality classifier: a factorisation machine (operator 9).

The score of a text is the logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, where the pairs are
computed in linear time: half of (sum v_i x_i)^2 - sum (v_i x_i)^2, in each of a few dimensions. x holds hashed words,
structure statistics and metadata that follows from the text itself (its length), never labels, lang, source or doc_id.

Null and empty texts have only statistics and get a score like any other. Without labels to learn from every
score is 0.5. Repeated rows each get a row; repeated or contradicting labels are all learnt from. An empty
table gives no rows. Columns other than doc_id and text of documents, and doc_id and quality of labels, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc32_mod, tidied
from millrace.llm.features import Adam, Rows, batches_of, dimensions, labelled_sample, over_blocks


@dataclass
class Machine:
    bias: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    words: int

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic, the factors' terms, and their sums over each row."""
        terms = self.factors[rows.bins] * rows.values[:, None]
        sums = rows.sums(terms)
        pairs = 0.5 * (sums**2 - rows.sums(terms**2)).sum(axis=1)
        return self.bias[0] + rows.sums(self.linear[rows.bins] * rows.values) + pairs, terms, sums

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -30, 30)))


def fit(rows: Rows, target: np.ndarray, words: int, prior: float = 0.5, factors: int = 8, rounds: int = 12, rate: float = 0.02, decay: float = 1e-5) -> Machine:
    """Logistic loss, with Adam over batches of 128. Targets count so that label 1 has the share `prior`."""
    size = dimensions(words)
    machine = Machine(np.zeros(1), np.zeros(size), np.random.default_rng(5).normal(0, 0.02, (size, factors)), words)
    if not len(target):
        machine.factors[:] = 0
        return machine
    share = target.mean()
    weight = np.where(target == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    steps = [Adam(a, rate) for a in (machine.bias, machine.linear, machine.factors)]
    for some, batch in batches_of(rows, 128, rounds, 7):
        raw, terms, sums = machine.raw(batch)
        slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target[some]) * weight[some] / len(some)
        each = np.repeat(slope, np.diff(batch.edges))
        owner = np.repeat(np.arange(len(some)), np.diff(batch.edges))
        linear = np.bincount(batch.bins, each * batch.values, size) + decay * machine.linear
        inner = (each * batch.values)[:, None] * (sums[owner] - terms)
        pairs = np.stack([np.bincount(batch.bins, inner[:, k], size) for k in range(inner.shape[1])], axis=1) + decay * machine.factors
        for step, by in zip(steps, (np.array([slope.sum()]), linear, pairs), strict=True):
            step.step(by)
    return machine


def score(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, words: int = 1 << 14) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs. Learns from rows outside the held-out third alone, at most most_rows of them."""
    known = labels.where(crc32_mod("doc_id", 3) != 1).where("quality in (0, 1)")
    share = known.agg(F.avg("quality")).first()[0]
    machine = fit(*labelled_sample(docs, known, "quality", most_rows, words), words, prior=0.5 if share is None else share)

    def act(batch: pa.RecordBatch, rows: Rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(machine.scores(rows))], names=["doc_id", "score"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return over_blocks(batches, words, act)

    scored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
