"""All links are counted, and models are learnt from all rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_small_cases import docs, edit_distance

from millrace.llm import langid, linededup
from millrace.operators.ranges import percentiles


def plain_links(rows):
    """Direct links of each document's lines, summed over its lines."""
    own = {i: [x.strip(" ") for x in t.split("\n") if x.strip(" ")] for i, t in rows}
    every = {x for lines in own.values() for x in lines}
    near = {x: sum(x != y and edit_distance(x, y) <= min(2, min(len(x), len(y)) // 6) for y in every) for x in every}
    return {i: sum(near[x] for x in lines) for i, lines in own.items()}


def test_links_within_a_class_are_counted(spark):
    """A chain links neighbours alone, a crowd every line with every other; both are one class each, and repeats of a line count as it does."""
    base = "the quick brown fox jumps over the lazy dog again and again"
    chain = ["#" * 2 * i + base[2 * i :] for i in range(5)]
    crowd = [f"page {i:02d} of the old annual report" for i in range(40)]
    rows = [*enumerate(chain), *enumerate(crowd, 100), (200, "\n".join([crowd[0], chain[2], crowd[0], "x"])), (201, "")]
    got = {r.doc_id: r for r in linededup.report(docs(spark, rows)).collect()}
    assert [got[i].n_direct_links for i in range(5)] == [1, 2, 2, 2, 1] and {got[i].n_links for i in range(5)} == {4}
    assert {got[i].n_direct_links for i in range(100, 140)} == {39} and got[200].n_direct_links == 39 + 2 + 39 and got[201].n_direct_links == 0
    assert {i: r.n_direct_links for i, r in got.items()} == plain_links(rows)


@pytest.mark.parametrize("block", [3, 1024])
def test_link_counts_by_brute_force(spark, block):
    """Keys of many lines, in blocks and whole, count the same links."""
    dice = random.Random(block)
    lines = set()
    for base in ("".join(dice.choice("abcdefg ") for _ in range(n)) for n in (7, 14, 21, 40)):
        for _ in range(25):
            own = list(base)
            for _ in range(dice.randint(0, 3)):
                own[(at := dice.randrange(len(own))) : at + dice.randint(0, 1)] = dice.choice(["", "x", "é"])
            lines.add("".join(own).strip(" "))
    rows = list(enumerate(sorted(lines)))
    found = linededup.Meetings(docs(spark, rows), 2, 6)
    ids = spark.createDataFrame(rows, "doc_id bigint, line string").select("doc_id", linededup.line_id("line").alias("id"))
    got = {r.doc_id: r.direct for r in found.direct(found.placed(None), block).join(ids, "id").collect()}
    assert got == {i: n for i, n in plain_links(rows).items() if n}


def test_language_model_is_learnt_from_all_rows(spark, small):
    """However few rows the landmarks are drawn from, the regression and the profiles are over all rows."""
    table = spark.read.parquet(f"{small}/documents.parquet").where("lang is not null and text is not null")
    model = langid.fit(table, most_rows=40, landmarks=24, width=1 << 11)
    rows = langid.texts_of(table, ["lang"]).where(langid.LETTERS).collect()
    raw = [r[langid.LOW].encode() for r in rows]
    letters, offsets = langid.letter_table(), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    bins = langid.presence(letters[np.frombuffer(b"".join(raw), np.uint8)], offsets, 1 << 11, model.grams).astype(float)
    y = np.array([model.labels.index(r.lang) for r in rows])
    assert len(y) > 100 and np.allclose(model.profiles, [bins[y == i].mean(axis=0) for i in range(len(model.labels))], atol=1e-6)
    kernels = (bins / np.sqrt(bins.sum(axis=1, keepdims=True))) @ model.landmarks.T.astype(float)
    target, weight = np.where(y[:, None] == np.arange(len(model.labels)), 1.0, -1.0), (1 / np.bincount(y)[y])[:, None]
    own = model.landmarks.astype(float) @ model.landmarks.T.astype(float)
    plain = np.linalg.solve(kernels.T @ (kernels * weight) + 0.05 * own / len(own) + 1e-8 * np.eye(len(own)), kernels.T @ (target * weight))
    assert np.allclose(kernels @ model.weights, kernels @ plain, atol=0.02)
    again = langid.fit(table.repartition(7), most_rows=40, landmarks=24, width=1 << 11)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.profiles, again.profiles)
    same = table.limit(1).crossJoin(spark.range(300)).select(F.lit(5).alias("doc_id"), "text", "lang")
    assert langid.fit(same, most_rows=1).landmarks.shape[0]  # rows of one id


def test_language_bounds_are_over_all_held_out_rows(spark):
    """More held-out rows than were looked at before: the bounds are the quantiles of all of them."""
    dice = random.Random(3)
    words = {x: ["".join(dice.choice(a) for _ in range(dice.randint(3, 8))) for _ in range(300)] for x, a in (("aa", "abcdefghij"), ("bb", "hijklmnopq"))}
    rows = [(i, " ".join(dice.choice(words[x]) for _ in range(dice.randint(2, 12))), x) for i in range(15_000) for x in [dice.choice(["aa", "bb"])]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learnt(table, landmarks=32, width=1 << 11)
    held = table.where(F.col("doc_id").isin([i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]))
    got = langid.predict(held, model, ["lang"], like=True).where("lang_pred = lang")
    want = [0.9 * np.quantile([r[0] for r in got.select(c).collect()], 0.005) for c in (langid.USUAL, langid.SEEN)]
    assert held.count() > 2800 and np.allclose(langid.bounds(table, model), want, rtol=1e-12)
    parted = percentiles(got, [], langid.USUAL, {"least": 0.005}, most=100).first()  # as for more rows than a task should order
    assert np.isclose(0.9 * parted["least"], want[0], rtol=1e-12)
