"""Periodic runs, whitening and quality rules against plain versions, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import rules, runs, whitening
from millrace.llm.queries import queries
from millrace.session import table

DOCS = "doc_id bigint, text string, lang string, source string, n_words bigint, runs string, host string, `a b` string"


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, None, source, 1, "k", "h", "x") for i, t in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least=12):
    """All runs by trying every period."""
    out = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and not any(all(words[k] == words[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_documents(spark, small):
    rows = table(spark, small, "documents").select("doc_id", "text").collect()
    rows = [r for r in rows if len(words_of(r.text)) < 1500]
    got = {r.doc_id: tuple(r) for r in queries()["op11_periodic_runs"](spark, small).collect()}
    assert {r.doc_id: got[r.doc_id] for r in rows} == {r.doc_id: plain_report(r.doc_id, r.text) for r in rows}
    assert len(got) == table(spark, small, "documents").count() and sum(r[2] > 0 for r in got.values()) > 10


@pytest.mark.parametrize("least", [12, 5, 2])
def test_runs_of_odd_texts(spark, least):
    dice = random.Random(least)
    turn = str.maketrans("ab", "ba")
    thue = "a"
    while len(thue) < 256:
        thue += thue.translate(turn)
    texts = [" ".join(x) for x in (fibonacci(250), thue, "a" * 90, "ab" * 40 + "ba" * 30)]
    for _ in range(40):
        n, k = dice.randint(0, 120), dice.choice([1, 2, 4, 30])
        words = [str(dice.randint(0, k)) for _ in range(n)]
        if n:
            a = dice.randrange(n)
            p = 1 + (n - a) // 3
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)] + words[:9]
        texts.append("\t".join(words))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, " \n\x0b "), (103, "  one  "), (None, "x y " * 9), (7, texts[7]), (104, "   \x1f " * 20)]
    got = runs.find_runs(docs(spark, rows), least).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs]) for r in got) == sorted((str(i), len(words_of(t)), plain_runs(words_of(t), least)) for i, t in rows)
    assert {r.doc_id: r.collapsed for r in got}[None] == "x y" and runs.find_runs(docs(spark, [])).count() == 0


def test_runs_of_a_long_text(spark):
    """A passage that repeats within 200,000 words, copies of it elsewhere, and blocks of one text only."""
    dice = random.Random(3)
    head = [f"h{dice.randrange(50_000)}" for _ in range(60_000)]
    loop = [f"l{i}" for i in range(700)]
    words = head + loop * 150 + head[:30_000] + ["z"] * 13
    r = runs.find_runs(docs(spark, [(1, " ".join(words)), (2, " ".join(loop * 2)), (3, " ".join(loop))])).orderBy("doc_id").collect()
    assert [[tuple(x) for x in y.runs] for y in r] == [[(60_000, 105_000, 700), (195_000, 13, 1)], [(0, 1400, 700)], []]
    assert r[0].collapsed == " ".join(head + loop + head[:30_000] + ["z"]) and r[1].collapsed == r[2].collapsed


def test_loops_are_made_as_told(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(400)] + [(None, "a b c"), (5, None)]
    got = {(r.doc_id, r.n_words): tuple(r) for r in runs.report(docs(spark, rows)).collect()}
    want = {(i, len(words_of(t))): plain_report(i, t) for i, t in rows if i is not None}
    assert {k: v for k, v in got.items() if k[0] is not None} == want and got[None, 3][2] == 0


def plain_whitening(vectors, components=16):
    """vec_id, x and the fit's n, deviations, explained shares and whitened values (up to sign), with numpy."""
    rows = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in vectors]
    fit = sorted({x for _, x in rows})
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[(n * c - t) / n for c, t in zip(x, s, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(s))
    y = dict(zip(fit, centred @ axes[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), strict=True))
    return [(i, n, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), y[x], values[:k] / values.sum()) for i, x in rows]


def same_whitening(got, want):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for k in range(len(want[0][3])):
        ours = np.array([by[i][k + 1].whitened for i, *_ in want])
        theirs = np.array([y[k] for *_, y, _ in want])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-7
    for i, n, deviation, y, shares in want:
        assert len(by[i]) == len(y)
        for k, share in enumerate(shares):
            r = by[i][k + 1]
            assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / share - 1) < 1e-9 and 0 <= r.identity_error < 1e-8


def test_whitening_of_embeddings(spark, small):
    rows = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").select("vec_id", "embedding").collect()]
    got = queries()["op12_whitening"](spark, small).collect()
    assert len(got) == 16 * len(rows)
    same_whitening(got, plain_whitening(rows))


VECTORS = "vec_id bigint, embedding array<double>, label int, x string, n string, component string"


def test_whitening_over_many_blocks(spark, monkeypatch):
    """Blocks of 25 rows: the product is summed up over parts; repeated vectors count once in the fit and get all their rows."""
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 100)
    dice = np.random.default_rng(2)
    rows = [(i, (dice.normal(size=4) * [9, 4, 2, 1]).tolist()) for i in range(800)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(800, 1200)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "x", "n", "c") for i, v in rows], VECTORS)).collect()
    assert len(got) == 4 * len(rows)
    same_whitening(got, plain_whitening(rows))


def test_whitening_of_odd_vectors(spark):
    dice = np.random.default_rng(3)
    good = [(i, dice.normal(size=3).tolist()) for i in range(50)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [math.nan, 1.0, 2.0]), (104, [math.inf, 1.0, 2.0])]
    wide = [(200 + i, dice.normal(size=2).tolist()) for i in range(20)]
    frame = lambda rows: spark.createDataFrame([(i, v, 0, "x", "n", "c") for i, v in rows], VECTORS)
    got = whitening.whiten(frame(good + bad + wide)).collect()
    same_whitening([r for r in got if r.vec_id < 100], plain_whitening(good))
    same_whitening([r for r in got if r.vec_id >= 200], plain_whitening(wide))
    assert {r.vec_id for r in got} == {i for i, _ in good + wide}
    twice = whitening.whiten(frame(good + good[:5] + [(None, good[0][1])])).collect()
    assert len(twice) == 3 * 56 and {r.n for r in twice} == {50}
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame(bad)).count() == 0 and whitening.whiten(frame(good[:1] * 3)).count() == 0
    flat = whitening.whiten(frame([(i, [float(i), 2.0 * i]) for i in range(9)])).collect()  # one direction
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-9
    huge = whitening.whiten(frame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)])).collect()
    assert {r.deviation for r in huge} == {None} and {r.vec_id for r in huge} == set(range(6))


def plain_rules(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    seen, again = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            again |= {i + k for i in places for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_rules_of_documents(spark, small):
    rows = table(spark, small, "documents").collect()
    got = {r.doc_id: tuple(r) for r in queries()["op13_quality_rules"](spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        told = plain_rules(r.text)
        failed = told[0] < 20 or 100 * told[4] > 30 * told[0]
        assert got[r.doc_id] == (r.doc_id, *told, failed, not failed)  # no host of these tables is bad


LONG = "\n".join("one two three four five six seven eight nine %d" % (i % 3000) for i in range(9000))
GOOD = " ".join(f"word{i}" for i in range(40))


def test_rules_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, GOOD), (4, GOOD), (None, GOOD), (5, LONG), (6, "a b c d e f g h a b c d e f g h " + GOOD), (7, "é ß\x0bx  \ny\n\n y\ny\n" + GOOD), (8, "#$%" * 30 + GOOD)]
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in rules.report(docs(spark, rows, None)).collect())
    want = []
    for i, t in rows:
        told = plain_rules(t)
        failed = told[0] < 20 or 100 * told[4] > 30 * told[0]
        want.append((str(i), *told, failed, not failed))
    assert got == sorted(want) and rules.report(docs(spark, [])).count() == 0


def test_verdicts_of_hosts(spark):
    """A host whose documents are full of symbols goes with all its documents; one such document in a good host stays, and so does a small host that failed once."""
    symbols = GOOD + " ####" * 3
    rows = [(i, GOOD, "good") for i in range(50)] + [(50, symbols, "good")] + [(60 + i, symbols, "bad") for i in range(30)] + [(90, GOOD, "bad"), (91, symbols, "tiny"), (92, GOOD, None), (93, symbols, None)]
    rows += [(100 + 20 * h + i, GOOD, f"host{h}") for h in range(12) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id: r.kept for r in rules.report(frame).collect()}
    assert {i for i, ok in kept.items() if not ok} == {*range(60, 91)}
    _, hosts = rules.verdicts(frame)
    rates = {r.source: (r.symbols, r.n, r.symbols_rate) for r in hosts.collect()}
    share = np.array([k / n for k, n, _ in rates.values()])
    noise, m = np.mean([1 / n for _, n, _ in rates.values()]), share.mean()
    w = min(1e6, max(2.0, m * (1 - m) / (share.var() - m * (1 - m) * noise) - 1))
    assert all(abs(rate - (k + w * m) / (n + w)) < 1e-9 for k, n, rate in rates.values())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert {r[0]: r[-1] for r in con.sql(rules.ORACLE_SQL).fetchall()} == kept


def test_one_host_holds_most_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(GOOD).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    assert rules.report(rows).where("kept").count() == 3000
