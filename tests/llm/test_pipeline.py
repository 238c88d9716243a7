"""The corpus pipeline stage by stage, each on what the one before kept."""

import corpus_pipeline
import pytest
from millrace.llm import decontaminate, simhash
from millrace.llm.common import stored


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, every = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small), "test-stage")
        assert docs.columns == columns
        every[name] = docs.collect()
    language, near, clean, mixed = every.values()
    assert len(language) >= 195
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in language}
    kept = [r.doc_id for r in near]
    assert len(kept) == len(set(kept)) and not [1 for a in kept for b in kept if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {r.doc_id for r in near if decontaminate.brute_force(r.text, items)[1]}
    assert {r.doc_id for r in clean} == set(kept) - leaks
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed)
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_rows_that_share_an_id(spark, tmp_path):
    """Null and repeated doc_ids with different texts: near_dedup keeps one row of each component, decontamination drops contaminated rows alone."""
    base = ["".join(chr(97 + (i * 7 + j * j + k) % 26) for k in range(j % 5 + 3)) for i in range(6) for j in range(40)]
    texts = [" ".join(base[40 * i : 40 * i + 40]) for i in range(6)]
    rows = [(3, texts[0]), (7, texts[0]), (7, texts[1]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (9, texts[3]), (None, texts[4]), (9, texts[5])]
    prints = [simhash.fingerprint(t) for t in texts]
    assert all((a ^ b).bit_count() > 8 for i, a in enumerate(prints) for b in prints[:i])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    near = stored(corpus_pipeline.near_dedup(spark, docs, str(tmp_path)), "test-stage")
    assert near.columns == docs.columns
    want = [(3, texts[0]), (7, texts[1]), (None, texts[2]), (9, texts[3]), (None, texts[4]), (9, texts[5])]
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted(want, key=str)
    leaks = [("a", " ".join(texts[2].split()[5:20])), ("b", " ".join(texts[5].split()[5:20]))]
    spark.createDataFrame(leaks, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, near, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([want[0], want[1], want[3], want[4]], key=str)


CLASHING = ("score", "lang_pred", "mix_rate", "mix_tokens", "mix_copy", "kept_0", "text_key", "bad_key", "component_id", "fp", "a b", "least")


@pytest.mark.parametrize("n", [0, 60])
def test_odd_rows_and_names(spark, small, n):
    """Null ids and texts, empty tables and columns with the operators' own names pass every stage; what is kept keeps its columns."""
    base = spark.read.parquet(f"{small}/documents.parquet").limit(n)
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (7, "", None, None, None), (None, " .. 12", "en", "s", 6)], base.schema).limit(n)
    docs = base.union(odd)
    docs = docs.select("*", *(docs["doc_id"].cast("string").alias(c) for c in CLASHING))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small), "test-stage")
        rows = docs.collect()
        assert docs.columns == [*base.columns, *CLASHING] and {(r.doc_id, r.text) for r in rows} <= texts
        assert all(r[c] == (None if r.doc_id is None else str(r.doc_id)) for r in rows for c in CLASHING)
        if name != "mixing":
            assert bool(rows) == bool(n)
        if name == "language id":
            assert not [r for r in rows if not r.text or r.text == " .. 12"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


@pytest.mark.parametrize("stage", [corpus_pipeline.near_dedup, corpus_pipeline.decontamination])
def test_rows_without_text_pass(spark, small, stage):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, "en", "s", 0), (7, "", None, None, None), (8, "one text of its own", "en", "s", 6)], schema)
    got = {(r.doc_id, r.text) for r in stage(spark, docs, small).collect()}
    assert got == ({(7, ""), (8, "one text of its own")} if stage is corpus_pipeline.near_dedup else {(r.doc_id, r.text) for r in docs.collect()})
