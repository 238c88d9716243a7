"""A training corpus from documents: each stage works on all rows that the one before kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, mixing, simhash, token_store
from millrace.llm.common import hidden, stored
from millrace.llm.queries import tokenizer_path
from millrace.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or unlike the texts of every learnt language, go. An empty table stays empty."""
    return langid.accepted(docs)


def text_key() -> F.Column:
    """The stages below judge texts: rows are told apart by this value (never null) together with doc_id, which may be null or repeat."""
    return F.xxhash64("text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id, then text_key(). Rows without an id come after all others.

    Null, empty and blank texts are copies of each other. Columns may have any names; an empty table stays empty.
    """
    plain, restored = hidden(docs, "doc_id", "text")
    keyed = plain.select(F.col("doc_id").cast("bigint").alias("least"), text_key().alias("text_key"), "text")
    groups = simhash.near_duplicates(keyed.select(F.col("text_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("text_key"), "component_id")
    groups = stored(groups, "near-groups").distinct()  # read again below: its joins run once
    texts = keyed.groupBy("text_key").agg(F.min("least").alias("least"))
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "text_key")).alias("first")
    kept = texts.join(groups, "text_key").groupBy("component_id").agg(first).select(F.col("first.least").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    held = plain.withColumn("text_key", text_key())
    held = held.join(kept, held["doc_id"].eqNullSafe(kept["kept_id"]) & (held["text_key"] == kept["kept_key"]), "left_semi")
    return restored(held.dropDuplicates(["doc_id", "text_key"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds ten words in a row of a benchmark item go, whatever their doc_id; null and empty texts stay. Columns may have any names."""
    texts = docs.select(text_key().alias("doc_id"), "text")
    bad = decontaminate.decontaminate(texts, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("bad_key")).distinct()
    plain, restored = hidden(docs, "text")
    return restored(plain.join(bad, text_key() == bad["bad_key"], "left_anti"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that domains have their target shares of the words. Rows with null or repeated ids count like any; columns may have any names."""
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as token ids in binary shards, found by key and read back."""
    return token_store.token_store(docs, tokenizer_path(), special=True)


STAGES = [("language id", language_id), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mixture), ("token ids", tokens)]

#: SQL can't express these stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
