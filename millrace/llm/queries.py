"""The registered queries of this package, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat, decontaminate, embeddings, langid, linededup, mixing, quality, rules, runs, secrets, simhash, token_store, whitening
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """Where the public vocabulary lies on this machine; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": lambda s, d: linededup.report(table(s, d, "documents")),
        "op2_token_store": lambda s, d: token_store.token_store(table(s, d, "documents"), tokenizer_path(), special=True),
        "op3_decontaminate": lambda s, d: decontaminate.decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_language_id": lambda s, d: langid.identify(table(s, d, "documents")),
        "op5_secret_scan": lambda s, d: secrets.report(table(s, d, "documents")),
        "op6_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
        "op7_mixing": lambda s, d: mixing.mix(table(s, d, "documents").select("doc_id", "text"), table(s, d, "labels")).drop("text"),
        "op8_chat_rotation": lambda s, d: chat.rotate(table(s, d, "conversations")),
        "op9_quality": lambda s, d: quality.score(table(s, d, "documents"), table(s, d, "labels")),
        "op10_embedding_dedup": lambda s, d: embeddings.near_copies(table(s, d, "embeddings"), cell_size=512, reach=0.3),
        "op11_periodic_runs": lambda s, d: runs.report(table(s, d, "documents")),
        "op12_whitening": lambda s, d: whitening.whiten(table(s, d, "embeddings")),
        "op13_quality_rules": lambda s, d: rules.report(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scan": secrets.oracle_sql(), "op8_chat_rotation": chat.ORACLE_SQL, "op13_quality_rules": rules.ORACLE_SQL}
