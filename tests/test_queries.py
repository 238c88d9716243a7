"""Every registered query runs, and gives what its SQL gives."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

from millrace import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v: object) -> str:
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return f"{float(v):.4f}" if isinstance(v, float | np.floating | int | np.integer) and not isinstance(v, bool | np.bool_) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without SQL, and the tests that hold them against plain versions.
BY_HAND = {"fuzzy_match": "test_fuzzy_match", "chunk_merge": "test_chunk_merge", "page_classes": "test_page_classes", "profile_scores": "test_profile_scores", "sanitized_pages": "test_sanitized", "text_prices": "test_text_prices", "seeded_sample": "test_seeded_sample", "stream_breakers": "test_breakers"}


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(SQL) == set(BY_HAND)
    told = "".join(open(f).read() for f in glob.glob(f"{os.path.dirname(__file__)}/test_*.py"))
    assert all(f"def {name}" in told for name in BY_HAND.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
