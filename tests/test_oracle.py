"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf, name):
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = plain(con.sql(entry.oracle_sql()[name]).df())
    got = plain(entry.queries()[name](spark, sf).toPandas())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c], rtol=0, atol=1e-6, equal_nan=True), c
        else:
            assert (got[c].fillna("") == want[c].fillna("")).all(), c


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "id", "score", "text"]
