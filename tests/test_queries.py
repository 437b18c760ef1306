"""Every query against its oracle SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from partweave.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iuf":
            df[c] = df[c].map(lambda v: "" if v is pd.NA or v != v else repr(round(float(v), 6) + 0.0))
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NA else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, data, con, name):
    ours, theirs = canonical(QUERIES[name](spark, data).toPandas()), canonical(con.sql(ORACLE[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs) > 0
    assert (ours.values == theirs.values).all()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
