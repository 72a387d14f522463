"""Every query with SQL of its own against DuckDB on the smallest tables."""

import os

import numpy as np
import pytest

from starfold import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns, key=lambda c: (got[c].dtype == float, c))
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        a, b = got[c].to_numpy(), want[c].to_numpy()
        if got[c].dtype == float:
            np.testing.assert_allclose(a, b.astype(float), atol=2e-6, rtol=1e-9, equal_nan=True)
        else:
            assert (a == b).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got) and len(got.drop_duplicates()) == len(got)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.isfinite(got[c]).mean() > 0.8, c
