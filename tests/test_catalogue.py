"""Every query of the catalogue against its SQL in DuckDB, on the smallest provided tables."""

import os

import pandas as pd
import pytest

from vigil import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and len(got) == len(want)
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_entry_without_the_text_operators(monkeypatch):
    import builtins
    import importlib

    entry = importlib.import_module("__spark_entry__")
    real = builtins.__import__

    def refuse(name, *args, **kw):
        if name == "corpus_pipeline" or name.startswith("vigil.llm"):
            raise ImportError(name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", refuse)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLES)
