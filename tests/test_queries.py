"""Every query of the engine equals its DuckDB SQL."""

import duckdb
import pandas as pd
import pytest

from varlens import queries as engine

from .conftest import DATA

NAMES = sorted(engine.oracle_sql())


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def rows(frame, columns):
    return sorted(str(tuple(None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, oracle, sf_dir, name):
    got, want = engine.queries()[name](spark, sf_dir).toPandas(), oracle.sql(engine.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
