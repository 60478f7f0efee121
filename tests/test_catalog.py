"""Every registered matrix query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from coordtab.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in SF.iterdir():
        name = path.name.split(".")[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    got = canonical(catalog.queries()[name](spark, str(SF)).toPandas())
    expected = canonical(tables.execute(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, expected)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, str(SF)).count() > 0
