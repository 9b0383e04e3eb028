"""Queries with SQL give what another engine computes over the same tables."""

import duckdb
import pytest

from quillmesh.llm import registry

DIR = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert canonical(registry.QUERIES[name](spark, DIR).toPandas()) == canonical(con.sql(registry.ORACLES[name]).df())
