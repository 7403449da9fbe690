"""The queries that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from cellweave.llm import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(entry.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
