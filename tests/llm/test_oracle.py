"""Each query's DuckDB SQL gives the same rows."""

import duckdb
import pytest

from ledgerlens.llm.oracle import ORACLE
from ledgerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda frame: sorted(map(str, frame[columns].astype(object).itertuples(index=False, name=None)))
    assert key(got) == key(want)
