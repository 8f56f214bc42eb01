"""Queries of this subpackage that SQL can express give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

from quillrank.llm.queries import oracle_sql, queries

D = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "-"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries()[name](spark, D)
    cols = sorted(df.columns)
    found = con.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
