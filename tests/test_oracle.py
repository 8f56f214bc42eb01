"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from quillrank.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "-"
    return repr(0.0 if v == 0 else v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
