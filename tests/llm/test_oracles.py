import duckdb
import pytest

from tidelog.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    kind = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "VARCHAR": "string"}
    assert [kind[str(rel.types[k])] for k in at] == [dict(df.dtypes)[c] for c in cols]
    want = sorted(tuple(r[k] for k in at) for r in rel.fetchall())
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, rel=1e-12) if isinstance(x, float) else x == y for x, y in zip(g, w, strict=True))
