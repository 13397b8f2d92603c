import math

import duckdb
import pytest

from tidelog import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    return x


def kind(name: str) -> str:
    name = name.lower().replace("integer", "int").replace("varchar", "string")
    return {"bigint": "long", "long": "long", "int": "int"}.get(name, name)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    assert rows
    if name in catalog.ORACLES:
        rel = con.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == cols
        types = dict(zip(rel.columns, map(str, rel.types), strict=True))
        assert {c: kind(t) for c, t in df.dtypes} == {c: kind(types[c]) for c in cols}
        at = [rel.columns.index(c) for c in cols]
        want = [tuple(norm(r[k]) for k in at) for r in rel.fetchall()]
        assert sorted(rows, key=str) == sorted(want, key=str)
