"""Every registered query with SQL equals DuckDB on the small tables."""

from __future__ import annotations

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)

from repolens.plans import ORACLES, QUERIES  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str)
