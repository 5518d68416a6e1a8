"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from folioflow.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return [canon(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    if name not in registry.ORACLES:
        return
    rel = db.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    rows = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert sorted(names) == sorted(got.column_names)
    key = lambda r: [canon(r[c]) for c in sorted(names)]
    assert sorted(map(key, got.to_pylist()), key=str) == sorted(map(key, rows), key=str)
