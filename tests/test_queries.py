"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from marlstone.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(repr(tuple(tidy(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    out = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(out.columns) == sorted(names)
    assert cells([tuple(r) for r in out.collect()], out.columns) == cells(want.fetchall(), names)
