"""Every registered query of the core against its SQL, on the smallest of the given tables."""

import os

import duckdb
import pytest

from quire.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    base = duckdb.connect()
    for name in os.listdir(FOLDER):
        base.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return base


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, base, name):
    said = base.execute(catalog.ORACLES[name])
    found = catalog.QUERIES[name](spark, FOLDER)
    names = [c[0] for c in said.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, said.fetchall())


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
