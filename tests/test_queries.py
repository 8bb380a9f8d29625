"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from assaykit.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, db, name):
    ours = queries()[name](spark, DATA)
    theirs = db.execute(oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    norm = lambda rows: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert norm(ours.select(*names).collect()) == norm(theirs.fetchall())


def test_split3_keeps_every_split(spark):
    rows = queries()["split3"](spark, DATA).groupBy("split").count().collect()
    assert {r["split"] for r in rows} == {"train", "dev", "test"}
