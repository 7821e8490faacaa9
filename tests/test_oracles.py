"""Every query of the engine that has SQL, at the smallest scale, against that SQL."""

import os

import duckdb
import pytest

from pipeweave.plans import corridors, inorder, planning, shapes  # noqa: F401  add their queries to the registry
from pipeweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, (bool, str)):
            return str(v)
        return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)
