"""Every registered query at the smallest scale, against its SQL oracle where it has one."""

import duckdb
import pytest

from quirefold.plans.fixtures import DRIVER_TABLES
from quirefold.plans.registry import ORACLES, QUERIES
from tests.oracle_check import canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        assert canon(got) == canon(duck.execute(ORACLES[name]).df())
