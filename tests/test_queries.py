"""Every registered query next to its SQL, and the driver contract."""

import pytest

import __spark_entry__
from verification.check import compare, connect
from verification.oracle import ORACLES
from verification.queries import REGISTRY

SF = "/root/testdata/sf0.001"
BANNED = (
    "PythonUDF",
    "ArrowEvalPython",
    "BatchEvalPython",
    "MapInPandas",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, connection, name):
    """Equal rows, from a plan without Python workers and nested loops."""
    frame = REGISTRY[name](spark, SF)
    assert not [word for word in BANNED if word in plan(frame)]
    assert compare(frame, connection, ORACLES[name]) == ""
