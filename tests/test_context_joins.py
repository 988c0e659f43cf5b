"""Neighbourhoods send no table to the driver, however small a scan is estimated to be."""

import os

import pytest

from tracewell.operators import events as ops
from tracewell.plans import queries
from tracewell.plans.corpus import corpus

DIR = "/root/testdata/sf0.001"


def joins(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_no_side_is_broadcast_with_the_default_radius(spark):
    events = corpus(spark, DIR, "a")
    plan = joins(ops.neighbourhood(events, ops.of_kind(events, 9)))
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", ["error_context", "error_context_default"])
def test_registered_queries_broadcast_nothing(spark, name):
    assert "Broadcast" not in joins(queries.QUERIES[name](spark, DIR))
