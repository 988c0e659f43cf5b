"""The corpus of customers, counted from the tables alone."""

import os

import pytest

from tracewell.operators import events as ops
from tracewell.plans.corpus import corpus

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_no_customer_order_or_line_is_left_out(spark):
    events = corpus(spark, DIR, "b")
    for kind, table in ((3, "customer"), (5, "orders"), (7, "lineitem")):
        assert ops.of_kind(events, kind).count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
