"""Some registered query answers for all errors with the reference's own radius."""

import os

import pytest

from tracewell.operators import events as ops
from tracewell.plans import queries
from tracewell.plans.corpus import corpus

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_every_error_is_a_centre_with_the_default_radius(spark):
    found = queries.QUERIES["error_context_default"](spark, DIR).collect()
    errors = {(r["log_id"], r["event_index"]) for r in ops.of_kind(corpus(spark, DIR, "a"), 9).collect()}
    assert {(r["log_id"], r["centre"]) for r in found} == errors
    assert {(r["log_id"], r["centre"], r["event_index"]) for r in found} >= {(i, k, k) for i, k in errors}
    assert max(sum(r["log_id"] == i and r["centre"] == k for r in found) for i, k in errors) == 21
