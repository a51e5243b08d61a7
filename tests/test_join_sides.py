"""Joins of rows that grow with the tables are merged; a broadcast would hold a whole side in the driver."""

import re

import pytest

import __spark_entry__ as entry

GROWING = ("j01_offset_lookup", "j02_range_overlap", "j04_containing_block", "j10_broken_references", "j21_deterministic_fallback")


@pytest.mark.parametrize("name", GROWING)
def test_no_broadcast(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"\w*Join\b", plan) and not re.findall(r"Broadcast\w*Join", plan)
