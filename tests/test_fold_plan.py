"""Folding rows moves them twice at most, to be numbered and to lie with their source, however many cells they hold."""

import re

import __spark_entry__ as entry


def test_rows_are_moved_before_they_are_cut_into_cells(spark):
    plan = entry.queries()["q_fold_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range)partitioning", plan)) <= 2
    assert "Expand" not in plan
