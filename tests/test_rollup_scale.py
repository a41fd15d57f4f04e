"""The summary of genes broadcasts none of the tables that grow, though their files are small."""

import re

import __spark_entry__ as entry


def test_variants_are_not_broadcast(spark):
    plan = entry.queries()["A12"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    # what remains are the genes, an aggregate by brand and chromosome, of a row for each pair
    for build in re.findall(r"BroadcastExchange.*\n(.*)", plan):
        assert "HashAggregate" in build, build
