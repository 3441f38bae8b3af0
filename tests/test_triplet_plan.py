"""Joins of GEO10 whatever Spark expects of their sizes."""

import re

from conftest import SF

from cellspark.queries import QUERIES


def test_no_list_of_tiles_is_broadcast(spark):
    # Tiles are made from few bytes of orders, which Spark takes for their size.
    plan = QUERIES["geo10_triplets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"BroadcastHashJoin \[(\w+)#", plan)
    assert set(keys) <= {"_range"} and plan.count("SortMergeJoin") >= 2
