"""Lines are decoded once, whatever kinds of records they hold, and repeated keys keep their first value."""

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from watchfold import catalog
from watchfold.functions import maps

SF = "/root/testdata/sf0.001"


def test_events_of_all_kinds_come_from_one_scan(spark):
    for name in ("residue_map", "wire_events"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1, name


def test_first_and_last_of_repeated_keys(spark):
    rows = [([("a", "1"), ("b", "2"), ("a", "3"), ("c", None), (None, "4")],), ([("a", "1"), ("b", "2")],), ([],), (None,)]
    df = spark.createDataFrame(rows, "x array<struct<k:string,v:string>>").select(maps.first_wins(col("x")).alias("first"), maps.last_wins(col("x")).alias("last"))
    assert [tuple(r) for r in df.collect()] == [({"a": "1", "b": "2"}, {"a": "3", "b": "2"}), ({"a": "1", "b": "2"},) * 2, ({}, {}), (None, None)]
    plan = df.select(F.col("first"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan


def test_lines_are_parsed_by_all_cores(spark):
    for name in ("envelope_parse", "parse_errors", "residue_map", "wire_events"):
        assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
