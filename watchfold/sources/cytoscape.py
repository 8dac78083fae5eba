"""Graphs as JSON in the shape that Cytoscape draws: ids are strings, kinds and types are names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col

from watchfold.functions.scalars import unsigned


def _id(name: str):
    return unsigned(col(name)).cast("string")


def node_json(nodes: DataFrame) -> DataFrame:
    """(json): one node a row."""
    return nodes.select(F.to_json(F.struct(F.struct(
        _id("node_id").alias("id"), "label", "kind", col("risk_score").alias("risk"), "first_seen", "last_seen", "event_count").alias("data"))).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.struct(
        _id("edge_id").alias("id"), _id("src_id").alias("source"), _id("dst_id").alias("target"), "etype",
        "first_seen", "last_seen", "event_count", "weight").alias("data"))).alias("json"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(json): one document {nodes, edges}, for a result that a screen can show."""
    both = node_json(nodes).withColumn("is_node", F.lit(True)).unionByName(edge_json(edges).withColumn("is_node", F.lit(False)))
    part = lambda of: F.array_join(F.array_sort(F.collect_list(F.when(of, col("json")))), ",")
    return both.agg(F.concat(F.lit('{"nodes":['), part(col("is_node")), F.lit('],"edges":['), part(~col("is_node")), F.lit("]}")).alias("json"))
