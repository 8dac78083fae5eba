"""Folding emitted observations into the nodes and edges of the graph, and merging graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col, lit

from watchfold.functions import scalars


def fold_nodes(observed: DataFrame) -> DataFrame:
    """Observations (kind, identity_key, label, ts_ms, event_id, at) to nodes: one per kind and key, with its first label in input order."""
    folded = observed.groupBy("kind", "identity_key").agg(
        F.min_by("label", F.struct("event_id", "at")).alias("label"), *scalars.observed())
    return folded.select(scalars.node_id(col("kind"), col("identity_key")).alias("node_id"), "kind", "identity_key", "label",
                         "first_seen", "last_seen", "event_count", lit(0.0).cast("float").alias("risk_score"),
                         F.create_map().cast("map<string,string>").alias("props"))


def fold_edges(observed: DataFrame) -> DataFrame:
    """Observations (src_kind, src_key, dst_kind, dst_key, etype, ts_ms) to edges: one per pair of nodes and type."""
    ends = observed.select(scalars.node_id(col("src_kind"), col("src_key")).alias("src_id"),
                           scalars.node_id(col("dst_kind"), col("dst_key")).alias("dst_id"), "etype", "ts_ms")
    folded = ends.groupBy("src_id", "dst_id", "etype").agg(*scalars.observed())
    return folded.select(scalars.edge_id(col("src_id"), col("dst_id"), col("etype")).alias("edge_id"), "src_id", "dst_id", "etype",
                         "first_seen", "last_seen", "event_count", lit(1.0).cast("float").alias("weight"),
                         F.create_map().cast("map<string,string>").alias("props"))


def with_props(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Nodes with the properties (kind, identity_key, name, value, event_id); of one name the last in input order stays."""
    last = props.groupBy("kind", "identity_key", "name").agg(F.max_by("value", "event_id").alias("value"))
    maps = last.groupBy("kind", "identity_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("own"))
    return nodes.join(maps, ["kind", "identity_key"], "left").select(
        *(F.coalesce("own", "props").alias("props") if c == "props" else c for c in nodes.columns))


def union_graphs(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """Two graphs' nodes or edges as one: intervals united and counts added; all else from the first that has it.

    Columns that a key fixes may be named with it: where both sides were folded by some of them, nothing is shuffled again.
    """
    both = first.withColumn("_order", lit(0)).unionByName(second.withColumn("_order", lit(1)))
    own = [c for c in first.columns if c not in (*key, "first_seen", "last_seen", "event_count", "props")]
    folded = both.groupBy(*key).agg(
        *(F.min_by(c, "_order").alias(c) for c in own), *scalars.merged(),
        F.min_by("props", "_order").alias("_p0"), F.max_by("props", "_order").alias("_p1"))
    keep = F.map_filter("_p1", lambda k, _: ~F.map_contains_key("_p0", k))
    return folded.withColumn("props", F.map_concat("_p0", keep)).select(*first.columns)


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows with fresh ones over them: intervals are widened, all other columns replaced."""
    new = fresh.select(*(col(c).alias(f"_{c}") for c in fresh.columns))
    joined = stored.join(new, col(key) == col(f"_{key}"), "full")
    widened = {"first_seen": F.least("first_seen", "_first_seen"), "last_seen": F.greatest("last_seen", "_last_seen")}
    return joined.select(*(widened.get(c, F.when(col(f"_{key}").isNotNull(), col(f"_{c}")).otherwise(col(c))).alias(c) for c in stored.columns))


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select(*edges.columns)
