"""Adapters that show star-schema tables as telemetry and as a graph, for queries and benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col, lit

from watchfold.functions import scalars


NAMES = ["cmd.exe", "powershell.exe", "whoami.exe", "svchost.exe"]


def millis(ts: str):
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as normalised events: errors and signups are logons, views launches, purchases connections, clicks file changes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    when = lambda **kinds: reduce(lambda w, kv: w.when(col("event_type") == kv[0], kv[1]), kinds.items(), F)
    text = lambda c: c.cast("string")
    k = F.get_json_object("props", "$.k")
    status = when(error="Failure", signup="Success")
    fields = F.map_filter(F.map_from_arrays(
        F.array(lit("k"), lit("status"), lit("file.path"), lit("activity_name")),
        F.array(k, status, when(click=F.concat(lit("C:\\data\\"), k, lit(".txt"))), when(click="MODIFIED"))), lambda _, v: v.isNotNull())
    return e.select(
        "event_id", millis("ts").alias("ts_ms"), when(error=3002, signup=3002, view=1007, purchase=4001, click=1001).cast("int").alias("class_uid"),
        lit(None).cast("int").alias("activity_id"), when(error=4625, signup=4624).cast("int").alias("event_code"),
        F.concat(lit("H"), text(col("user_id") % 20)).alias("host"), F.concat(lit("10.0.0."), text(col("user_id") % 16)).alias("src_ip"),
        when(purchase=F.concat(lit("203.0.113."), text(col("event_id") % 50))).alias("dst_ip"), F.concat(lit("u"), text(col("user_id"))).alias("user_name"),
        lit(None).cast("string").alias("actor_user"), when(view=col("event_id") % 97, purchase=(col("event_id") * 3) % 97).alias("process_pid"),
        when(view=(col("event_id") * 7) % 97).alias("parent_pid"), F.element_at(F.array(*map(lit, NAMES)), (col("event_id") % 4 + 1).cast("int")).alias("process_name"),
        when(error=2, signup=1).cast("int").alias("status_id"), lit(None).cast("int").alias("severity_id"), fields.alias("fields"),
        F.create_map(lit("env.source_ip"), F.concat(lit("10.0.0."), text((col("user_id") * 3) % 16))).alias("extra"))


def graph_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers own orders, orders use parts and connect to suppliers, customers and suppliers belong to nations, nations to regions: a row a sighting."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda mark, c: F.concat(lit(mark), col(c).cast("string"))

    def seen(df, src, dst, etype, ts):
        return df.select(src.alias("src_id"), dst.alias("dst_id"), lit(etype).alias("etype"), ts.cast("bigint").alias("ts_ms"))

    never = lit(0)
    parts = [
        seen(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "OWNS", millis("o_orderdate")),
        seen(t("lineitem"), key("o", "l_orderkey"), key("p", "l_partkey"), "USED", millis("l_shipdate")),
        seen(t("lineitem"), key("o", "l_orderkey"), key("s", "l_suppkey"), "CONNECTED_TO", millis("l_shipdate")),
        seen(t("customer"), key("c", "c_custkey"), key("n", "c_nationkey"), "BELONGS_TO", never),
        seen(t("supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), "BELONGS_TO", never),
        seen(t("nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), "BELONGS_TO", never)]
    return reduce(DataFrame.unionAll, parts)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sightings folded to an edge for each pair of nodes and type."""
    folded = graph_sightings(spark, sf_dir).groupBy("src_id", "dst_id", "etype").agg(*scalars.observed())
    return folded.withColumn("edge_id", F.concat_ws(":", "src_id", "dst_id", "etype"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def own(df, mark, c, kind, label, risk):
        i = F.concat(lit(mark), col(c).cast("string"))
        return df.select(i.alias("node_id"), lit(kind).alias("kind"), i.alias("identity_key"), label.alias("label"), risk.cast("double").alias("risk_score"))

    parts = [
        own(t("customer"), "c", "c_custkey", "user", col("c_name"), col("c_custkey") % 100), own(t("supplier"), "s", "s_suppkey", "host", col("s_name"), col("s_suppkey") % 100),
        own(t("part"), "p", "p_partkey", "file", col("p_name"), col("p_partkey") % 100),
        own(t("orders"), "o", "o_orderkey", "process", col("o_orderpriority"), col("o_orderkey") % 100),
        own(t("nation"), "n", "n_nationkey", "domain", col("n_name"), lit(0)), own(t("region"), "r", "r_regionkey", "alert", col("r_name"), lit(0))]
    return reduce(DataFrame.unionAll, parts)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = graph_nodes(spark, sf_dir)
    return nodes, graph_edges(spark, sf_dir)


def observed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with when and how often an edge touched them."""
    nodes, edges = graph(spark, sf_dir)
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("node_id"), "first_seen", "last_seen", "event_count")
    return nodes.join(ends.groupBy("node_id").agg(*scalars.merged()), "node_id")


