"""Counts, histograms, searches and lists over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col, lit

from watchfold import schema
from watchfold.functions import scalars
from watchfold.operators import fold


def stats(**tables: DataFrame) -> DataFrame:
    """(name, n): the number of rows of each table."""
    parts = [t.agg(F.count(lit(1)).alias("n")).select(lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def timeline(events: DataFrame, bucket_ms: int = 3_600_000, host: str | None = None, ts: str = "ts_ms") -> DataFrame:
    """(bucket, n) in order; buckets are cut toward zero, at least a millisecond wide; the host is compared with its case."""
    bucket = max(int(bucket_ms), 1)
    own = events if host is None else events.where(col("host") == host)
    return own.groupBy(F.expr(f"({ts} div {bucket}) * {bucket}").alias("bucket")).agg(F.count(lit(1)).alias("n")).orderBy("bucket")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(lit(1)).alias("n")).orderBy(*keys)


def extent(edges: DataFrame, pad: float = 0.01, least_pad_ms: int = 1000) -> DataFrame:
    """(low, high): when the graph was seen, with some room at both ends."""
    ends = edges.agg(F.min("first_seen").alias("a"), F.max("last_seen").alias("b"))
    room = F.greatest(F.floor((col("b") - col("a")) * pad), lit(least_pad_ms)).cast("bigint")
    return ends.select((col("a") - room).alias("low"), (col("b") + room).alias("high"))


def related_by_kind(nodes: DataFrame, edges: DataFrame, seed, shown: int = 12) -> DataFrame:
    """(kind, n, labels): a node's neighbours by kind, with the first labels in order."""
    ends = edges.where((col("src_id") == lit(seed)) | (col("dst_id") == lit(seed)))
    other = ends.select(F.when(col("src_id") == lit(seed), col("dst_id")).otherwise(col("src_id")).alias("node_id")).distinct()
    own = nodes.join(other, "node_id", "left_semi")
    rank = F.row_number().over(_window("kind", "label", "node_id"))
    first = own.withColumn("rank", rank)
    return first.groupBy("kind").agg(
        F.count(lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(col("rank") <= shown, F.struct("rank", "label")))), lambda x: x["label"]), ",").alias("labels"))


def _window(partition: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(*order)


def search_nodes(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 50, wildcards: bool = False) -> DataFrame:
    """Nodes whose label or identity holds the text in any case, the most observed first.

    ``wildcards`` leaves % and _ in the text their meaning.  An unknown kind filters nothing.
    """
    text = query if wildcards else query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = nodes.where(col("label").ilike(f"%{text}%") | col("identity_key").ilike(f"%{text}%"))
    if kind in schema.NODE_KINDS:
        hit = hit.where(col("kind") == kind)
    return hit.orderBy(F.desc("event_count"), "node_id").limit(min(max(limit, 1), 500))


def events_context(events: DataFrame, host: str, low: int, high: int, limit: int = 1000) -> DataFrame:
    """Summaries of a host's events within [low, high], the earliest first; the host in any case."""
    own = events.where((F.lower("host") == host.lower()) & col("ts_ms").between(low, high))
    return own.select(*(c for c in schema.EVENT_SUMMARY if c in events.columns)).orderBy("ts_ms", "event_id").limit(limit)


def latest_alerts(alerts: DataFrame, limit: int = 200) -> DataFrame:
    return alerts.orderBy(F.desc("ts_ms"), "alert_id").limit(min(max(limit, 1), 2000))


def top_risk(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.orderBy(F.desc("risk_score"), F.desc("event_count"), "node_id").limit(min(max(limit, 1), 200))


def top(scores: DataFrame, limit: int = 50) -> DataFrame:
    return scores.orderBy(F.desc("score"), "node_id").limit(min(max(limit, 1), 500))


def hydrate(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of a list of ids, in one join; missing ones are left out."""
    return nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def evidence(alerts: DataFrame, events: DataFrame, alert_id: str) -> DataFrame:
    """An alert's events in the order in which it lists them."""
    ids = alerts.where(col("alert_id") == alert_id).select(F.posexplode("event_ids").alias("at", "event_id"))
    return ids.join(events, "event_id").select("at", *(c for c in schema.EVENT_SUMMARY if c in events.columns)).orderBy("at")


def by_unsigned_id(df: DataFrame, key: str) -> DataFrame:
    """Rows in the order of their ids as unsigned numbers."""
    return df.orderBy(scalars.unsigned(col(key)))


def visible(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = (), etypes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes of these kinds, and edges of these types both of whose ends are among them; nothing named means all."""
    shown = nodes.where(col("kind").isin(*kinds)) if kinds else nodes
    kept = edges.where(col("etype").isin(*etypes)) if etypes else edges
    return shown, fold.without_dangling(kept, shown)
