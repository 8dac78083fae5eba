"""The store: Parquet tables under one folder, written whole or appended, read with pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import col

from watchfold import schema
from watchfold.operators import centrality, fold
from watchfold.shared import remove

SCHEMAS = {"events": schema.EVENT, "event_raw": schema.EVENT_RAW, "nodes": schema.NODE, "edges": schema.EDGE,
           "node_events": schema.LINK, "edge_events": schema.LINK, "alerts": schema.ALERT}


class Store:
    """Seven tables.  A replaced table is a new version; a pointer file names the one that counts, so readers never see half a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _versions(self, name: str) -> list[str]:
        fs, folder = self._fs(f"{self.path}/{name}/_versions")
        if not fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(folder))

    def _current(self, name: str) -> str | None:
        versions = self._versions(name)
        return f"{self.path}/{name}/{versions[-1]}" if versions else None

    def read(self, name: str) -> DataFrame:
        """A table as it is; an empty one where nothing was written."""
        if not (path := self._current(name)):
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(SCHEMAS[name]).parquet(path)
        return df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns)

    def replace(self, name: str, df: DataFrame) -> None:
        """Write a new version and point to it; the version before stays for its readers, older ones are dropped."""
        versions = self._versions(name)
        number = int(versions[-1].split("-")[0]) + 1 if versions else 0
        version = f"{number:08d}-{uuid.uuid4().hex}"
        writer = df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write
        writer.parquet(f"{self.path}/{name}/{version}")
        fs, pointer = self._fs(f"{self.path}/{name}/_versions/{version}")
        fs.create(pointer).close()
        for old in versions[:-1]:
            remove(self.spark, f"{self.path}/{name}/_versions/{old}")
            remove(self.spark, f"{self.path}/{name}/{old}")

    def append(self, name: str, df: DataFrame) -> None:
        path = self._current(name)
        if path is None:
            return self.replace(name, df)
        df.select(*self.read(name).columns).write.mode("append").parquet(path)

    def append_events(self, events: DataFrame, raw: DataFrame | None = None) -> None:
        """Events are added as they are; raw lines only where their event has none yet."""
        self.append("events", events)
        if raw is not None:
            fresh = raw.dropDuplicates(["event_id"]).join(self.read("event_raw").select("event_id"), "event_id", "left_anti")
            self.append("event_raw", fresh)

    def upsert(self, name: str, fresh: DataFrame) -> None:
        """Nodes or edges: widen intervals, replace the rest."""
        self.replace(name, fold.upsert(self.read(name), fresh, "node_id" if name == "nodes" else "edge_id"))

    def update_risk(self, scores: DataFrame) -> None:
        self.replace("nodes", centrality.with_risk(self.read("nodes"), scores))

    def link(self, name: str, rows: DataFrame) -> None:
        """(id, event_id, ts_ms) of node_events or edge_events; those already there are left."""
        fresh = rows.dropDuplicates(["id", "event_id"]).join(self.read(name).select("id", "event_id"), ["id", "event_id"], "left_anti")
        self.append(name, fresh)

    def insert_alerts(self, alerts: DataFrame) -> DataFrame:
        """Alerts by id; a later one replaces an earlier one.  Returns those whose id was not there before."""
        before = self.read("alerts")
        fresh = alerts.join(before.select("alert_id"), "alert_id", "left_anti").select(*before.columns)
        both = before.withColumn("_age", F.lit(1)).unionByName(alerts.withColumn("_age", F.lit(0)))
        first = Window.partitionBy("alert_id").orderBy("_age", F.desc("ts_ms"))
        self.replace("alerts", both.withColumn("_n", F.row_number().over(first)).where(col("_n") == 1))
        return fresh
