"""The read path: investigation queries over a store, each a DataFrame; None stands for "not found"."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col

from watchfold import schema
from watchfold.operators import attack, centrality, reports, traverse
from watchfold.operators.traverse import Options
from watchfold.sources import cytoscape
from watchfold.sources.tables import Store

CONTEXT_MS = 300_000


class Api:
    def __init__(self, store: Store):
        self.store = store

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        return self.store.read("nodes"), self.store.read("edges")

    def health(self) -> dict:
        return {"status": "ok"}

    def stats(self) -> DataFrame:
        return reports.stats(**{t: self.store.read(t) for t in ("events", "nodes", "edges", "alerts")})

    def search(self, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
        return reports.search_nodes(self.store.read("nodes"), query, kind, limit)

    def node(self, node_id: int) -> DataFrame | None:
        found = self.store.read("nodes").where(col("node_id") == node_id)
        return None if found.isEmpty() else found

    def neighbors(self, node_id: int, hops: int = 1, low=None, high=None, etypes=(), direction: str = "both") -> DataFrame:
        """(json): the neighbourhood as a drawn graph; 1 to 5 hops."""
        nodes, edges = self._graph()
        ids, followed = traverse.k_hop(nodes, edges, node_id, min(max(hops, 1), 5), Options(low, high, tuple(etypes), direction))
        return cytoscape.graph_json(reports.hydrate(ids, nodes), followed)

    def path(self, src: int, dst: int, low=None, high=None) -> DataFrame | None:
        nodes, edges = self._graph()
        path = traverse.shortest_path(nodes, edges, src, dst, Options(low, high))
        if path is None:
            return None
        used = [e for _, e in path if e is not None]
        return cytoscape.graph_json(nodes.where(col("node_id").isin([n for n, _ in path])), edges.where(col("edge_id").isin(used)))

    def timeline(self, bucket_ms: int = 3_600_000, host: str | None = None) -> DataFrame:
        return reports.timeline(self.store.read("events"), bucket_ms, host)

    def events(self, host: str, ts: int, before: int = CONTEXT_MS, after: int = CONTEXT_MS, limit: int = 1000) -> DataFrame:
        return reports.events_context(self.store.read("events"), host, ts - before, ts + after, limit)

    def event(self, event_id: int) -> DataFrame | None:
        found = self.store.read("events").where(col("event_id") == event_id).select(*schema.EVENT_SUMMARY)
        found = found.join(self.store.read("event_raw"), "event_id", "left")
        return None if found.isEmpty() else found

    def alerts(self, limit: int = 200) -> DataFrame:
        return reports.latest_alerts(self.store.read("alerts"), limit)

    def alert(self, alert_id: str) -> tuple[DataFrame, DataFrame] | None:
        """The alert, and its events in order."""
        found = self.store.read("alerts").where(col("alert_id") == alert_id)
        if found.isEmpty():
            return None
        return found, reports.evidence(self.store.read("alerts"), self.store.read("events"), alert_id)

    def pagerank(self, damping: float = centrality.DAMPING, iterations: int = centrality.ITERATIONS, limit: int = 50) -> DataFrame:
        nodes, edges = self._graph()
        best = reports.top(centrality.pagerank(nodes, edges, damping, iterations), limit)
        return best.join(nodes.select("node_id", "label", "kind"), "node_id").orderBy(F.desc("score"), "node_id")

    def risk(self, limit: int = 10) -> DataFrame:
        return reports.top_risk(self.store.read("nodes"), limit)

    def components(self, limit: int = 50) -> DataFrame:
        nodes, edges = self._graph()
        return centrality.component_sizes(centrality.components(nodes, edges)).limit(min(max(limit, 1), 500))

    def attack_paths(self, src: int, dst: int, k: int = 3, low=None, high=None) -> DataFrame | None:
        """(rank, cost, base_cost, nodes, edges, etypes, mitre) of each path; techniques come from alerts on it."""
        nodes, edges = self._graph()
        found = attack.attack_paths(nodes, edges, src, dst, k, Options(low, high, (), "out"))
        if found.isEmpty():
            return None
        used = found.select("rank", F.posexplode("edges").alias("at", "edge_id")).join(edges.select("edge_id", "etype"), "edge_id")
        etypes = used.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "etype"))), lambda x: x["etype"]).alias("etypes"))
        seen = found.select("rank", F.posexplode("nodes").alias("at", "node_id")).join(nodes.where("kind = 'alert'"), "node_id")
        mitre = seen.groupBy("rank").agg(F.collect_list(F.try_element_at("props", F.lit("mitre"))).alias("mitre"))
        return found.join(etypes, "rank", "left").join(mitre, "rank", "left").orderBy("rank")
