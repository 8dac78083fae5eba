"""The write path: lines to records, events, graph, alerts, risk; each step a plan that ends in a table of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col, lit

from watchfold import schema
from watchfold.operators import centrality, correlate, detect, fold, normalize, reports
from watchfold.shared import Scratch
from watchfold.sources import config, lines
from watchfold.sources.tables import Store


def parse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and quarantine of a file or folder of lines."""
    return lines.split_errors(lines.decode(lines.read_lines(spark, path)))


def to_events(records: DataFrame, mappings: dict[str, config.Mapping], first_id: int = 1, batch: int = 1) -> DataFrame:
    """Normalised events; event ids keep the order of the lines, from ``first_id`` on."""
    events = normalize.normalize(records, mappings)
    return events.withColumns({"event_id": col("line_no") + (first_id - 1), "ocsf_uid": lit(None).cast("string"), "ingest_batch": lit(batch).cast("bigint")})


def build_graph(events: DataFrame, rules: list[config.Rule]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and alerts of a batch of events; entities that alerts name keep what correlation said of them."""
    nodes, edges = correlate.correlate(events)
    alerts = detect.detect(events, rules)
    if alerts is None:
        return nodes, edges, events.sparkSession.createDataFrame([], schema.ALERT)
    more_nodes, more_edges = correlate.alert_graph(alerts, events)
    return fold.union_graphs(nodes, more_nodes, "node_id"), fold.union_graphs(edges, more_edges, "edge_id"), alerts


def ingest(spark: SparkSession, path: str, store: Store, mappings: dict | None = None, rules: list | None = None,
           iterations: int = centrality.ITERATIONS, provenance: bool = False, compat_upsert: bool = False) -> DataFrame:
    """Add a file or folder of lines to a store; returns (name, n) of what the store then holds.

    ``provenance`` also links every node and edge to its events.  ``compat_upsert``
    lets what alerts say of an entity replace its label and count.
    """
    mappings, rules = mappings or config.load_mappings(), config.load_rules() if rules is None else rules
    records, _ = parse(spark, path)
    before = store.read("events").agg(F.coalesce(F.max("event_id"), lit(0))).first()[0]
    # Written, so that lines are decoded once for events and raw lines.
    fresh = Scratch(spark, "ingest").write("events", to_events(records, mappings, before + 1))
    store.append_events(fresh, fresh.select("event_id", "raw"))
    events = store.read("events").where(col("event_id") > before)  # read again: parsed once
    nodes, edges = correlate.correlate(events)
    store.upsert("nodes", nodes)
    store.upsert("edges", edges)
    alerts = detect.detect(events, rules)
    if alerts is not None:
        # Only what is new enters the graph, so counts don't grow with every batch; its events are of this batch.
        scratch = Scratch(spark, "alerts")
        own = scratch.write("fresh", store.insert_alerts(scratch.write("found", alerts)))
        more_nodes, more_edges = correlate.alert_graph(own, events)
        for name, key, more in (("nodes", "node_id", more_nodes), ("edges", "edge_id", more_edges)):
            if compat_upsert:
                store.upsert(name, more)
            else:
                store.replace(name, fold.union_graphs(store.read(name), more, key))
    if provenance:
        of_nodes, of_edges = correlate.links(events)
        store.link("node_events", of_nodes)
        store.link("edge_events", of_edges)
    store.update_risk(centrality.risk(store.read("nodes"), fold.without_dangling(store.read("edges"), store.read("nodes")), iterations))
    check(store)
    return reports.stats(**{t: store.read(t) for t in ("events", "nodes", "edges", "alerts")})


def check(store: Store) -> None:
    """Raise where the graph isn't sound: an id twice, an edge without an end, an interval upside down."""
    nodes, edges = store.read("nodes"), store.read("edges")
    for name, key, df in (("nodes", "node_id", nodes), ("edges", "edge_id", edges)):
        n, ids, bad = df.agg(F.count(lit(1)), F.countDistinct(key), F.count(F.when(col("first_seen") > col("last_seen"), 1))).first()
        if n != ids or bad:
            raise ValueError(f"{name}: {n} rows, {ids} ids, {bad} intervals upside down")
    if edges.count() != fold.without_dangling(edges, nodes).count():
        raise ValueError("an edge has an end that is no node")


def parse_report(spark: SparkSession, path: str, sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kind, n) of the records, and the first lines that don't decode."""
    records, quarantine = parse(spark, path)
    return reports.counts_by(records, "kind"), quarantine.orderBy("line_no").limit(sample)


def check_config(mappings_path=None, rules_path=None) -> dict[str, int]:
    """Load both files, compile every filter, and count."""
    from watchfold.functions import dsl

    mappings = config.load_mappings(*([mappings_path] if mappings_path else []))
    rules = config.load_rules(*([rules_path] if rules_path else []))
    for rule in rules:
        for part in rule.steps or (rule,):
            dsl.parse(part.filter)
    return {"mappings": len(mappings), "rules": len(rules)}
