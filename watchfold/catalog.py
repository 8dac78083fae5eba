"""The engine's queries over the supplied tables, by name; ``catalog_sql`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col, lit

from watchfold.functions import dsl, scalars, sigma
from watchfold.operators import attack, centrality, correlate, detect, fold, normalize, reports, traverse
from watchfold.operators.traverse import Options
from watchfold.plans import ingest
from watchfold.sources import config, lines, samples, testdata

DAY = 86_400_000
YEAR_1998 = (883_612_800_000, 915_148_799_999)
# Filters of the language, each with an operator of its own.
FILTERS = {
    "dsl_eq": "status == 'Failure'", "dsl_ne_missing": "status != 'Failure'", "dsl_in": "process.name IN ['cmd.exe', 'whoami.exe']",
    "dsl_contains": "user.name CONTAINS '7'", "dsl_regex": "user.name =~ '^u1[0-4]$'", "dsl_numeric": "k > 42.5 AND k <= 60",
    "dsl_not": "NOT (status == 'Success' OR k < 50)", "dsl_mixed": "class_uid == 3002 AND (host.hostname IN ['H1', 'H2'] OR NOT k >= 10) AND missing.field != 'x'"}
ATOMIC = config.Rule("Q_A", "High failure", "atomic", "high", 3002, filter="status == 'Failure' AND k >= 90", mitre="T1110 - Brute Force")
THRESHOLD = config.Rule("Q_T", "Failures", "threshold", "medium", 3002, filter="status == 'Failure'", threshold=3, window=3 * 86_400, group_by="user.name")
CHAIN = config.Rule("Q_S", "Failure then success", "chain", "critical", window=86_400, match_on="user.name",
                    steps=(config.Step("status == 'Failure'", 3002), config.Step("status == 'Success'", 3002)))
SIGMA = """
title: Shells
level: high
tags: [attack.t1059]
detection:
  shell: {process.name: [cmd.exe, powershell.exe]}
  quiet: {'user.name|contains': ['3', '5']}
  condition: shell and not quiet
"""
# Values for the scalar functions, with what SQL can say of them.
PIDS = ["0x3268", "8856", "0XFF", " 12 ", "zz", "", "0x", "-4"]
TIMES = ["2026-06-30T22:26:08.7149364Z", "2026-06-30T22:26:08+02:00", "2026-06-30 22:26:08", "nonsense", "2024-02-29T00:00:00Z"]
PATHS = ["C:\\Windows\\cmd.exe", "/usr/bin/id", "plain", "C:\\dir\\", "a/b\\c"]
XML = ("OPLC-acme,1782858033704,10.0.0.1 #1782858369,H{0},10.0.0.{0},E,<Event><System><Provider Name='P &amp; Q'/><EventID>{1}</EventID><TimeCreated SystemTime='2026-06-30T22:26:08Z'/>"
       "<Computer> h{0}.local </Computer></System><EventData><Data Name='TargetUserName'>u{0}</Data><Data Name='IpAddress'>10.0.0.{2}</Data><Data Name='LogonType'>3</Data></EventData></Event>")

# An attack path's ends: a customer whose orders were shipped by this supplier.
ATTACK = ("c69", "s11")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _csv(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",") for n in names})


@query
def stats(spark, sf):
    nodes, edges = testdata.graph(spark, sf)
    return reports.stats(events=testdata.telemetry(spark, sf), nodes=nodes, edges=edges)


@query
def timeline_hour(spark, sf):
    return reports.timeline(testdata.telemetry(spark, sf), 3_600_000)


@query
def timeline_host(spark, sf):
    return reports.timeline(testdata.telemetry(spark, sf), DAY, host="H3")


@query
def events_context(spark, sf):
    return reports.events_context(testdata.telemetry(spark, sf), "h3", 1_704_672_000_000, 1_705_276_800_000)


@query
def search_nodes(spark, sf):
    return reports.search_nodes(testdata.observed_nodes(spark, sf), "red", "file").select("node_id", "label", "event_count")


def _filter_query(text: str) -> Query:
    return lambda spark, sf: testdata.telemetry(spark, sf).where(dsl.predicate(text, normalize.get)).select("event_id")


for _name, _text in FILTERS.items():
    QUERIES[_name] = _filter_query(_text)


def _alerts(df: DataFrame) -> DataFrame:
    return _csv(df.select("alert_id", "rule_id", "ts_ms", "group_key", "event_count", "event_ids"), "event_ids")


@query
def rule_atomic(spark, sf):
    return _alerts(detect.atomic(testdata.telemetry(spark, sf), [ATOMIC]))


@query
def rule_threshold(spark, sf):
    return _alerts(detect.threshold(testdata.telemetry(spark, sf), [THRESHOLD]))


@query
def rule_sequence(spark, sf):
    return _alerts(detect.sequence(testdata.telemetry(spark, sf), [CHAIN]))


@query
def rules_shipped(spark, sf):
    return _alerts(detect.detect(testdata.telemetry(spark, sf), config.load_rules()))


@query
def sigma_rule(spark, sf):
    return testdata.telemetry(spark, sf).where(detect.matches(sigma.compile_sigma(SIGMA))).select("event_id")


@query
def alert_entities(spark, sf):
    events = testdata.telemetry(spark, sf)
    _, edges = correlate.alert_graph(detect.threshold(events, [THRESHOLD]), events)
    return edges.groupBy("etype").agg(F.count(lit(1)).alias("n"), F.countDistinct("dst_id").alias("alerts"), F.countDistinct("src_id").alias("entities"))


@query
def asof_live_process(spark, sf):
    return correlate.live_processes(testdata.telemetry(spark, sf)).select("event_id", "role", "key", "made")


@query
def address_to_host(spark, sf):
    return correlate.address_hosts(testdata.telemetry(spark, sf))


def _correlated(spark, sf):
    return correlate.correlate(testdata.telemetry(spark, sf))


@query
def lateral_movement(spark, sf):
    nodes, edges = _correlated(spark, sf)
    name = nodes.where("kind = 'host'").select("node_id", "identity_key")
    moved = edges.where("etype = 'LATERAL_MOVEMENT'")
    return moved.join(name.toDF("src_id", "src"), "src_id").join(name.toDF("dst_id", "dst"), "dst_id").select("src", "dst", "first_seen", "last_seen", "event_count")


@query
def node_fold(spark, sf):
    return _correlated(spark, sf)[0].select("kind", "identity_key", "label", "first_seen", "last_seen", "event_count")


@query
def edge_fold(spark, sf):
    nodes, edges = _correlated(spark, sf)
    end = lambda side: nodes.select(col("node_id").alias(f"{side}_id"), col("kind").alias(f"{side}_kind"), col("identity_key").alias(f"{side}_key"))
    return edges.join(end("src"), "src_id").join(end("dst"), "dst_id").select(
        "src_kind", "src_key", "dst_kind", "dst_key", "etype", "first_seen", "last_seen", "event_count")


@query
def graph_edge_fold(spark, sf):
    return testdata.graph_edges(spark, sf).select("edge_id", "first_seen", "last_seen", "event_count")


def _halves(spark, sf):
    edges = testdata.graph_edges(spark, sf).withColumns({"weight": lit(1.0), "props": F.create_map().cast("map<string,string>")})
    return edges.where("event_count = 1"), edges.where("first_seen > 0").withColumns({"first_seen": col("first_seen") - 5, "weight": lit(2.0)})


@query
def validity_merge(spark, sf):
    return fold.union_graphs(*_halves(spark, sf), "edge_id", "src_id", "dst_id", "etype").select("edge_id", "first_seen", "last_seen", "event_count", "weight")


@query
def upsert_fold(spark, sf):
    return fold.upsert(*_halves(spark, sf), "edge_id").select("edge_id", "first_seen", "last_seen", "event_count", "weight")


@query
def rewind_edges(spark, sf):
    return Options(*YEAR_1998).edges(testdata.graph_edges(spark, sf)).select("edge_id")


@query
def etype_mask(spark, sf):
    return reports.counts_by(Options(etypes=("OWNS", "USED", "no such type")).edges(testdata.graph_edges(spark, sf)), "etype")


@query
def degree(spark, sf):
    return centrality.degree(*testdata.graph(spark, sf))


def _neighbors(direction: str) -> Query:
    return lambda spark, sf: traverse.neighbors(*testdata.graph(spark, sf), "s1", Options(direction=direction))[0].select("node_id", "hop")


for _name in ("out", "in", "both"):
    QUERIES[f"neighbors_{_name}"] = _neighbors(_name)


@query
def khop2_edges(spark, sf):
    return traverse.k_hop(*testdata.graph(spark, sf), "c1", 2)[1].select("edge_id")


@query
def shortest_path_hops(spark, sf):
    nodes, edges = testdata.graph(spark, sf)
    return traverse.distances(nodes, edges, nodes.where("node_id = 'c1'"), None, Options(direction="out"))


@query
def shortest_path(spark, sf):
    nodes, edges = testdata.graph(spark, sf)
    path = traverse.shortest_path(nodes, edges, "c1", "r0") or []
    return spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(path)], "hop int, node_id string, edge_id string")


@query
def reachable(spark, sf):
    return traverse.reachable(*testdata.graph(spark, sf), "n1", Options(direction="out"))


# The whole operators: all edges of all time, and the rounds that the API runs.
@query
def component_labels(spark, sf):
    """Components don't depend on how often an edge was seen, so the sightings aren't folded first."""
    return centrality.components(testdata.graph_nodes(spark, sf), testdata.graph_sightings(spark, sf))


@query
def component_sizes(spark, sf):
    return centrality.component_sizes(component_labels(spark, sf)).groupBy("size").agg(F.count(lit(1)).alias("n"))


@query
def component_members(spark, sf):
    """Components among what was seen in 1998, with their members."""
    nodes, edges = testdata.graph(spark, sf)
    return centrality.component_members(centrality.components(nodes, edges, Options(*YEAR_1998, etypes=("OWNS",))), nodes)


@query
def pagerank(spark, sf):
    return _round(centrality.pagerank(*testdata.graph(spark, sf)), "score")


@query
def alert_proximity(spark, sf):
    nodes, edges = testdata.graph(spark, sf)
    return traverse.distances(nodes, edges, nodes.where("kind = 'alert'"), centrality.ALERT_HOPS)


@query
def risk(spark, sf):
    return _round(centrality.risk(*testdata.graph(spark, sf)), "score", places=6)


@query
def top_risk(spark, sf):
    return reports.top_risk(testdata.observed_nodes(spark, sf), 10).select("node_id", "risk_score", "event_count")


@query
def attack_paths(spark, sf):
    return _csv(_round(attack.attack_paths(*testdata.graph(spark, sf), *ATTACK, 3), "cost", "base_cost", places=6), "nodes", "edges")


@query
def graph_extent(spark, sf):
    return reports.extent(testdata.graph_edges(spark, sf))


@query
def related_by_kind(spark, sf):
    return reports.related_by_kind(*testdata.graph(spark, sf), "c1")


@query
def counts_by_class(spark, sf):
    events = testdata.telemetry(spark, sf).withColumn("class_name", scalars.class_name(col("class_uid")))
    return reports.counts_by(events, "class_uid", "class_name")


@query
def union_seeds(spark, sf):
    nodes, edges = testdata.graph(spark, sf)
    rings = [traverse.neighbors(nodes, edges, seed)[0].select("node_id") for seed in ("c1", "c2", "s1")]
    return rings[0].unionByName(rings[1]).unionByName(rings[2]).dropDuplicates(["node_id"])


@query
def visible_graph(spark, sf):
    """What a view shows that hides kinds of nodes and types of edges: an edge needs both its ends."""
    nodes, edges = reports.visible(*testdata.graph(spark, sf), kinds=("user", "process", "host"), etypes=("OWNS", "CONNECTED_TO"))
    return reports.counts_by(nodes, "kind").withColumnRenamed("kind", "name").unionByName(reports.counts_by(edges, "etype").withColumnRenamed("etype", "name"))


@query
def path_union(spark, sf):
    """Nodes and edges that any of the ranked paths goes through, each with the best rank."""
    paths = attack.attack_paths(*testdata.graph(spark, sf), *ATTACK, 3)
    return attack.union_paths(paths)


@query
def live_edges_at(spark, sf):
    return testdata.graph_edges(spark, sf).where(scalars.live_at(900_000_000_000)).select("edge_id")


def _values(spark, xs: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")


@query
def pid_parse(spark, sf):
    return _values(spark, PIDS).select("i", scalars.pid(col("x")).alias("pid"))


@query
def iso_millis(spark, sf):
    return _values(spark, TIMES).select("i", scalars.iso_millis(col("x")).alias("ms"))


@query
def epoch_auto(spark, sf):
    return testdata.telemetry(spark, sf).select("event_id", scalars.epoch(col("ts_ms").cast("string")).alias("ms"), scalars.epoch_seconds((col("ts_ms") % 100_000).cast("string")).alias("s"))


@query
def basename(spark, sf):
    return _values(spark, PATHS).select("i", scalars.basename(col("x")).alias("name"))


@query
def mitre_and_risk(spark, sf):
    rules = spark.createDataFrame([(r.id, r.severity, r.mitre) for r in config.load_rules()], "rule_id string, severity string, mitre string")
    return rules.select("rule_id", scalars.mitre_id(col("mitre")).alias("mitre_id"), scalars.alert_risk(col("severity")).alias("risk"))


def _numbers(spark, sf) -> DataFrame:
    """event_id of every event, dealt to all cores: a line takes long to parse for the few bytes it is made of, so the file's splits are too few."""
    return testdata.telemetry(spark, sf).select("event_id").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")


def _lines(spark, sf) -> DataFrame:
    """A log line for every event: three in four are Windows events, every fourth is broken."""
    e = _numbers(spark, sf)
    xml = F.lit(XML)
    for mark, value in (("{0}", col("event_id") % 50), ("{1}", F.when(col("event_id") % 2 == 0, "4624").otherwise("4625")), ("{2}", col("event_id") % 30)):
        xml = F.replace(xml, lit(mark), value.cast("string"))
    return e.select((col("event_id") + 1).alias("line_no"), F.when(col("event_id") % 4 == 3, F.concat(lit("OPLC-"), col("event_id").cast("string"))).otherwise(xml).alias("value"))


@query
def envelope_parse(spark, sf):
    records, _ = lines.split_errors(lines.decode(_lines(spark, sf)))
    return records.select("line_no", "kind", "ts_ms", "host", "source_ip")


@query
def parse_errors(spark, sf):
    _, quarantine = lines.split_errors(lines.decode(_lines(spark, sf)))
    return quarantine.select("line_no", col("error.kind").alias("kind"))


@query
def xml_flatten(spark, sf):
    records, _ = lines.split_errors(lines.decode(_lines(spark, sf)))
    return records.select("line_no", F.explode("fields").alias("k", "v"))


@query
def residue_map(spark, sf):
    records, _ = lines.split_errors(lines.decode(_lines(spark, sf)))
    events = normalize.normalize(records, config.load_mappings())
    return events.select("line_no", "event_code", "class_uid", "activity_id", "user_name", "src_ip", F.explode("extra").alias("k", "v"))


def _other_lines(spark, sf) -> DataFrame:
    """A line for every event in turn: a connection, a launch in full, a launch cut short, a file change."""
    e = _numbers(spark, sf)
    n, text = col("event_id"), lambda c: c.cast("string")
    head = F.concat(lit("OPLC-acme,1782858033704,10.0.0.1 #3.1,1782858369,H"), text(n % 50), lit(",10.0.0."), text(n % 50))
    user = F.concat(lit("corp\\u"), text(n % 30))
    body = (F.when(n % 4 == 0, F.concat_ws(",", lit("N"), lit("NETWORK"), lit("tcp"), lit("10.0.0.9"), text(1000 + n % 9), lit("203.0.113.7"), lit("443"), F.concat(lit("0x"), F.hex(n % 99)), lit("ssh")))
            .when(n % 4 == 1, F.concat_ws(",", lit("P"), lit("NEW_PROCESS"), text(n % 97), lit("cmd.exe"), lit("C:\\bin\\cmd.exe"), lit("C:\\bin"), user, text(n % 13), lit("init")))
            .when(n % 4 == 2, F.concat_ws(",", lit("P"), lit("NEW_PROCESS"), text(n % 97), lit("id")))
            .otherwise(F.concat_ws(",", lit("I"), lit("FILE_INTEGRITY"), lit("-"), lit("CREATED"), lit("C:\\a"), F.concat(text(n), lit(".txt")), F.md5(text(n)))))
    return e.select((n + 1).alias("line_no"), F.concat(head, lit(","), body).alias("value"))


@query
def wire_fields(spark, sf):
    """Every field of network, process and integrity lines."""
    records, _ = lines.split_errors(lines.decode(_other_lines(spark, sf)))
    return records.select("line_no", "kind", "ts_ms", "host", "source_ip", F.explode("fields").alias("k", "v"))


@query
def wire_events(spark, sf):
    """The same lines as events: typed columns, and all fields that have none."""
    records, _ = lines.split_errors(lines.decode(_other_lines(spark, sf)))
    events = normalize.normalize(records, config.load_mappings())
    return events.select("line_no", "class_uid", "activity_id", "src_ip", "dst_ip", "user_name", "process_name", "process_pid", "parent_pid",
                         F.explode(F.map_filter("fields", lambda _, v: v.isNotNull())).alias("k", "v"))


@query
def sample_noise(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    decoded = lines.decode(samples.noise(spark, n).select(col("id").alias("line_no"), "value"))
    return reports.counts_by(decoded.withColumn("kind", F.coalesce("kind", lit("error"))), "kind")


@query
def sample_scenarios(spark, sf):
    text = spark.createDataFrame([(i + 1, x) for i, x in enumerate(samples.scenarios())], "line_no bigint, value string")
    records, _ = lines.split_errors(lines.decode(text))
    events = ingest.to_events(records, config.load_mappings())
    _, _, alerts = ingest.build_graph(events, config.load_rules())
    return alerts.select("rule_id", "severity", "event_count")


@query
def node_ids(spark, sf):
    """Ids are the seeded hash of kind and key; every edge's ends are ids of nodes."""
    nodes, edges = _correlated(spark, sf)
    return reports.stats(nodes=nodes, distinct_ids=nodes.select("node_id").distinct(), edges=edges, sound_edges=fold.without_dangling(edges, nodes))


