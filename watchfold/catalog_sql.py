"""DuckDB SQL for the catalog's queries, over the same tables."""

from __future__ import annotations

from watchfold import catalog as c
from watchfold.sources import config

TELE = """tele AS (
    SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, event_type, user_id, props ->> 'k' AS k,
           CASE event_type WHEN 'error' THEN 3002 WHEN 'signup' THEN 3002 WHEN 'view' THEN 1007 WHEN 'purchase' THEN 4001 WHEN 'click' THEN 1001 END AS class_uid,
           CASE event_type WHEN 'error' THEN 4625 WHEN 'signup' THEN 4624 END AS event_code,
           CASE event_type WHEN 'error' THEN 'Failure' WHEN 'signup' THEN 'Success' END AS status,
           'H' || user_id % 20 AS host, '10.0.0.' || user_id % 16 AS src_ip, '10.0.0.' || (user_id * 3) % 16 AS env_ip,
           CASE event_type WHEN 'purchase' THEN '203.0.113.' || event_id % 50 END AS dst_ip, 'u' || user_id AS user_name,
           CASE event_type WHEN 'view' THEN event_id % 97 WHEN 'purchase' THEN (event_id * 3) % 97 END AS pid,
           CASE event_type WHEN 'view' THEN (event_id * 7) % 97 END AS ppid,
           ['cmd.exe', 'powershell.exe', 'whoami.exe', 'svchost.exe'][event_id % 4 + 1] AS process_name
    FROM events)"""
_MS = "epoch_us({0}) // 1000"
EDGES = f"""seen AS (
    SELECT 'c' || o_custkey AS src_id, 'o' || o_orderkey AS dst_id, 'OWNS' AS etype, {_MS.format('o_orderdate')} AS ts_ms FROM orders
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'USED', {_MS.format('l_shipdate')} FROM lineitem
    UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'CONNECTED_TO', {_MS.format('l_shipdate')} FROM lineitem
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'BELONGS_TO', 0 FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'BELONGS_TO', 0 FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'BELONGS_TO', 0 FROM nation),
edges AS MATERIALIZED (
    SELECT src_id, dst_id, etype, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*) AS event_count, src_id || ':' || dst_id || ':' || etype AS edge_id
    FROM seen GROUP BY ALL)"""
NODES = """nodes AS MATERIALIZED (
    SELECT 'c' || c_custkey AS node_id, 'user' AS kind, c_name AS label, CAST(c_custkey % 100 AS DOUBLE) AS risk_score FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'host', s_name, s_suppkey % 100 FROM supplier
    UNION ALL SELECT 'p' || p_partkey, 'file', p_name, p_partkey % 100 FROM part
    UNION ALL SELECT 'o' || o_orderkey, 'process', o_orderpriority, o_orderkey % 100 FROM orders
    UNION ALL SELECT 'n' || n_nationkey, 'domain', n_name, 0 FROM nation
    UNION ALL SELECT 'r' || r_regionkey, 'alert', r_name, 0 FROM region)"""
OBSERVED = """observed AS (
    SELECT node_id, any_value(label) AS label, any_value(kind) AS kind, any_value(risk_score) AS risk_score, CAST(sum(event_count) AS BIGINT) AS event_count
    FROM nodes JOIN (SELECT unnest([src_id, dst_id]) AS node_id, event_count FROM edges) USING (node_id) GROUP BY node_id)"""
BOTH = "steps AS MATERIALIZED (SELECT src_id AS a, dst_id AS b, edge_id FROM edges UNION ALL SELECT dst_id, src_id, edge_id FROM edges)"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "


_K = "TRY_CAST(k AS DOUBLE)"
_WHERE = {
    "dsl_eq": "coalesce(status, '') = 'Failure'", "dsl_ne_missing": "coalesce(status, '') <> 'Failure'", "dsl_in": "process_name IN ('cmd.exe', 'whoami.exe')",
    "dsl_contains": "contains(user_name, '7')", "dsl_regex": "regexp_matches(user_name, '^u1[0-4]$')", "dsl_numeric": f"{_K} > 42.5 AND {_K} <= 60",
    "dsl_not": f"NOT (coalesce(status, '') = 'Success' OR {_K} < 50)", "dsl_mixed": f"class_uid = 3002 AND (host IN ('H1', 'H2') OR NOT {_K} >= 10)",
    "sigma_rule": "process_name IN ('cmd.exe', 'powershell.exe') AND NOT (contains(user_name, '3') OR contains(user_name, '5'))"}

# The buffer of each group, event after event: those in the window and the new one; empty again once it fired.
_THRESHOLD = _with(TELE, """hits AS (SELECT user_name AS g, ts_ms, event_id, row_number() OVER (PARTITION BY user_name ORDER BY ts_ms, event_id) AS n
         FROM tele WHERE class_uid = 3002 AND status = 'Failure')""", f"""fold AS (
    SELECT g, n, ts_ms, [{{'t': ts_ms, 'e': event_id}}] AS held, false AS fired FROM hits WHERE n = 1
    UNION ALL
    SELECT h.g, h.n, h.ts_ms, list_append(list_filter(CASE WHEN f.fired THEN [] ELSE f.held END, lambda x: x.t >= h.ts_ms - {c.THRESHOLD.window * 1000}), {{'t': h.ts_ms, 'e': h.event_id}}),
           len(list_filter(CASE WHEN f.fired THEN [] ELSE f.held END, lambda x: x.t >= h.ts_ms - {c.THRESHOLD.window * 1000})) + 1 >= {c.THRESHOLD.threshold}
    FROM fold f JOIN hits h ON h.g = f.g AND h.n = f.n + 1)""", """fired AS (
    SELECT g, ts_ms, list_transform(held, lambda x: x.e) AS ids FROM fold WHERE fired)""", recursive=True)

_SEQUENCE = _with(TELE, f"""pairs AS (
    SELECT b.user_name AS g, b.ts_ms, b.event_id AS e2, arg_min(a.event_id, (a.ts_ms, a.event_id)) AS e1
    FROM tele b JOIN tele a ON a.user_name = b.user_name AND a.class_uid = 3002 AND a.status = 'Failure'
         AND a.ts_ms >= b.ts_ms - {c.CHAIN.window * 1000} AND (a.ts_ms, a.event_id) < (b.ts_ms, b.event_id)
    WHERE b.class_uid = 3002 AND b.status = 'Success' GROUP BY ALL)""", "firsts AS (SELECT g, ts_ms, min(e2) AS e2, arg_min(e1, e2) AS e1 FROM pairs GROUP BY ALL)")

# Processes by (host, pid): launches write, connections write a loose one only where there is none, parents and connections look up.
_LIVE = _with(TELE, """acts AS (
    SELECT lower(host) AS hk, pid, event_id, 0 AS phase, lower(host) || ':' || pid || ':' || ts_ms AS written, 0 AS net, NULL AS role FROM tele WHERE class_uid = 1007
    UNION ALL SELECT lower(host), pid, event_id, 0, NULL, 1, 'own' FROM tele WHERE class_uid = 4001
    UNION ALL SELECT lower(host), ppid, event_id, 1, NULL, 0, 'parent' FROM tele WHERE class_uid = 1007)""", """looked AS (
    SELECT *, last_value(written IGNORE NULLS) OVER w AS last, max(net) OVER w AS loose,
           coalesce(max(net) OVER (PARTITION BY hk, pid ORDER BY event_id, phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM acts WINDOW w AS (PARTITION BY hk, pid ORDER BY event_id, phase ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")

_ADDRESS = "address AS (SELECT env_ip AS ip, arg_max(lower(host), event_id) AS src_host FROM tele GROUP BY env_ip)"
_MOVED = """moved AS (SELECT src_host AS src, lower(host) AS dst, ts_ms, event_id FROM tele JOIN address ON src_ip = ip WHERE class_uid = 3002 AND src_host <> lower(host))"""

# What each event shows: nodes, and edges between them.
_SHOWN = _LIVE + f""", {_ADDRESS}, {_MOVED}, launched AS (
        SELECT event_id, ts_ms, lower(host) AS hk, lower(host) || ':' || pid || ':' || ts_ms AS p, process_name, user_name,
               coalesce(last, CASE WHEN loose = 1 THEN hk || ':' || ppid || ':net' END, hk || ':' || ppid || ':?') AS parent, last IS NULL AND loose = 0 AS unseen
        FROM tele JOIN (SELECT event_id, hk, last, loose FROM looked WHERE role = 'parent') USING (event_id)),
    connected AS (
        SELECT event_id, ts_ms, lower(host) AS hk, coalesce(last, hk || ':' || pid || ':net') AS p, process_name, dst_ip, last IS NULL AND before = 0 AS made
        FROM tele JOIN (SELECT event_id, hk, last, before FROM looked WHERE role = 'own') USING (event_id)),
    shown AS (
        SELECT 'host' AS kind, lower(host) AS identity_key, host AS label, ts_ms, event_id, 0 AS "at" FROM tele
        UNION ALL SELECT 'host', src, src, ts_ms, event_id, 2 FROM moved
        UNION ALL SELECT 'user', user_name, user_name, ts_ms, event_id, 1 FROM tele WHERE class_uid IN (3002, 1007)
        UNION ALL SELECT 'process', p, process_name, ts_ms, event_id, 1 FROM launched
        UNION ALL SELECT 'executable', process_name, process_name, ts_ms, event_id, 2 FROM launched
        UNION ALL SELECT 'process', parent, 'unknown', ts_ms, event_id, 4 FROM launched WHERE unseen
        UNION ALL SELECT 'ip_address', dst_ip, dst_ip, ts_ms, event_id, 1 FROM connected
        UNION ALL SELECT 'process', p, process_name, ts_ms, event_id, 2 FROM connected WHERE made
        UNION ALL SELECT 'file', lower(host) || ':c:\\data\\' || k || '.txt', k || '.txt', ts_ms, event_id, 1 FROM tele WHERE class_uid = 1001 AND k IS NOT NULL),
    bonds AS (
        SELECT 'host' AS src_kind, hk AS src_key, 'process' AS dst_kind, p AS dst_key, 'STARTED' AS etype, ts_ms FROM launched
        UNION ALL SELECT 'executable', process_name, 'process', p, 'EXECUTED', ts_ms FROM launched
        UNION ALL SELECT 'user', user_name, 'process', p, 'RAN_AS', ts_ms FROM launched
        UNION ALL SELECT 'process', parent, 'process', p, 'SPAWNED', ts_ms FROM launched
        UNION ALL SELECT 'host', hk, 'process', p, 'STARTED', ts_ms FROM connected WHERE made
        UNION ALL SELECT 'process', p, 'ip_address', dst_ip, 'CONNECTED_TO', ts_ms FROM connected
        UNION ALL SELECT 'user', user_name, 'host', lower(host), CASE WHEN event_code = 4624 THEN 'LOGGED_IN_TO' ELSE 'AUTHENTICATED' END, ts_ms FROM tele WHERE class_uid = 3002
        UNION ALL SELECT 'host', src, 'host', dst, 'LATERAL_MOVEMENT', ts_ms FROM moved
        UNION ALL SELECT 'host', lower(host), 'file', lower(host) || ':c:\\data\\' || k || '.txt', 'MODIFIED', ts_ms FROM tele WHERE class_uid = 1001 AND k IS NOT NULL)
"""

_PAGERANK = ["outs AS (SELECT src_id, count(*) AS n_out FROM edges GROUP BY src_id)",
             "shares AS MATERIALIZED (SELECT src_id, dst_id, count(*) AS m FROM edges GROUP BY ALL)",
             "size AS (SELECT count(*) AS n FROM nodes)",
             "r0 AS MATERIALIZED (SELECT node_id, n_out, 1.0 / n AS score FROM size, nodes LEFT JOIN outs ON src_id = node_id)"]


def _rounds(n: int) -> list[str]:
    return [*_PAGERANK, *(f"""r{i} AS MATERIALIZED (
        SELECT r.node_id, r.n_out, 0.15 / n + 0.85 * coalesce((SELECT sum(score) FROM r{i - 1} WHERE n_out IS NULL), 0) / n + 0.85 * coalesce(got, 0) AS score
        FROM size, r{i - 1} r LEFT JOIN (SELECT dst_id, sum(m * score / n_out) AS got FROM shares JOIN r{i - 1} ON node_id = src_id GROUP BY dst_id) ON dst_id = r.node_id)""" for i in range(1, n + 1))]


def _rings(start: str, hops: int, steps: str = "steps") -> list[str]:
    """Distances from the start as one table for each hop."""
    out = [f"d0 AS MATERIALIZED (SELECT node_id, 0 AS hop FROM nodes WHERE {start})"]
    for i in range(1, hops + 1):
        out.append(f"d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT b, {i} FROM (SELECT DISTINCT b FROM {steps} JOIN d{i - 1} ON a = node_id) WHERE b NOT IN (SELECT node_id FROM d{i - 1}))")
    return out


_RISK = """SELECT node_id, round(100 * least(greatest(0.45 * score / greatest((SELECT max(score) FROM r40), 1e-9) + 0.40 * coalesce(pow(0.5, hop), 0)
        + 0.15 * CASE kind WHEN 'alert' THEN 1.0 WHEN 'process' THEN 0.25 WHEN 'user' THEN 0.25 WHEN 'host' THEN 0.25 ELSE 0.1 END, 0), 1), 6) AS score
    FROM nodes JOIN r40 USING (node_id) LEFT JOIN d3 USING (node_id)"""
_LOW, _HIGH = c.YEAR_1998
_OVERLAP = f"first_seen <= {_HIGH} AND last_seen >= {_LOW}"
# Labels fall to the smallest of the neighbours', until none falls any more; only nodes whose label fell tell it on.
_COMPONENTS = _with(EDGES, NODES, BOTH, """labelled(node_id, component) USING KEY (node_id) AS (
    SELECT node_id, node_id FROM nodes
    UNION
    SELECT s.b, min(l.component) FROM labelled l JOIN steps s ON s.a = l.node_id JOIN recurring.labelled r ON r.node_id = s.b
    WHERE l.component < r.component GROUP BY s.b)""", recursive=True)
# Every order has one customer, so a component of OWNS edges is a customer with its orders.
_OWNED = _with(EDGES, NODES, f"own AS MATERIALIZED (SELECT src_id AS a, dst_id AS b FROM edges WHERE etype = 'OWNS' AND {_OVERLAP})",
               "owner AS MATERIALIZED (SELECT a, least(a, min(b)) AS component FROM own GROUP BY a)",
               "label AS MATERIALIZED (SELECT a AS node_id, component FROM owner UNION ALL SELECT b, component FROM own JOIN owner USING (a))")
_HALVES = """halves AS MATERIALIZED (
    SELECT edge_id, first_seen, last_seen, event_count, CAST(1 AS DOUBLE) AS weight, 0 AS half FROM edges WHERE event_count = 1
    UNION ALL SELECT edge_id, first_seen - 5, last_seen, event_count, CAST(2 AS DOUBLE), 1 FROM edges WHERE first_seen > 0)"""
# From a customer, paths in time order to a supplier go through one order each; a used one costs too much to be tried before an unused one.
_SRC, _DST = c.ATTACK
_ATTACK = _with(EDGES, NODES, f"""ways AS (
    SELECT o.dst_id AS mid, o.edge_id AS e1, s.edge_id AS e2, round(greatest(0.05, 1 - 0.6 * n.risk_score / 100) + greatest(0.05, 1 - 0.6 * t.risk_score / 100), 6) AS cost
    FROM edges o JOIN edges s ON s.src_id = o.dst_id AND s.first_seen >= o.first_seen JOIN nodes n ON n.node_id = o.dst_id JOIN nodes t ON t.node_id = s.dst_id
    WHERE o.src_id = '{_SRC}' AND s.dst_id = '{_DST}')""", f"""ranked AS (
    SELECT row_number() OVER (ORDER BY cost, mid) AS rank, cost, ['{_SRC}', mid, '{_DST}'] AS nodes, [e1, e2] AS edges FROM ways QUALIFY rank <= 3)""")
_VALUES = lambda xs: "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(xs)) + ") v(i, x)"
_XML = _with(TELE, """xml AS (SELECT event_id + 1 AS line_no, event_id % 50 AS h, CASE WHEN event_id % 2 = 0 THEN '4624' ELSE '4625' END AS code, event_id % 30 AS ip
         FROM tele WHERE event_id % 4 <> 3)""")
_OTHER = _with(TELE, """parts AS (
    SELECT event_id AS e, event_id + 1 AS line_no, event_id % 50 AS h, CASE event_id % 4 WHEN 0 THEN 'network' WHEN 3 THEN 'integrity' ELSE 'process' END AS kind,
           CASE event_id % 4 WHEN 0 THEN map {'protocol': 'tcp', 'src_ip': '10.0.0.9', 'src_port': CAST(1000 + event_id % 9 AS VARCHAR), 'dst_ip': '203.0.113.7', 'dst_port': '443', 'pid': '0x' || to_hex(event_id % 99), 'process': 'ssh'}
           WHEN 1 THEN map {'pid': CAST(event_id % 97 AS VARCHAR), 'process': 'cmd.exe', 'full_path': 'C:\\bin\\cmd.exe', 'parent_folder': 'C:\\bin', 'user': 'corp\\u' || event_id % 30, 'parent_pid': CAST(event_id % 13 AS VARCHAR), 'parent_process': 'init'}
           WHEN 2 THEN map {'pid': CAST(event_id % 97 AS VARCHAR), 'process': 'id'}
           ELSE map {'reserved': '-', 'action': 'CREATED', 'file_path': 'C:\\a,' || event_id || '.txt', 'hash': md5(CAST(event_id AS VARCHAR))} END AS own FROM tele)""")
_RULES = "(VALUES " + ", ".join(f"('{r.id}', '{r.severity}', '{r.mitre}')" for r in config.load_rules()) + ") v(rule_id, severity, mitre)"

ORACLE = {
    "stats": _with(EDGES, NODES) + "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges",
    "timeline_hour": _with(TELE) + "SELECT (ts_ms // 3600000) * 3600000 AS bucket, count(*) AS n FROM tele GROUP BY 1",
    "timeline_host": _with(TELE) + f"SELECT (ts_ms // {c.DAY}) * {c.DAY} AS bucket, count(*) AS n FROM tele WHERE host = 'H3' GROUP BY 1",
    "events_context": _with(TELE) + """SELECT event_id, ts_ms, class_uid, event_code, host, src_ip, dst_ip, user_name, process_name FROM tele
        WHERE lower(host) = 'h3' AND ts_ms BETWEEN 1704672000000 AND 1705276800000 ORDER BY ts_ms, event_id LIMIT 1000""",
    "search_nodes": _with(EDGES, NODES, OBSERVED) + "SELECT node_id, label, event_count FROM observed WHERE kind = 'file' AND (label ILIKE '%red%' OR node_id ILIKE '%red%') ORDER BY event_count DESC, node_id LIMIT 50",
    **{name: _with(TELE) + f"SELECT event_id FROM tele WHERE {where}" for name, where in _WHERE.items()},
    "rule_atomic": _with(TELE) + f"""SELECT 'Q_A:-:' || ts_ms AS alert_id, 'Q_A' AS rule_id, ts_ms, CAST(NULL AS VARCHAR) AS group_key, CAST(1 AS BIGINT) AS event_count, CAST(min(event_id) AS VARCHAR) AS event_ids
        FROM tele WHERE class_uid = 3002 AND status = 'Failure' AND {_K} >= 90 GROUP BY ts_ms""",
    "rule_threshold": _THRESHOLD + """SELECT 'Q_T:' || g || ':' || ts_ms AS alert_id, 'Q_T' AS rule_id, ts_ms, g AS group_key, CAST(len(ids) AS BIGINT) AS event_count, array_to_string(ids, ',') AS event_ids FROM fired""",
    "rule_sequence": _SEQUENCE + "SELECT 'Q_S:' || g || ':' || ts_ms AS alert_id, 'Q_S' AS rule_id, ts_ms, g AS group_key, CAST(2 AS BIGINT) AS event_count, e1 || ',' || e2 AS event_ids FROM firsts",
    "alert_entities": _THRESHOLD + """, involved AS (SELECT g, f.ts_ms, unnest(ids) AS event_id FROM fired f), found AS (
        SELECT DISTINCT g || ':' || i.ts_ms AS alert, unnest([lower(host), 'user ' || user_name, 'ip ' || src_ip]) AS entity FROM involved i JOIN tele USING (event_id))
        SELECT 'TRIGGERED' AS etype, count(*) AS n, count(DISTINCT alert) AS alerts, count(DISTINCT entity) AS entities FROM found""",
    "asof_live_process": _LIVE + """SELECT event_id, role, coalesce(last, CASE WHEN loose = 1 THEN hk || ':' || pid || ':net' END) AS key,
        net = 1 AND last IS NULL AND before = 0 AS made FROM looked WHERE role IS NOT NULL""",
    "address_to_host": _with(TELE, _ADDRESS) + "SELECT ip, src_host FROM address",
    "lateral_movement": _with(TELE, _ADDRESS, _MOVED) + "SELECT src, dst, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*) AS event_count FROM moved GROUP BY ALL",
    "node_fold": _SHOWN + """SELECT kind, identity_key, arg_min(label, (event_id, "at")) AS label, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*) AS event_count
        FROM shown GROUP BY kind, identity_key""",
    "edge_fold": _SHOWN + """SELECT src_kind, src_key, dst_kind, dst_key, etype, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*) AS event_count FROM bonds GROUP BY ALL""",
    "graph_edge_fold": _with(EDGES) + "SELECT edge_id, first_seen, last_seen, event_count FROM edges",
    "validity_merge": _with(EDGES, _HALVES) + """SELECT edge_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(event_count) AS BIGINT) AS event_count,
        arg_min(weight, half) AS weight FROM halves GROUP BY edge_id""",
    "upsert_fold": _with(EDGES, _HALVES) + """SELECT edge_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_max(event_count, half) AS event_count,
        arg_max(weight, half) AS weight FROM halves GROUP BY edge_id""",
    "rewind_edges": _with(EDGES) + f"SELECT edge_id FROM edges WHERE {_OVERLAP}",
    "etype_mask": _with(EDGES) + "SELECT etype, count(*) AS n FROM edges WHERE etype IN ('OWNS', 'USED') GROUP BY etype",
    "degree": _with(EDGES, NODES) + """SELECT node_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM nodes
        LEFT JOIN (SELECT src_id, count(*) AS o FROM edges GROUP BY 1) ON src_id = node_id LEFT JOIN (SELECT dst_id, count(*) AS i FROM edges GROUP BY 1) ON dst_id = node_id""",
    "neighbors_out": _with(EDGES) + "SELECT 's1' AS node_id, 0 AS hop UNION ALL SELECT DISTINCT dst_id, 1 FROM edges WHERE src_id = 's1'",
    "neighbors_in": _with(EDGES) + "SELECT 's1' AS node_id, 0 AS hop UNION ALL SELECT DISTINCT src_id, 1 FROM edges WHERE dst_id = 's1'",
    "neighbors_both": _with(EDGES, BOTH) + "SELECT 's1' AS node_id, 0 AS hop UNION ALL SELECT DISTINCT b, 1 FROM steps WHERE a = 's1'",
    "khop2_edges": _with(EDGES, NODES, BOTH, *_rings("node_id = 'c1'", 1)) + "SELECT DISTINCT edge_id FROM steps JOIN d1 ON a = node_id",
    "shortest_path_hops": _with(EDGES, """walk AS (SELECT 'c1' AS node_id, 0 AS hop UNION SELECT dst_id, hop + 1 FROM walk JOIN edges ON src_id = node_id)""", recursive=True)
        + "SELECT node_id, min(hop) AS hop FROM walk GROUP BY node_id",
    # Of the ways to a node in a ring the smallest edge stays; the path goes back along them.
    "shortest_path": _with(EDGES, NODES, BOTH, *_rings("node_id = 'c1'", 4), """ways AS MATERIALIZED (
            SELECT t.node_id, t.hop, min((s.edge_id, s.a)) AS way FROM d4 t JOIN steps s ON s.b = t.node_id JOIN d4 f ON f.node_id = s.a AND f.hop = t.hop - 1 GROUP BY t.node_id, t.hop)""",
        "back AS (SELECT node_id, hop, way FROM ways WHERE node_id = 'r0' UNION ALL SELECT w.node_id, w.hop, w.way FROM back b JOIN ways w ON w.node_id = b.way[2])", recursive=True)
        + "SELECT CAST(0 AS INTEGER) AS hop, 'c1' AS node_id, CAST(NULL AS VARCHAR) AS edge_id FROM back WHERE hop = 1 UNION ALL SELECT hop, node_id, way[1] FROM back",
    "attack_paths": _ATTACK + "SELECT CAST(rank AS INTEGER) AS rank, cost, cost AS base_cost, array_to_string(nodes, ',') AS nodes, array_to_string(edges, ',') AS edges FROM ranked",
    "path_union": _ATTACK + """SELECT part, id, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT 'node' AS part, unnest(nodes) AS id, rank FROM ranked
        UNION ALL SELECT 'edge', unnest(edges), rank FROM ranked) GROUP BY part, id""",
    "visible_graph": _with(EDGES, NODES) + """, shown AS (SELECT * FROM nodes WHERE kind IN ('user', 'process', 'host'))
        SELECT kind AS name, count(*) AS n FROM shown GROUP BY kind UNION ALL SELECT etype, count(*) FROM edges
        WHERE etype IN ('OWNS', 'CONNECTED_TO') AND src_id IN (SELECT node_id FROM shown) AND dst_id IN (SELECT node_id FROM shown) GROUP BY etype""",
    "reachable": _with(EDGES, "walk AS (SELECT 'n1' AS node_id UNION SELECT dst_id FROM walk JOIN edges ON src_id = node_id)", recursive=True) + "SELECT node_id FROM walk",
    "component_labels": _COMPONENTS + "SELECT node_id, component FROM labelled",
    "component_sizes": _COMPONENTS + "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM labelled GROUP BY component) GROUP BY size",
    "component_members": _OWNED + """SELECT component, size, node_id, kind, label FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM label) JOIN nodes USING (node_id)""",
    "pagerank": _with(EDGES, NODES, *_rounds(40)) + "SELECT node_id, round(score, 9) AS score FROM r40",
    "alert_proximity": _with(EDGES, NODES, BOTH, *_rings("kind = 'alert'", 3)) + "SELECT node_id, hop FROM d3",
    "risk": _with(EDGES, NODES, BOTH, *_rounds(40), *_rings("kind = 'alert'", 3)) + _RISK,
    "top_risk": _with(EDGES, NODES, OBSERVED) + "SELECT node_id, risk_score, event_count FROM observed ORDER BY risk_score DESC, event_count DESC, node_id LIMIT 10",
    "graph_extent": _with(EDGES) + """SELECT min(first_seen) - greatest(CAST(floor((max(last_seen) - min(first_seen)) * 0.01) AS BIGINT), 1000) AS low,
        max(last_seen) + greatest(CAST(floor((max(last_seen) - min(first_seen)) * 0.01) AS BIGINT), 1000) AS high FROM edges""",
    "related_by_kind": _with(EDGES, NODES, BOTH) + """SELECT kind, count(*) AS n, string_agg(label, ',' ORDER BY label, node_id) FILTER (WHERE rank <= 12) AS labels FROM (
        SELECT *, row_number() OVER (PARTITION BY kind ORDER BY label, node_id) AS rank FROM nodes WHERE node_id IN (SELECT b FROM steps WHERE a = 'c1')) GROUP BY kind""",
    "counts_by_class": _with(TELE) + """SELECT class_uid, CASE class_uid WHEN 3002 THEN 'authentication' WHEN 1007 THEN 'process' WHEN 3006 THEN 'account_change' WHEN 4001 THEN 'network'
        WHEN 1001 THEN 'file' ELSE 'generic' END AS class_name, count(*) AS n FROM tele GROUP BY ALL""",
    "union_seeds": _with(EDGES, NODES, BOTH) + "SELECT b AS node_id FROM steps WHERE a IN ('c1', 'c2', 's1') UNION SELECT node_id FROM nodes WHERE node_id IN ('c1', 'c2', 's1')",
    "live_edges_at": _with(EDGES) + "SELECT edge_id FROM edges WHERE 900000000000 BETWEEN first_seen AND last_seen",
    "pid_parse": f"""SELECT i, CASE WHEN regexp_matches(trim(x), '^0[xX][0-9a-fA-F]+$') THEN CAST('0x' || substr(trim(x), 3) AS BIGINT)
        WHEN regexp_matches(trim(x), '^[+-]?[0-9]+$') THEN CAST(trim(x) AS BIGINT) END AS pid FROM {_VALUES(c.PIDS)}""",
    "iso_millis": f"""SELECT i, CASE WHEN regexp_matches(x, '^[0-9-]+T[0-9:.]+(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN epoch_us(CAST(x AS TIMESTAMPTZ)) // 1000 END AS ms FROM {_VALUES(c.TIMES)}""",
    "epoch_auto": _with(TELE) + "SELECT event_id, CASE WHEN ts_ms >= 1000000000000 THEN ts_ms ELSE ts_ms * 1000 END AS ms, (ts_ms % 100000) * 1000 AS s FROM tele",
    "basename": f"SELECT i, regexp_extract(x, '([^\\\\/]*)$', 1) AS name FROM {_VALUES(c.PATHS)}",
    "mitre_and_risk": f"SELECT rule_id, trim(split_part(mitre, ' - ', 1)) AS mitre_id, CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 ELSE 40 END AS risk FROM {_RULES}",
    "envelope_parse": _XML + "SELECT line_no, 'event' AS kind, CAST(1782858368000 AS BIGINT) AS ts_ms, 'h' || h || '.local' AS host, '10.0.0.' || h AS source_ip FROM xml",
    "parse_errors": _with(TELE) + "SELECT event_id + 1 AS line_no, 'envelope' AS kind FROM tele WHERE event_id % 4 = 3",
    "xml_flatten": _XML + """SELECT line_no, unnest(['Provider_Name', 'EventID', 'TimeCreated_SystemTime', 'Computer', 'TargetUserName', 'IpAddress', 'LogonType']) AS k,
        unnest(['P & Q', code, '2026-06-30T22:26:08Z', 'h' || h || '.local', 'u' || h, '10.0.0.' || ip, '3']) AS v FROM xml
        UNION ALL SELECT line_no, unnest(['env.tenant', 'env.collector_ts_ms', 'env.generated_ts_s', 'env.hostname', 'env.source_ip']),
        unnest(['acme', '1782858033704', '1782858369', 'H' || h, '10.0.0.' || h]) FROM xml""",
    "residue_map": _XML + """, kept AS (SELECT *, unnest(['Provider_Name', 'TimeCreated_SystemTime', 'env.tenant', 'env.collector_ts_ms', 'env.generated_ts_s', 'env.hostname', 'env.source_ip']) AS k,
            unnest(['P & Q', '2026-06-30T22:26:08Z', 'acme', '1782858033704', '1782858369', 'H' || h, '10.0.0.' || h]) AS v FROM xml)
        SELECT line_no, CAST(code AS INTEGER) AS event_code, 3002 AS class_uid, 1 AS activity_id, 'u' || h AS user_name, '10.0.0.' || ip AS src_ip, k, v FROM kept""",
    "wire_fields": _OTHER + """SELECT line_no, kind, CAST(1782858369000 AS BIGINT) AS ts_ms, 'H' || h AS host, '10.0.0.' || h AS source_ip, k, v FROM (
        SELECT *, unnest(map_keys(own)) AS k, unnest(map_values(own)) AS v FROM parts
        UNION ALL SELECT *, unnest(['env.tenant', 'env.collector_ts_ms', 'env.generated_ts_s', 'env.hostname', 'env.source_ip', 'env.agent_version']),
            unnest(['acme', '1782858033704', '1782858369', 'H' || h, '10.0.0.' || h, '3.1']) FROM parts)""",
    "wire_events": _OTHER + """, typed AS (
        SELECT line_no, CASE kind WHEN 'network' THEN 4001 WHEN 'process' THEN 1007 ELSE 1001 END AS class_uid, CASE kind WHEN 'process' THEN 1 END AS activity_id, own['src_ip'] AS src_ip, own['dst_ip'] AS dst_ip,
               own['user'] AS user_name, own['process'] AS process_name, CASE WHEN kind = 'network' THEN e % 99 WHEN kind = 'process' THEN e % 97 END AS process_pid,
               CASE WHEN e % 4 = 1 THEN e % 13 END AS parent_pid, unnest(map_entries(own)) AS f FROM parts)
        SELECT line_no, class_uid, activity_id, src_ip, dst_ip, user_name, process_name, process_pid, parent_pid, paths[list_position(names, f.key)] AS k, f.value AS v
        FROM typed, (SELECT ['protocol', 'src_port', 'dst_port', 'full_path', 'parent_folder', 'parent_process', 'action', 'file_path', 'hash', 'reserved'] AS names,
            ['connection.protocol', 'src_endpoint.port', 'dst_endpoint.port', 'process.file.path', 'process.parent_folder', 'parent_process.name', 'activity_name', 'file.path', 'file.hash_md5', 'integrity.reserved'] AS paths)
        WHERE list_contains(names, f.key)""",
}
