"""Correlation: events, in input order (event_id), to observations of nodes and edges.

Which process a pid means is an as-of lookup: the last process seen under (host,
pid) up to the event.  Writes and lookups go through one window over (host, pid),
so a pid that is used again means its later process from then on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import col, lit

from watchfold import schema
from watchfold.functions import scalars
from watchfold.operators import fold
from watchfold.operators.normalize import get

LABEL_CHARS = 120
# Event codes of logons that succeeded.
LOGON_CODES = (4624, 4768, 4769, 4776)
_NODE = "struct<kind:string,key:string,label:string>"


def address_hosts(events: DataFrame) -> DataFrame:
    """(ip, host_key): the endpoint that reports from an address; of several the last in input order."""
    ip = F.try_element_at("extra", lit("env.source_ip"))
    own = events.where(col("host").isNotNull() & (ip != "")).select(ip.alias("ip"), scalars.host_key(col("host")).alias("host_key"), "event_id")
    return own.groupBy("ip").agg(F.max_by("host_key", "event_id").alias("src_host"))


def live_processes(events: DataFrame) -> DataFrame:
    """(event_id, role, key, made): the process that an event's own pid ("own") or parent pid ("parent") means.

    role "own" is for network events: the last process on (host, pid), else the
    loose process host:pid:net, made by the first such event.  role "parent": the
    same, else null; a launch is seen by its own lookup.
    """
    hk = scalars.host_key(col("host"))
    launch = events.where((col("class_uid") == schema.PROCESS) & col("host").isNotNull() & col("process_pid").isNotNull())
    net = events.where((col("class_uid") == schema.NETWORK) & col("host").isNotNull() & col("dst_ip").isNotNull() & col("process_pid").isNotNull())
    null = lit(None).cast("string")
    rows = launch.select(hk.alias("hk"), col("process_pid").alias("pid"), "event_id", lit(0).alias("phase"),
                         scalars.process_key(hk, col("process_pid"), col("ts_ms")).alias("written"), lit(0).alias("net"), null.alias("role"))
    rows = rows.union(net.select(hk, "process_pid", "event_id", lit(0), null, lit(1), lit("own")))
    rows = rows.union(launch.where("parent_pid IS NOT NULL").select(hk, "parent_pid", "event_id", lit(1), null, lit(0), lit("parent")))
    so_far = Window.partitionBy("hk", "pid").orderBy("event_id", "phase").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("hk", "pid").orderBy("event_id", "phase").rowsBetween(Window.unboundedPreceding, -1)
    loose = F.concat_ws(":", "hk", col("pid").cast("string"), lit("net"))
    last = F.last("written", ignorenulls=True).over(so_far)
    key = F.coalesce(last, F.when(F.max("net").over(so_far) == 1, loose))
    made = (col("net") == 1) & last.isNull() & (F.coalesce(F.max("net").over(before), lit(0)) == 0)
    looked = rows.select("event_id", "role", key.alias("key"), made.alias("made"))
    return looked.where("role IS NOT NULL")


def _node(kind: str, key: Column, label: Column) -> Column:
    return F.struct(lit(kind).alias("kind"), key.alias("key"), label.alias("label"))


def _edge(src: Column, dst: Column, etype) -> Column:
    etype = lit(etype) if isinstance(etype, str) else etype
    return F.struct(src["kind"].alias("src_kind"), src["key"].alias("src_key"), dst["kind"].alias("dst_kind"), dst["key"].alias("dst_key"), etype.alias("etype"))


def _user(actor: bool) -> Column:
    name, path = (col("actor_user"), "actor.user") if actor else (col("user_name"), "user")
    return F.when(name.isNotNull(), _node("user", scalars.user_key(name, get(f"{path}.domain"), get(f"{path}.uid")), name))


def emissions(events: DataFrame) -> DataFrame:
    """(event_id, ts_ms, nodes, edges): what each event shows; nodes in the order in which they are observed."""
    parts = live_processes(events).groupBy("event_id").agg(
        F.max(F.when(col("role") == "own", col("key"))).alias("own_key"), F.max(F.when(col("role") == "own", col("made"))).alias("own_made"),
        F.max(F.when(col("role") == "parent", col("key"))).alias("parent_key"))
    df = events.join(parts, "event_id", "left")
    df = df.join(address_hosts(events), (col("class_uid") == schema.AUTHENTICATION) & (col("src_ip") == col("ip")), "left")
    df = df.withColumns({
        "hk": scalars.host_key(col("host")), "user": _user(False), "actor": _user(True), "cmd": get("process.cmd_line"), "path": get("process.file.path"),
        "session": get("session.uid"), "file": get("file.path"), "privileges": F.coalesce(get("PrivilegeList"), lit(""))})
    df = df.withColumn("h", F.when(col("host").isNotNull(), _node("host", col("hk"), col("host"))))
    cases = [(schema.PROCESS, _process), (schema.NETWORK, _network), (schema.AUTHENTICATION, _logon), (schema.FILE, _file), (schema.ACCOUNT, _account)]
    nodes, edges = _generic()
    for class_uid, case in cases:
        own_nodes, own_edges = case()
        nodes = F.when(col("class_uid") == class_uid, own_nodes).otherwise(nodes)
        edges = F.when(col("class_uid") == class_uid, own_edges).otherwise(edges)
    there = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    return df.select("event_id", "ts_ms", there(nodes).alias("nodes"), there(edges).alias("edges"))


def _if(test: Column, *items: Column) -> list[Column]:
    return [F.when(test, i) for i in items]


def _process():
    h, name = col("h"), F.coalesce("process_name", lit("process"))
    run = col("host").isNotNull() & col("process_pid").isNotNull()
    p = _node("process", scalars.process_key(col("hk"), col("process_pid"), col("ts_ms")), name)
    image = F.when(F.coalesce(col("path"), lit("")) != "", col("path")).otherwise(name)
    exe = _node("executable", F.lower(scalars.trim(image)), scalars.basename(image))
    has_cmd, has_user = run & (F.coalesce("cmd", lit("")) != ""), run & col("user").isNotNull()
    cmd = _node("command_line", col("cmd"), F.substring("cmd", 1, LABEL_CHARS))
    has_parent, unseen = run & col("parent_pid").isNotNull(), run & col("parent_pid").isNotNull() & col("parent_key").isNull()
    placeholder = F.concat_ws(":", "hk", col("parent_pid").cast("string"), lit("?"))
    parent = _node("process", F.coalesce("parent_key", placeholder), F.coalesce(get("parent_process.name"), lit("unknown")))
    has_session = run & ~F.coalesce("session", lit("")).isin("", "0x0")
    s = _node("logon_session", F.concat_ws(":", "hk", scalars.trim(col("session"))), F.concat(lit("session "), "session"))
    nodes = [*_if(col("host").isNotNull(), h), *_if(run, p, exe), *_if(has_cmd, cmd), *_if(has_user, col("user")), *_if(unseen, parent), *_if(has_session, s)]
    edges = [*_if(run, _edge(h, p, "STARTED"), _edge(exe, p, "EXECUTED")), *_if(has_cmd, _edge(p, cmd, "USED")), *_if(has_user, _edge(col("user"), p, "RAN_AS")),
             *_if(has_parent, _edge(parent, p, "SPAWNED")), *_if(has_session, _edge(s, p, "OWNS"), _edge(s, h, "BELONGS_TO"))]
    return F.array(*nodes), F.array(*edges)


def _network():
    h, to = col("h"), col("host").isNotNull() & col("dst_ip").isNotNull()
    ip = _node("ip_address", col("dst_ip"), col("dst_ip"))
    p = _node("process", col("own_key"), F.coalesce("process_name", lit("process")))
    made, owned = to & F.coalesce("own_made", lit(False)), col("own_key").isNotNull()
    return (F.array(*_if(col("host").isNotNull(), h), *_if(to, ip), *_if(made, p)),
            F.array(*_if(made, _edge(h, p, "STARTED")), *_if(to & owned, _edge(p, ip, "CONNECTED_TO")), *_if(to & ~owned, _edge(h, ip, "CONNECTED_TO"))))


def _logon():
    h, who = col("h"), col("host").isNotNull() & col("user").isNotNull()
    etype = F.when(F.coalesce(col("event_code").isin(*LOGON_CODES), lit(False)), "LOGGED_IN_TO").otherwise("AUTHENTICATED")
    src = _node("host", col("src_host"), col("src_host"))
    moved = who & col("src_host").isNotNull() & (col("src_host") != col("hk"))
    return (F.array(*_if(col("host").isNotNull(), h, col("user")), *_if(moved, src)),
            F.array(*_if(who, _edge(col("user"), h, etype)), *_if(moved, _edge(src, h, "LATERAL_MOVEMENT"))))


def _file():
    h, there = col("h"), col("host").isNotNull() & (F.coalesce("file", lit("")) != "")
    f = _node("file", F.concat_ws(":", "hk", F.lower(scalars.trim(col("file")))), scalars.basename(col("file")))
    action = F.upper(F.coalesce(get("activity_name"), lit("")))
    etype = F.when(action.isin("CREATED", "CREATE"), "CREATED").when(action.isin("DELETED", "DELETE", "REMOVED"), "DELETED").otherwise("MODIFIED")
    return F.array(*_if(col("host").isNotNull(), h), *_if(there, f)), F.array(*_if(there, _edge(h, f, etype)))


def _account():
    a, t = col("actor"), col("user")
    return F.array(a, t), F.array(*_if(a.isNotNull() & t.isNotNull() & (a["key"] != t["key"]), _edge(a, t, "MODIFIED")))


def _generic():
    h, who = col("h"), F.coalesce("actor", "user")
    run, named = col("host").isNotNull() & col("process_pid").isNotNull(), col("process_name").isNotNull()
    p = _node("process", scalars.process_key(col("hk"), col("process_pid"), col("ts_ms")), F.coalesce("process_name", lit("process")))
    exe = _node("executable", F.lower(scalars.trim(col("process_name"))), scalars.basename(col("process_name")))
    names = F.filter(F.split("privileges", r"[\n\t ]"), lambda x: x != "")
    privileges = F.transform(names, lambda x: _node("privilege", x, x))
    holder = F.coalesce(who, F.when(run, p))
    gained = F.when(holder.isNotNull(), F.transform(names, lambda x: _edge(holder, _node("privilege", x, x), "ACQUIRED_PRIVILEGE")))
    edges = F.array(*_if(run, _edge(h, p, "STARTED")), *_if(run & named, _edge(exe, p, "EXECUTED")), *_if(run & who.isNotNull(), _edge(who, p, "RAN_AS")))
    return (F.concat(F.array(h, who, F.when(run, p), F.when(run & named, exe)), privileges),
            F.concat(edges, F.coalesce(gained, F.filter(edges, lambda _: lit(False)))))


def correlate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a batch of events shows."""
    shown = emissions(events)
    nodes = shown.select("event_id", "ts_ms", F.posexplode("nodes").alias("at", "n")).select(
        col("n.kind").alias("kind"), col("n.key").alias("identity_key"), col("n.label").alias("label"), "ts_ms", "event_id", "at")
    edges = shown.select("ts_ms", F.explode("edges").alias("e")).select("e.*", "ts_ms")
    hashes = events.where((col("class_uid") == schema.FILE) & col("host").isNotNull()).select(
        lit("file").alias("kind"), F.concat_ws(":", scalars.host_key(col("host")), F.lower(scalars.trim(get("file.path")))).alias("identity_key"),
        lit("hash_md5").alias("name"), get("file.hash_md5").alias("value"), "event_id").where("value IS NOT NULL")
    return fold.with_props(fold.fold_nodes(nodes), hashes), fold.fold_edges(edges)


def links(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, event_id, ts_ms) of every node and of every edge that an event shows, each once."""
    shown = emissions(events)
    nodes = shown.select("event_id", "ts_ms", F.explode("nodes").alias("n")).select(scalars.node_id(col("n.kind"), col("n.key")).alias("id"), "event_id", "ts_ms")
    ends = shown.select("event_id", "ts_ms", F.explode("edges").alias("e")).select(
        scalars.node_id(col("e.src_kind"), col("e.src_key")).alias("s"), scalars.node_id(col("e.dst_kind"), col("e.dst_key")).alias("d"), "e.etype", "event_id", "ts_ms")
    edges = ends.select(scalars.edge_id(col("s"), col("d"), col("etype")).alias("id"), "event_id", "ts_ms")
    return nodes.distinct(), edges.distinct()


def alert_graph(alerts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alert nodes, and a TRIGGERED edge to each from every host, user and address of its events."""
    own = alerts.select("alert_id", "ts_ms", F.posexplode("event_ids").alias("at", "event_id"))
    involved = own.join(events.drop("ts_ms"), "event_id")
    ip = lambda c: F.when(col(c) != "", _node("ip_address", col(c), col(c)))
    host = F.when(scalars.host_key(col("host")) != "", _node("host", scalars.host_key(col("host")), col("host")))
    user = F.when(_user(False)["key"] != "", _user(False))
    found = involved.select("alert_id", "ts_ms", "at", F.posexplode(F.array(host, user, ip("src_ip"), ip("dst_ip"))).alias("i", "n")).where("n IS NOT NULL")
    entities = found.select(col("n.kind").alias("kind"), col("n.key").alias("identity_key"), col("n.label").alias("label"), "ts_ms",
                            F.xxhash64("alert_id").alias("event_id"), (col("at") * 4 + col("i")).alias("at"))
    itself = alerts.select(lit("alert").alias("kind"), col("alert_id").alias("identity_key"), col("name").alias("label"), "ts_ms",
                           F.xxhash64("alert_id").alias("event_id"), lit(-1).alias("at"))
    edges = found.select(col("n.kind").alias("src_kind"), col("n.key").alias("src_key"), lit("alert").alias("dst_kind"), col("alert_id").alias("dst_key"),
                         lit("TRIGGERED").alias("etype"), "ts_ms").distinct()
    props = alerts.select(lit("alert").alias("kind"), col("alert_id").alias("identity_key"), lit(0).alias("event_id"), F.explode(F.create_map(
        lit("rule_id"), col("rule_id"), lit("severity"), col("severity"), lit("rule_type"), col("rule_type"), lit("mitre"), col("mitre"),
        lit("mitre_id"), scalars.mitre_id(col("mitre")), lit("risk"), scalars.alert_risk(col("severity")).cast("string"))).alias("name", "value"))
    nodes = reduce(DataFrame.unionByName, [itself, entities])
    return fold.with_props(fold.fold_nodes(nodes), props.where("value IS NOT NULL")), fold.fold_edges(edges)
