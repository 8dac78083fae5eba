"""Normalisation: raw records to events with typed columns, and two maps for what has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import col, lit

from watchfold import schema
from watchfold.functions import maps, scalars
from watchfold.sources.config import Mapping
from watchfold.sources.lines import _once

# Where fields of any Windows event go; a later one overrides an earlier one.
WINDOWS_FIELDS = [
    ("Computer", "host.hostname"), ("TargetUserName", "user.name"), ("TargetDomainName", "user.domain"), ("TargetUserSid", "user.uid"),
    ("SubjectUserName", "actor.user.name"), ("SubjectDomainName", "actor.user.domain"), ("SubjectUserSid", "actor.user.uid"),
    ("SubjectLogonId", "session.uid"), ("IpAddress", "src_endpoint.ip"), ("IpPort", "src_endpoint.port"),
    ("WorkstationName", "src_endpoint.hostname"), ("ProcessName", "process.name"), ("ProcessId", "process.pid"),
    ("NewProcessName", "process.name"), ("NewProcessId", "process.pid"), ("CommandLine", "process.cmd_line"),
    ("ParentProcessName", "parent_process.name"), ("CreatorProcessId", "parent_process.pid")]
# What an event code says of activity, status and severity.
ENRICHED = {
    4624: {"activity_id": 1, "activity_name": "Logon", "status": "Success", "status_id": 1},
    4625: {"activity_id": 1, "activity_name": "Logon", "status": "Failure", "status_id": 2, "severity_id": 2, "severity": "Low"},
    4768: {"activity_id": 3, "activity_name": "Authentication Ticket", "status": "Success", "status_id": 1},
    4720: {"activity_id": 1, "activity_name": "Create"},
    4732: {"activity_id": 2, "activity_name": "Add to Group"}}
SHARE_ACCESS = 6
TEXT_COLUMNS = {"user.name": "user_name", "actor.user.name": "actor_user", "src_endpoint.ip": "src_ip", "dst_endpoint.ip": "dst_ip", "process.name": "process_name"}
PID_COLUMNS = {"process.pid": "process_pid", "parent_process.pid": "parent_pid"}
# Paths that have a typed column; all others are keys of the two maps.
TYPED = {"time": "ts_ms", "class_uid": "class_uid", "activity_id": "activity_id", "event_code": "event_code", "host.hostname": "host",
         "status_id": "status_id", "severity_id": "severity_id", **TEXT_COLUMNS, **PID_COLUMNS}


def get(path: str) -> Column:
    """The value of a path as text: its typed column, else ``fields``, else ``extra``; null where none has it."""
    tries = [col(TYPED[path]).cast("string")] if path in TYPED else []
    return F.coalesce(*tries, F.try_element_at("fields", lit(path)), F.try_element_at("extra", lit(path)))


def _field(name: str) -> Column:
    return F.try_element_at("fields", lit(name))


def _assignments(mappings: dict[str, Mapping]) -> tuple[Column, Column]:
    """Of a Windows record: all (path, value) in the order in which they are set, and the source fields used up."""
    pair = lambda source, path: F.struct(lit(path).alias("k"), _field(source).alias("v"), lit(source).alias("source"))
    general = F.array(*(pair(s, p) for s, p in WINDOWS_FIELDS))
    own = F.array().cast("array<struct<k:string,v:string,source:string>>")
    specific = None
    for event, mapping in mappings.items():
        these = F.array(*(pair(s, mapping.fields[s]) for s in sorted(mapping.fields))) if mapping.fields else own
        specific = F.when(_field("EventID") == event, these) if specific is None else specific.when(_field("EventID") == event, these)
    everything = F.concat(general, F.coalesce(specific, own) if specific is not None else own)
    return F.filter(everything, lambda a: a["v"].isNotNull()), F.concat(F.array(lit("EventID")), F.transform(everything, lambda a: a["source"]))


def _windows(records: DataFrame, mappings: dict[str, Mapping]) -> tuple[DataFrame, Column]:
    """The records with what their events need ("assigned" to "set", null but for Windows events), and the event as a struct."""
    assigned, used = _assignments(mappings)
    only = lambda c: F.when(col("kind") == "event", c)
    df = records.withColumns({"assigned": only(assigned), "used": only(used), "code": only(scalars.whole(_field("EventID")).try_cast("int"))})
    last = lambda test: F.try_element_at(F.filter("assigned", test), lit(-1))["v"]
    class_uid = F.coalesce(F.element_at(F.create_map(*(lit(x) for k, m in mappings.items() for x in (k, m.class_uid))), _field("EventID")), lit(schema.UNMAPPED))
    df = _once(df.withColumn("class_uid", only(class_uid.cast("int"))))
    share = (col("class_uid") == schema.NETWORK) & _field("ShareName").isNotNull()
    known = _coded
    of = lambda path: lambda a: a["k"] == path
    number_of = lambda path: lambda a: (a["k"] == path) & scalars.pid(a["v"]).isNotNull()
    # A host from a field only where the record has none; its later values, and all where it has one, are fields.
    first_host = F.get(F.filter("assigned", lambda a: a["k"] == "host.hostname"), lit(0))["v"]
    hosts = F.filter("assigned", lambda a: a["k"] == "host.hostname")
    hosts = F.when(col("host").isNull(), F.slice(hosts, 2, F.greatest(F.size(hosts), lit(1)))).otherwise(hosts)
    plain = F.filter("assigned", lambda a: ~a["k"].isin("host.hostname", *TEXT_COLUMNS) & ~(a["k"].isin(*PID_COLUMNS) & scalars.pid(a["v"]).isNotNull()))
    keep = lambda xs: F.transform(xs, lambda a: F.struct(a["k"].alias("k"), a["v"].alias("v")))
    added = F.array(
        maps.entry("auth_protocol", scalars.logon_type(_field("LogonType"))),
        maps.entry("activity_name", F.when(share, "Share Access").otherwise(known("activity_name"))),
        maps.entry("status", known("status")), maps.entry("severity", known("severity")), maps.entry("share_name", F.when(share, _field("ShareName"))))
    df = _once(df.withColumn("set", only(F.concat(keep(hosts), keep(plain), added))))
    extra = F.map_filter("fields", lambda k, _: k.startswith("env.") | ~F.array_contains("used", k))
    return df, F.struct(
        *_keys(df), "class_uid", F.when(share, SHARE_ACCESS).otherwise(known("activity_id")).cast("int").alias("activity_id"), col("code").alias("event_code"),
        F.coalesce("host", first_host).alias("host"), *(last(of(p)).alias(c) for p, c in TEXT_COLUMNS.items()),
        *(scalars.pid(last(number_of(p))).alias(c) for p, c in PID_COLUMNS.items()),
        known("status_id").cast("int").alias("status_id"), known("severity_id").cast("int").alias("severity_id"),
        maps.last_wins(col("set")).alias("fields"), extra.alias("extra"), "raw")


def _coded(name: str) -> Column:
    cases = None
    for code, facts in ENRICHED.items():
        if name in facts:
            cases = F.when(col("code") == code, facts[name]) if cases is None else cases.when(col("code") == code, facts[name])
    return cases


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("line_no", "ts_ms") if c in df.columns]


def _columns(records: DataFrame, class_uid: int, typed: dict[str, Column], fields: dict[str, str], activity: int | None = None) -> Column:
    """The event, as a struct, of a record kind whose columns are known."""
    null = lambda kind: lit(None).cast(kind)
    names = [*TEXT_COLUMNS.values()]
    return F.struct(
        *_keys(records), lit(class_uid).alias("class_uid"), lit(activity).cast("int").alias("activity_id"), null("int").alias("event_code"), "host",
        *(typed.get(n, null("string")).alias(n) for n in names), *(typed.get(n, null("bigint")).alias(n) for n in PID_COLUMNS.values()),
        null("int").alias("status_id"), null("int").alias("severity_id"),
        maps.first_wins(F.array(*(maps.entry(path, _field(source)) for source, path in fields.items()))).alias("fields"),
        F.map_filter("fields", lambda k, _: k.startswith("env.")).alias("extra"), "raw")


def normalize(records: DataFrame, mappings: dict[str, Mapping]) -> DataFrame:
    """Raw records to events; never fails, and no source field is lost: what has no place is in ``extra``.

    One pass: records are read once, and of each only the expressions of its kind are worked out.
    """
    direct = {
        "network": _columns(
            records, schema.NETWORK,
            {"src_ip": _field("src_ip"), "dst_ip": _field("dst_ip"), "process_name": _field("process"), "process_pid": scalars.pid(_field("pid"))},
            {"protocol": "connection.protocol", "src_port": "src_endpoint.port", "dst_port": "dst_endpoint.port"}),
        "process": _columns(
            records, schema.PROCESS,
            {"user_name": _field("user"), "process_name": _field("process"), "process_pid": scalars.pid(_field("pid")), "parent_pid": scalars.pid(_field("parent_pid"))},
            {"full_path": "process.file.path", "parent_folder": "process.parent_folder", "parent_process": "parent_process.name"}, activity=1),
        "integrity": _columns(
            records, schema.FILE, {},
            {"action": "activity_name", "file_path": "file.path", "hash": "file.hash_md5", "reserved": "integrity.reserved"})}
    df, event = _windows(records.where(col("kind").isin("event", *direct)), mappings)
    whole = F.when(col("kind") == "event", event)
    for kind, own in direct.items():
        whole = whole.when(col("kind") == kind, own)
    return df.select(F.inline(F.array(whole)))
