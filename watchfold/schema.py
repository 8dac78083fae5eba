"""Tables of the model: their columns, and the names of node kinds, edge types and event classes."""

from __future__ import annotations

# Codes are the positions in these lists.
NODE_KINDS = [
    "user", "host", "domain", "process", "executable", "command_line", "logon_session", "network_connection", "ip_address", "dns_name",
    "file", "registry_key", "service", "task", "sid", "privilege", "certificate", "ioc", "alert", "event"]
EDGE_TYPES = [
    "LOGGED_IN_TO", "AUTHENTICATED", "STARTED", "SPAWNED", "PARENT_OF", "CHILD_OF", "EXECUTED", "USED", "RAN_AS", "CONNECTED_TO", "RESOLVED",
    "ACCESSED", "CREATED", "MODIFIED", "DELETED", "OWNS", "BELONGS_TO", "GENERATED", "REQUESTED_TICKET", "ACQUIRED_PRIVILEGE",
    "LATERAL_MOVEMENT", "TRIGGERED"]
# OCSF classes.
AUTHENTICATION, PROCESS, ACCOUNT, NETWORK, FILE, UNMAPPED = 3002, 1007, 3006, 4001, 1001, 0
CLASS_NAMES = {AUTHENTICATION: "authentication", PROCESS: "process", ACCOUNT: "account_change", NETWORK: "network", FILE: "file", UNMAPPED: "generic"}

RAW_RECORD = "kind string, ts_ms bigint, host string, source_ip string, fields map<string,string>, raw string"
EVENT = ("event_id bigint, ocsf_uid string, ts_ms bigint, class_uid int, activity_id int, event_code int, host string, src_ip string, dst_ip string, "
         "user_name string, actor_user string, process_pid bigint, parent_pid bigint, process_name string, status_id int, severity_id int, "
         "fields map<string,string>, extra map<string,string>, ingest_batch bigint")
EVENT_RAW = "event_id bigint, raw string"
NODE = "node_id bigint, kind string, identity_key string, label string, first_seen bigint, last_seen bigint, event_count bigint, risk_score float, props map<string,string>"
EDGE = "edge_id bigint, src_id bigint, dst_id bigint, etype string, first_seen bigint, last_seen bigint, event_count bigint, weight float, props map<string,string>"
LINK = "id bigint, event_id bigint, ts_ms bigint"
ALERT = ("alert_id string, rule_id string, name string, severity string, rule_type string, mitre string, ts_ms bigint, event_count bigint, "
         "group_key string, description string, event_ids array<bigint>")
EVENT_SUMMARY = ["event_id", "ts_ms", "class_uid", "event_code", "host", "src_ip", "dst_ip", "user_name", "process_name"]
