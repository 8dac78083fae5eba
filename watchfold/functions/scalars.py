"""Scalar functions of the model, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.functions import col, lit

from watchfold.schema import CLASS_NAMES, EDGE_TYPES, NODE_KINDS

# Own choice: the column that ids hash first, so that they differ from plain hashes of the same bytes.  It counts the model's version.
_SEED = 1

# Windows logon types.
LOGON_TYPES = {"2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock", "8": "NetworkCleartext",
               "9": "NewCredentials", "10": "RemoteInteractive", "11": "CachedInteractive"}
RISK_OF_SEVERITY = {"critical": 100, "high": 75, "medium": 50, "low": 25}


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """True for null, blank or "-"."""
    return F.coalesce(trim(c).isin("", "-"), lit(True))


def host_key(host: Column) -> Column:
    return F.lower(trim(host))


def user_key(name: Column, domain: Column, sid: Column) -> Column:
    """The SID, else domain\\name, else the name."""
    name = F.lower(trim(name))
    return F.when(~blank(sid), F.lower(trim(sid))).when(~blank(domain), F.concat(F.lower(trim(domain)), lit("\\"), name)).otherwise(name)


def process_key(host: Column, pid: Column, start_ms: Column) -> Column:
    return F.concat_ws(":", host, pid.cast("string"), start_ms.cast("string"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def _code(names: list[str], name: Column) -> Column:
    return F.array_position(F.array(*map(lit, names)), name) - 1


def _byte(code: Column) -> Column:
    return F.unhex(F.lpad(F.hex(code), 2, "0"))


def _little_endian(number: Column) -> Column:
    digits = F.lpad(F.hex(number), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, at, 2) for at in range(15, 0, -2))))


def node_id(kind: Column, key: Column) -> Column:
    """The content hash of a node's kind and identity."""
    return F.xxhash64(lit(_SEED), F.concat(_byte(_code(NODE_KINDS, kind)), F.unhex(lit("00")), F.encode(key, "UTF-8")))


def edge_id(src: Column, dst: Column, etype: Column) -> Column:
    return F.xxhash64(lit(_SEED), F.concat(_little_endian(src), _little_endian(dst), _byte(_code(EDGE_TYPES, etype))))


def unsigned(number: Column) -> Column:
    """The 64 bits as a number from 0, for display and for the order of ids."""
    wide = number.cast("decimal(20,0)")
    return F.when(number < 0, wide + lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def whole(text: Column) -> Column:
    """A decimal integer with an optional sign, else null."""
    text = trim(text)
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def pid(text: Column) -> Column:
    """A process id in decimal, or in hex after 0x; else null."""
    text = trim(text)
    digits = F.regexp_extract(text, r"^0[xX]0*([0-9a-fA-F]{1,15})\z", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint")).otherwise(whole(text))


def epoch_seconds(text: Column) -> Column:
    return F.try_multiply(whole(text), lit(1000).cast("bigint"))


def epoch_millis(text: Column) -> Column:
    return whole(text)


def epoch(text: Column) -> Column:
    """Milliseconds of an epoch number: from 10**12 on it is milliseconds already, below it seconds."""
    n = whole(text)
    return F.when(n >= 10**12, n).otherwise(F.try_multiply(n, lit(1000).cast("bigint")))


def iso_millis(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time, whose zone is required; else null."""
    text = trim(text)
    zoned = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z")
    return F.when(zoned, F.unix_millis(F.upper(text).try_cast("timestamp")))


def logon_type(text: Column) -> Column:
    return F.element_at(F.create_map(*(lit(x) for kv in LOGON_TYPES.items() for x in kv)), text)


def alert_risk(severity: Column) -> Column:
    low = F.lower(severity)
    cases = reduce(lambda w, kv: w.when(low == kv[0], kv[1]), RISK_OF_SEVERITY.items(), F)
    return cases.otherwise(40)


def mitre_id(mitre: Column) -> Column:
    return trim(F.substring_index(mitre, " - ", 1))


def class_name(class_uid: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(lit(x) for kv in CLASS_NAMES.items() for x in kv)), class_uid), lit("other"))


# -- validity: the interval in which something was seen, and how often --------------------------

def live_at(t, first: str = "first_seen", last: str = "last_seen") -> Column:
    return lit(t).between(col(first), col(last))


def live_in(low, high, first: str = "first_seen", last: str = "last_seen") -> Column:
    """The interval overlaps [low, high]; None leaves an end open."""
    out = lit(True)
    if high is not None:
        out = out & (col(first) <= lit(high))
    if low is not None:
        out = out & (col(last) >= lit(low))
    return out


def observed(ts: str = "ts_ms") -> list[Column]:
    """Aggregates that fold observations into first_seen, last_seen and event_count."""
    return [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(lit(1)).alias("event_count")]


def merged() -> list[Column]:
    """Aggregates that merge intervals: the union, with counts added."""
    return [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count")]
