"""Endpoint log lines: one record per line, decoded by Catalyst expressions.

A line is an envelope (tenant, collector time, address), a mark, and a payload:
Windows event XML, or comma-separated network, process or file-integrity columns.
Lines that don't decode go to a quarantine with the reason; none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import col, lit

from watchfold.functions import maps, scalars
from watchfold.shared import Scratch

# The format's marks.
TAG = "OPLC-"
NETWORK, NEW_PROCESS, FILE_INTEGRITY = "NETWORK", "NEW_PROCESS", "FILE_INTEGRITY"
# Attributes that Windows events carry on elements of their System section.
SYSTEM_ATTRIBUTES = {
    "Provider": ["Name", "Guid", "EventSourceName"], "EventID": ["Qualifiers"], "TimeCreated": ["SystemTime"],
    "Correlation": ["ActivityID", "RelatedActivityID"], "Execution": ["ProcessID", "ThreadID", "ProcessorID", "SessionID", "KernelTime", "UserTime", "ProcessorTime"],
    "Security": ["UserID"]}
_XML = ("System struct<" + ", ".join(f"{e}: struct<{', '.join(f'_{a}: string' for a in attrs)}>" for e, attrs in SYSTEM_ATTRIBUTES.items())
        + ">, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>")
_XML_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "true"}


def sniff(sample: str) -> str:
    """How surely a sample is in this format: "yes", "maybe" or "no"."""
    if TAG not in sample:
        return "no"
    return "yes" if " #" in sample else "maybe"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of every line that isn't blank; line_no counts all lines over all files from 1, in file order.

    Lines are numbered by their partition's offset, so no task sees them all.
    """
    scratch = Scratch(spark, "lines")
    read = spark.read.text(path).select(
        "value", col("_metadata.file_path").alias("file"), col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    order = ["file", "block", "at"]
    ordered = read.orderBy(*order).withColumn("part", F.spark_partition_id())
    ordered = scratch.write("ordered", ordered.withColumn("rank", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = ordered.groupBy("part").count()  # a row for each partition
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, lit(0)).alias("before"))
    numbered = ordered.join(F.broadcast(offsets), "part").select((col("before") + col("rank") + 1).alias("line_no"), "value")
    return numbered.where(scalars.trim(col("value")) != "")


def _once(df: DataFrame) -> DataFrame:
    """The same rows, each column computed once: neither filters nor projections move below a generator."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _token(tokens: Column, at: Column) -> Column:
    """The token at a position from 1; null beyond either end."""
    return F.when(at >= 1, F.try_element_at(tokens, F.greatest(at, lit(1)).cast("int")))


def _split(text: Column) -> Column:
    return F.transform(F.split(text, ",", -1), scalars.trim)


def _with_xml(df: DataFrame, xml: Column) -> DataFrame:
    """``df`` with all fields of a Windows event ("xml"), and whether the XML is well formed ("well_formed").

    Text of the System section's elements by tag, their attributes by tag_attribute,
    and data elements by name.  Of equal keys the first text stays, an attribute
    goes before a text, and empty values are dropped.  Attributes beyond
    SYSTEM_ATTRIBUTES and other sections are not kept.
    """
    df = _once(df.withColumns({"typed": F.from_xml(xml, _XML, _XML_OPTIONS), "texts": F.from_xml(xml, "System map<string,string>", _XML_OPTIONS)["System"]}))
    typed = col("typed")
    attributes = [maps.entry(f"{e}_{a}", typed["System"][e][f"_{a}"]) for e, attrs in SYSTEM_ATTRIBUTES.items() for a in attrs]
    data = F.transform(typed["EventData"]["Data"], lambda d: F.struct(d["_Name"].alias("k"), d["_VALUE"].alias("v")))
    system = F.transform(F.map_entries("texts"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    entries = F.filter(F.concat(F.array(*attributes), F.coalesce(system, none), F.coalesce(data, none)), lambda e: e["v"].isNotNull())
    entries = F.filter(F.transform(entries, lambda e: F.struct(e["k"].alias("k"), scalars.trim(e["v"]).alias("v"))), lambda e: e["v"] != "")
    df = _once(df.withColumns({"entries": entries, "well_formed": typed.isNotNull()}).drop("typed", "texts"))
    return _once(df.withColumn("xml", maps.first_wins(col("entries"))).drop("entries"))


def _error(kind: str, reason: Column) -> Column:
    return F.struct(lit(kind).alias("kind"), reason.alias("reason"), col("line_no").alias("line"))


def decode(lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) to line_no, kind, ts_ms, host, source_ip, fields, raw and error (null for a record)."""
    rest = F.when(F.instr("value", TAG) > 0, F.expr(f"substring(value, instr(value, '{TAG}'))"))
    df = lines.select("line_no", col("value").alias("raw"), rest.alias("rest"))
    wide, bare = F.instr("rest", " #"), F.instr("rest", "#")
    df = df.withColumn("header", F.when(wide > 0, F.expr("substring(rest, 1, instr(rest, ' #') - 1)")).when(bare > 0, F.expr("substring(rest, 1, instr(rest, '#') - 1)")))
    df = df.withColumn("payload", scalars.trim(F.when(wide > 0, F.expr("substring(rest, instr(rest, ' #') + 2)")).when(bare > 0, F.expr("substring(rest, instr(rest, '#') + 1)"))))
    head = F.split(scalars.trim(col("header")), ",", 3)
    df = df.withColumns({
        "tenant": F.expr(f"substring({'{0}'}, {len(TAG) + 1})".format("split(header, ',')[0]")), "collector": scalars.epoch_millis(F.get(head, lit(1))),
        "xml_at": F.instr("payload", "<")})
    df = _once(df)
    is_xml = col("xml_at") > 0
    meta_csv = F.regexp_replace(F.expr("substring(payload, 1, greatest(xml_at - 1, 0))"), ",+$", "")
    df = df.withColumn("tokens", F.when(is_xml, _split(meta_csv)).otherwise(_split(col("payload"))))
    marks = F.array(lit(NETWORK), lit(NEW_PROCESS), lit(FILE_INTEGRITY))
    first = F.array_position(F.transform("tokens", lambda t: F.array_contains(marks, t)), True)
    df = df.withColumn("mark", F.when(~is_xml, first))
    df = df.withColumn("logset", F.when(is_xml, F.size("tokens")).otherwise(col("mark") - 1))
    df = _with_xml(df, F.when(is_xml, F.expr("substring(payload, xml_at)")))
    args = F.when(col("mark") > 0, F.expr("slice(tokens, mark + 1, size(tokens))"))
    df = df.withColumns({
        "args": args, "type": F.when(col("mark") > 0, _token(col("tokens"), col("mark"))),
        "meta_ip": _token(col("tokens"), col("logset") - 1), "meta_host": _token(col("tokens"), col("logset") - 2),
        "generated": _token(col("tokens"), col("logset") - 3), "agent": _token(col("tokens"), col("logset") - 4)})
    df = _once(df)
    df = _once(df.withColumn("error", _first_error(is_xml)))
    df = _once(df.withColumn("all_fields", F.filter(F.concat(_payload_entries(is_xml), _meta_entries()), lambda e: e["v"] != "")))
    seconds = scalars.epoch_seconds(col("generated"))
    ts = F.when(is_xml, F.coalesce(scalars.iso_millis(F.try_element_at("xml", lit("TimeCreated_SystemTime"))), seconds, "collector", lit(0))).otherwise(
        F.coalesce(seconds, "collector", lit(0)))
    kind = F.when(is_xml, "event").otherwise(F.element_at(F.create_map(
        lit(NETWORK), lit("network"), lit(NEW_PROCESS), lit("process"), lit(FILE_INTEGRITY), lit("integrity")), col("type")))
    host = F.coalesce(F.when(is_xml, F.try_element_at("xml", lit("Computer"))), "meta_host")
    good = col("error").isNull()
    return _once(df.select(
        "line_no", F.when(good, kind).alias("kind"), F.when(good, ts).cast("bigint").alias("ts_ms"), F.when(good, host).alias("host"),
        F.when(good, col("meta_ip")).alias("source_ip"), F.when(good, maps.last_wins(col("all_fields"))).alias("fields"), "raw", "error"))


def _first_error(is_xml: Column) -> Column:
    n = F.size("args")
    return (
        F.when(col("rest").isNull(), _error("not_a_record", lit("no tag")))
        .when(col("header").isNull(), _error("envelope", lit("no mark before the payload")))
        .when(col("tenant") == "", _error("envelope", lit("no tenant")))
        .when(is_xml & ~col("well_formed"), _error("xml", lit("malformed")))
        .when(is_xml & (F.size("xml") == 0), _error("xml", lit("no fields")))
        .when(~is_xml & (col("mark") == 0), _error("unknown_logset", F.substring("payload", 1, 40)))
        .when(~is_xml & (col("mark") == 1), _error("envelope", lit("no log set before the type")))
        .when((col("type") == NETWORK) & (n < 7), _error("payload", F.concat(lit("network: 7 columns expected, got "), n.cast("string"))))
        .when((col("type") == FILE_INTEGRITY) & (n < 4), _error("payload", F.concat(lit("integrity: 4 columns expected, got "), n.cast("string")))))


def _payload_entries(is_xml: Column) -> Column:
    at = lambda names: F.array(*(maps.entry(n, F.get("args", lit(i))) for i, n in enumerate(names)))
    middle = F.array_join(F.expr("slice(args, 3, greatest(size(args) - 3, 0))"), ",")
    integrity = F.array(maps.entry("reserved", F.get("args", lit(0))), maps.entry("action", F.get("args", lit(1))),
                        maps.entry("file_path", middle), maps.entry("hash", F.try_element_at("args", lit(-1))))
    xml = F.transform(F.map_entries("xml"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return (F.when(is_xml, xml)
            .when(col("type") == NETWORK, at(["protocol", "src_ip", "src_port", "dst_ip", "dst_port", "pid", "process"]))
            .when(col("type") == NEW_PROCESS, at(["pid", "process", "full_path", "parent_folder", "user", "parent_pid", "parent_process"]))
            .otherwise(integrity))


def _meta_entries() -> Column:
    return F.array(*(maps.entry(f"env.{n}", c) for n, c in (
        ("tenant", col("tenant")), ("collector_ts_ms", col("collector").cast("string")), ("generated_ts_s", col("generated")),
        ("hostname", col("meta_host")), ("source_ip", col("meta_ip")), ("agent_version", col("agent")))))


def split_errors(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, and the quarantine (line_no, raw, error)."""
    return decoded.where("error IS NULL").drop("error"), decoded.where("error IS NOT NULL").select("line_no", "raw", "error")
