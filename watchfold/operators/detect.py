"""Detection: atomic, threshold and sequence rules over events, in the order of (ts_ms, event_id)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import col, lit

from watchfold.functions import dsl
from watchfold.operators.normalize import get
from watchfold.sources.config import Rule, Step

_COLUMNS = ["alert_id", "rule_id", "name", "severity", "rule_type", "mitre", "ts_ms", "event_count", "group_key", "description", "event_ids"]


def matches(part: Rule | Step) -> Column:
    """The rule's class and filter as one total predicate."""
    test = dsl.predicate(part.filter, get)
    return test if part.class_uid is None else (F.coalesce(col("class_uid") == part.class_uid, lit(False)) & test)


def _matched(events: DataFrame, rules: list[Rule], test, extra=lambda rule: lit(None).cast("string")) -> DataFrame:
    """(rule index, x, ts_ms, event_id) for every rule that an event matches, in one scan of the events."""
    hits = F.array(*(F.when(test(r), F.struct(lit(i).alias("rule"), extra(r).alias("x"))) for i, r in enumerate(rules)))
    hit = events.select("ts_ms", "event_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return hit.select("h.rule", "h.x", "ts_ms", "event_id")


def _alerts(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, group_key, ts_ms, event_ids) with the rules' own columns; group_key is null for rules without one."""
    spark = found.sparkSession
    facts = spark.createDataFrame(
        [(i, r.id, r.name, r.severity, r.type, r.mitre, r.description) for i, r in enumerate(rules)],
        "rule int, rule_id string, name string, severity string, rule_type string, mitre string, description string")
    joined = found.join(F.broadcast(facts), "rule")  # as many rows as there are rules
    alert_id = F.concat_ws(":", "rule_id", F.coalesce("group_key", lit("-")), col("ts_ms").cast("string"))
    return joined.withColumn("alert_id", alert_id).withColumn("event_count", F.size("event_ids").cast("bigint")).select(*_COLUMNS)


def atomic(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """An alert for each matching event; those of one rule in one millisecond are one, of the first event."""
    hits = _matched(events, rules, matches).groupBy("rule", "ts_ms").agg(F.min("event_id").alias("e"))
    return _alerts(hits.select("rule", lit(None).cast("string").alias("group_key"), "ts_ms", F.array("e").alias("event_ids")), rules)


def group_of(rule: Rule) -> Column:
    if rule.group_by is None:
        return lit("default")
    value = get(rule.group_by)
    return F.when(F.coalesce(value, lit("")) != "", value).otherwise("unknown")


class Threshold:
    """The events of one rule and group within the window; they are cleared when the rule fires."""

    def __init__(self, threshold: int, window_ms: int):
        self.threshold, self.window_ms, self.held = threshold, window_ms, deque()

    def see(self, ts: int, event_id: int) -> list[int] | None:
        self.held.append((ts, event_id))
        while self.held[0][0] < ts - self.window_ms:
            self.held.popleft()
        if len(self.held) < self.threshold:
            return None
        ids = [e for _, e in self.held]
        self.held.clear()
        return ids


def firings(ts: np.ndarray, need: int, window_ms: int) -> tuple[list[int], int]:
    """Of sorted times: where each run of ``need`` events that fires starts, and up to where events are used up.

    What ``Threshold`` finds event by event: a run fires with its last event if all
    of it lies within the window, and the next run starts after it.
    """
    fits = np.flatnonzero(ts[need - 1:] - ts[:max(len(ts) - need + 1, 0)] <= window_ms)
    starts, at = [], 0
    while (k := int(np.searchsorted(fits, at))) < len(fits):
        starts.append(int(fits[k]))
        at = starts[-1] + need
    return starts, at


def threshold(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """An alert whenever ``threshold`` events of a group lie within the window; counting then starts anew.

    Only matching events are shuffled, to their rule and group, and sorted there.
    They are scanned as arrays, batch after batch; fewer than ``threshold`` events
    are carried on, so no group is ever held, however many events it has.
    """
    hits = _matched(events, rules, matches, group_of).withColumnRenamed("x", "group_key")
    ordered = hits.repartition("rule", "group_key").sortWithinPartitions("rule", "group_key", "ts_ms", "event_id")
    limits = [(r.threshold, r.window * 1000) for r in rules]

    def run(batches):
        now, held = None, np.zeros((0, 2), np.int64)
        for b in batches:
            out = []
            rule, group = b.column(0).to_numpy(zero_copy_only=False), b.column(1).dictionary_encode()
            code, names = group.indices.to_numpy(zero_copy_only=False), group.dictionary.to_pylist()
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], axis=1)
            cut = np.r_[0, np.flatnonzero((rule[1:] != rule[:-1]) | (code[1:] != code[:-1])) + 1, len(rule)].tolist()
            for a, z in zip(cut[:-1], cut[1:]):
                if a == z:
                    continue
                key = (int(rule[a]), names[code[a]])
                held = np.concatenate([held, rows[a:z]]) if key == now else rows[a:z]
                now, (need, window) = key, limits[key[0]]
                starts, used = firings(held[:, 0], need, window)
                for s in starts:
                    out.append({"rule": key[0], "group_key": key[1], "ts_ms": int(held[s + need - 1, 0]), "event_ids": held[s:s + need, 1].tolist()})
                held = held[max(used, len(held) - need + 1):]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("rule", pa.int32()), ("group_key", pa.string()), ("ts_ms", pa.int64()), ("event_ids", pa.list_(pa.int64()))]))

    found = ordered.select("rule", "group_key", "ts_ms", "event_id").mapInArrow(run, "rule int, group_key string, ts_ms bigint, event_ids array<bigint>")
    return _alerts(_first(found), rules)


def _first(found: DataFrame) -> DataFrame:
    """One of each alert: the first that was found."""
    return found.groupBy("rule", "group_key", "ts_ms").agg(F.min_by("event_ids", F.element_at("event_ids", -1)).alias("event_ids"))


def sequence(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """An alert where a second step follows a first one with the same value within the window.

    An event that fits both steps is the second.  Of several first steps the
    earliest in the window counts, of second steps in one millisecond the first.
    """
    step = lambda r: F.when(matches(r.steps[1]), 1).when(matches(r.steps[0]), 0)
    key = lambda r: F.coalesce(get(r.match_on), lit(""))
    hits = F.array(*(F.when(step(r).isNotNull() & (key(r) != ""), F.struct(lit(i).alias("rule"), step(r).alias("step"), key(r).alias("group_key"),
                                                                         lit(r.window * 1000).cast("bigint").alias("window"))) for i, r in enumerate(rules)))
    rows = events.select("ts_ms", "event_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.*", "ts_ms", "event_id")
    found = None
    for window in sorted({r.window * 1000 for r in rules}):  # a frame's width is fixed
        frame = Window.partitionBy("rule", "group_key").orderBy("ts_ms").rangeBetween(-window, 0)
        own = rows.where(col("window") == window)
        first = F.min(F.when(col("step") == 0, F.struct("ts_ms", "event_id"))).over(frame)
        part = own.withColumn("first", first).where((col("step") == 1) & (col("first") < F.struct("ts_ms", "event_id")))
        part = part.select("rule", "group_key", "ts_ms", F.array("first.event_id", "event_id").alias("event_ids"))
        found = part if found is None else found.unionByName(part)
    return _alerts(_first(found), rules)


def detect(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """All alerts of a rule set, each alert_id once."""
    out = None
    for kind, detector in (("atomic", atomic), ("threshold", threshold), ("chain", sequence)):
        if own := [r for r in rules if r.type == kind]:
            part = detector(events, own)
            out = part if out is None else out.unionByName(part)
    return out
