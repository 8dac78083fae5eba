"""Detection on streams: stateless rules, windows, and thresholds with state."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchfold.operators import detect
from watchfold.sources.config import Rule


def with_time(events: DataFrame, late: str) -> DataFrame:
    """Events with a time column and a watermark: what is later than ``late`` is dropped."""
    return events.withColumn("time", F.timestamp_millis("ts_ms")).withWatermark("time", late)


def timeline(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, n) of tumbling or sliding windows."""
    window = F.window("time", width, slide) if slide else F.window("time", width)
    return with_time(events, late).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "host") -> DataFrame:
    """(key, start, end, n) of runs of events without a gap."""
    window = F.session_window("time", gap).alias("w")
    counted = with_time(events, late).groupBy(key, window).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, col("w.start").alias("start"), col("w.end").alias("end"), "n")


def atomic(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits (rule_id, ts_ms, event_id) of atomic rules, as they come."""
    hits = F.array(*(F.when(detect.matches(r), F.lit(r.id)) for r in rules))
    return events.select("ts_ms", "event_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule_id"))


_STATE = "seen_ts array<bigint>, seen_id array<bigint>, wait_ts array<bigint>, wait_id array<bigint>"
_FOUND = "rule int, group_key string, ts_ms bigint, event_ids array<bigint>"


def threshold(events: DataFrame, rules: list[Rule], late: str = "1 minute") -> DataFrame:
    """Firings (rule, group_key, ts_ms, event_ids) of threshold rules, the same as a batch over the events that aren't late.

    Events wait until the watermark has passed them and are then counted in the
    order of (ts_ms, event_id), however they arrived.  A group's state is what is
    within its window and what waits; it goes when both are over.
    """
    limits = [(r.threshold, r.window * 1000) for r in rules]
    hits = F.array(*(F.when(detect.matches(r), F.struct(F.lit(i).alias("rule"), detect.group_of(r).alias("group_key"))) for i, r in enumerate(rules)))
    rows = with_time(events, late).select("time", "ts_ms", "event_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    rows = rows.select("time", "ts_ms", "event_id", "h.rule", "h.group_key")

    def step(key, frames, state: GroupState):
        rule, group = key
        need, window = limits[rule]
        seen_ts, seen_id, wait_ts, wait_id = map(list, state.get) if state.exists else ([], [], [], [])
        for frame in frames:
            wait_ts += frame["ts_ms"].tolist()
            wait_id += frame["event_id"].tolist()
        passed = state.getCurrentWatermarkMs()
        waiting = sorted(zip(wait_ts, wait_id))
        counter = detect.Threshold(need, window)
        counter.held.extend(zip(seen_ts, seen_id))
        found, due = [], bisect_left(waiting, (passed,))
        for ts, event_id in waiting[:due]:
            if ids := counter.see(ts, event_id):
                found.append((rule, group, ts, ids))
        waiting = waiting[due:]
        held = [h for h in counter.held if h[0] >= passed - window]
        if held or waiting:
            state.update(([t for t, _ in held], [e for _, e in held], [t for t, _ in waiting], [e for _, e in waiting]))
            next_at = waiting[0][0] if waiting else held[-1][0] + window
            state.setTimeoutTimestamp(max(next_at, passed) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["rule", "group_key", "ts_ms", "event_ids"])

    return rows.groupBy("rule", "group_key").applyInPandasWithState(step, _FOUND, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sequence(events: DataFrame, rules: list[Rule], late: str = "1 minute") -> DataFrame:
    """Firings (rule, group_key, ts_ms, event_ids) of chain rules, the same as a batch over the events that aren't late.

    Events that fit a step wait until the watermark has passed them.  A second step
    then takes the earliest first step in the window before it; of the second steps
    of one millisecond only the first fires.  A group's state is the first steps of
    the last window and what waits.
    """
    windows = [r.window * 1000 for r in rules]
    step_of = lambda r: F.when(detect.matches(r.steps[1]), 1).when(detect.matches(r.steps[0]), 0)
    key_of = lambda r: F.coalesce(detect.get(r.match_on), F.lit(""))
    hits = F.array(*(F.when(step_of(r).isNotNull() & (key_of(r) != ""), F.struct(F.lit(i).alias("rule"), step_of(r).alias("step"), key_of(r).alias("group_key")))
                     for i, r in enumerate(rules)))
    rows = with_time(events, late).select("time", "ts_ms", "event_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    rows = rows.select("time", "ts_ms", "event_id", "h.rule", "h.step", "h.group_key")

    def step(key, frames, state: GroupState):
        rule, group = key
        first_ts, first_id, wait_ts, wait_id, wait_step, fired = state.get if state.exists else ([], [], [], [], [], -2**63)
        firsts, waiting = list(zip(first_ts, first_id)), list(zip(wait_ts, wait_id, wait_step))
        for frame in frames:
            waiting += zip(frame["ts_ms"].tolist(), frame["event_id"].tolist(), frame["step"].tolist())
        waiting.sort()
        passed, window, found, at = state.getCurrentWatermarkMs(), windows[rule], [], 0
        due = bisect_left(waiting, (passed,))
        for ts, event_id, number in waiting[:due]:
            if number == 0:
                firsts.append((ts, event_id))
                continue
            while at < len(firsts) and firsts[at][0] < ts - window:
                at += 1
            if at < len(firsts) and ts != fired:
                fired = ts
                found.append((rule, group, ts, [firsts[at][1], event_id]))
        waiting, firsts = waiting[due:], [f for f in firsts[at:] if f[0] >= passed - window]
        if firsts or waiting:
            state.update(([t for t, _ in firsts], [e for _, e in firsts], *([w[i] for w in waiting] for i in range(3)), fired))
            state.setTimeoutTimestamp(max(waiting[0][0] if waiting else firsts[-1][0] + window, passed) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["rule", "group_key", "ts_ms", "event_ids"])

    kept = "first_ts array<bigint>, first_id array<bigint>, wait_ts array<bigint>, wait_id array<bigint>, wait_step array<int>, fired bigint"
    return rows.groupBy("rule", "group_key").applyInPandasWithState(step, _FOUND, kept, "append", GroupStateTimeout.EventTimeTimeout)


def ingest_batches(lines_stream: DataFrame, ingest_one, checkpoint: str):
    """Start a query that hands every micro-batch of lines to ``ingest_one(df, batch_id)``; a batch that is repeated after a failure has the same id."""
    return lines_stream.writeStream.foreachBatch(ingest_one).option("checkpointLocation", checkpoint).start()
