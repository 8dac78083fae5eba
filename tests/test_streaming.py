import random

from watchfold.operators import detect
from watchfold.sources import config
from watchfold.streaming import detect as streams

from test_engine import event_rows

RULE = config.Rule("R", "r", "threshold", "low", 3002, filter="status == 'Failure'", threshold=3, window=4, group_by="user.name")


def test_thresholds_on_a_stream_equal_a_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 1_700_000_000_000 + i * 700, 3002, "h", rng.choice("ab"), None, None, rng.choice(["Failure", "Success"]), {}) for i in range(120)]
    batches = [rows[at:at + 30] for at in range(0, 120, 30)]
    for b in batches:
        rng.shuffle(b)  # within a batch in any order
    end = [(999, 1_700_000_000_000 + 10_000_000, 3002, "h", "z", None, None, "Failure", {})]  # moves the watermark past all others
    for n, b in enumerate([*batches, end, [(1000, end[0][1] + 1, *end[0][2:])]]):
        event_rows(spark, b).coalesce(1).write.parquet(f"{tmp_path}/in/batch={n}")
    schema = event_rows(spark, rows[:1]).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streams.threshold(events, [RULE], "30 seconds").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        got = {(r.group_key, r.ts_ms, tuple(r.event_ids)) for r in spark.table("fired").collect()}
    finally:
        query.stop()
    want = {(r.group_key, r.ts_ms, tuple(r.event_ids)) for r in detect.threshold(event_rows(spark, rows), [RULE]).collect()}
    assert got == want and want


def test_chains_on_a_stream_equal_a_batch(spark, tmp_path):
    rule = config.Rule("S", "s", "chain", "low", window=5, match_on="user.name", steps=(config.Step("status == 'Failure'"), config.Step("status == 'Success'")))
    rng = random.Random(5)
    rows = [(i, 1_700_000_000_000 + i // 2 * 700, 3002, "h", rng.choice("abc"), None, None, rng.choice(["Failure", "Success", "Success"]), {}) for i in range(160)]
    batches = [rows[at:at + 40] for at in range(0, 160, 40)]
    for b in batches:
        rng.shuffle(b)
    end = [(999, 1_700_000_000_000 + 10_000_000, 3002, "h", "z", None, None, "Failure", {})]
    for n, b in enumerate([*batches, end, [(1000, end[0][1] + 1, *end[0][2:])]]):
        event_rows(spark, b).coalesce(1).write.parquet(f"{tmp_path}/in/batch={n}")
    events = spark.readStream.schema(event_rows(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streams.sequence(events, [rule], "60 seconds").writeStream.format("memory").queryName("chained").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        got = sorted((r.group_key, r.ts_ms, tuple(r.event_ids)) for r in spark.table("chained").collect())
    finally:
        query.stop()
    want = sorted((r.group_key, r.ts_ms, tuple(r.event_ids)) for r in detect.sequence(event_rows(spark, rows), [rule]).collect())
    assert got == want and want


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(i, 1_700_000_000_000 + i * 60_000, 3002, "h", "a", None, None, "Failure", {}) for i in range(180)]
    event_rows(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(event_rows(spark, rows[:1]).schema).parquet(f"{tmp_path}/in")
    query = streams.timeline(events).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    hits = streams.atomic(events, [config.Rule("A", "a", "atomic", "low", filter="status == 'Failure'")]).writeStream.format("memory").queryName("hits").start()
    try:
        query.processAllAvailable(), hits.processAllAvailable()
        assert sum(r.n for r in spark.table("hours").collect()) == 180 and spark.table("hits").count() == 180
    finally:
        query.stop(), hits.stop()
