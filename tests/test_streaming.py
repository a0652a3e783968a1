"""The stream gives what the batch gives, whatever order its rows come in."""

import random

import pytest
from pyspark.sql import functions as F

from scribewash.operators import deltas
from scribewash.streaming import marker_filter
from scribewash.streaming.marker_filter import live_events

REQUESTS = {
    "a": ["language", " Chinese", "<asr_text>", "嗯，", "第一点买牛奶", "。"],
    "b": ["没有", "标记"],
    "c": ["x" * 70, "tail", ""],
    "d": ["lang", "uage en<ASR_", "TEXT>Hello", " world."],
    "e": [],
    "f": ["it", " broke"],
}
FAILED = {"f": "engine failed"}
SCHEMA = "request_id string, seq long, delta string, is_end boolean, error string"


def rows():
    out = [(k, i, d, False, None) for k, ds in REQUESTS.items() for i, d in enumerate(ds)]
    return out + [(k, len(ds), None, k not in FAILED, FAILED.get(k)) for k, ds in REQUESTS.items()]


def run(spark, parts, tmp_path, name, **options):
    src = tmp_path / "in"
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    query = (
        live_events(stream, timeout_ms=None, **options).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()
    return spark.table(name)


@pytest.mark.parametrize("order", ["as they come", "late, repeated and out of order"])
def test_stream_equals_batch(spark, tmp_path, order):
    every = rows()
    parts = [every[0:5], every[5:9], every[9:]]
    if order != "as they come":
        rng = random.Random(5)
        every = every + rng.sample(every, 8)
        rng.shuffle(every)
        ends = [r for r in rows() if r[3]]
        late = [(r[0], r[1] + 1 + k, "late", k == 1, None) for r in ends for k in range(2)]
        parts = [every[:6], every[6:15], every[15:], late]
    got = run(spark, parts, tmp_path, "live_" + order.split()[0].strip(","))
    known = [r[:3] for r in rows() if not r[3] and not r[4]]
    batch = deltas.stream_events(spark.createDataFrame(known, "request_id string, seq long, delta string"), None, spark.createDataFrame(list(FAILED.items()), "request_id string, message string"))
    told = lambda df: sorted(tuple("" if x is None else str(x) for x in r) for r in df.select("request_id", "type", "text", "message", "event_seq").collect() if r[0] != "e")
    assert told(got) == told(batch)
    assert sorted((r.type, r.text) for r in got.where("request_id = 'e'").collect()) == [("done", None), ("final", "")]


class State:
    """What a group state offers, for calls without a query."""

    def __init__(self):
        self.held, self.exists, self.hasTimedOut, self.removed = None, False, False, False

    get = property(lambda self: self.held)

    def update(self, v):
        self.held, self.exists = v, True

    def remove(self):
        self.removed, self.exists = True, False

    def setTimeoutDuration(self, ms):
        self.waits = ms


def test_a_silent_request_is_closed_once_and_then_forgotten():
    import pandas as pd

    update, state = marker_filter._updater("<asr_text>", 64, 1000, False), State()
    call = lambda *r: [tuple(x)[1:4] for p in update(("k",), iter([pd.DataFrame(r, columns=["seq", "delta", "is_end", "error"])] if r else []), state) for x in p.itertuples(index=False)]
    assert call((0, "abc", False, None), (2, "ghi", False, None)) == []  # 1 is missing
    state.hasTimedOut = True
    assert call() == [(0, "delta", "abcghi"), (1, "final", "abcghi"), (2, "done", None)] and not state.removed
    state.hasTimedOut = False
    assert call((1, "def", False, None), (3, "", True, None)) == []
    state.hasTimedOut = True
    assert call() == [] and state.removed


def test_event_time_closes_silent_requests(spark, tmp_path):
    schema = SCHEMA + ", at timestamp"
    ts = lambda m: F.to_timestamp(F.lit(f"2024-01-01 00:{m:02d}:00"))
    src = tmp_path / "in"
    for m, part in ((0, [("s", 0, "hello", False, None)]), (5, [("t", 0, "x", False, None)]), (30, [("u", 0, "y", False, None)]), (31, [("u", 1, None, True, None)])):
        spark.createDataFrame(part, SCHEMA).withColumn("at", ts(m)).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)).withWatermark("at", "1 minute")
    query = (
        live_events(stream, timeout_ms=600_000, event_time="at").writeStream.format("memory").queryName("timed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()
    done = {r.request_id for r in spark.table("timed").where("type = 'done'").collect()}
    assert {"s", "t", "u"} == done


def test_options_are_read_anew_in_every_batch(spark, tmp_path):
    """The dictionary changes between two micro-batches."""
    from scribewash.functions.commands import load_profiles
    from scribewash.plans.pipeline import CleanupOptions

    src, out = tmp_path / "in", str(tmp_path / "out")
    for k, name in enumerate(("one", "two")):
        part = [(name, 0, "say gow now", False, None), (name, 1, None, True, None)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(src))
    asked = []

    def options():
        asked.append(1)
        return CleanupOptions(profiles=load_profiles(extra_json='{"go": ["gow"]}' if len(asked) > 1 else None))

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    query = marker_filter.write_live_events(stream, out, str(tmp_path / "ck"), options, timeout_ms=None).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()
    finals = sorted(r.text for r in spark.read.parquet(out).where("type = 'final'").collect())
    assert len(asked) == 2 and finals == ["say go now", "say gow now"]
