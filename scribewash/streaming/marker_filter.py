"""The live marker filter and the final texts as a stream.

Input: a streaming (request_id string, seq long, delta string, is_end boolean), and, if there is such a
column, error string. ``seq`` counts a request's rows from 0, its end row included. Rows take effect in the
order of seq, whatever order and micro-batch they arrive in: a row that comes too early waits for those
before it; one that has been seen (a repeat) is dropped. A row with an error ends the request with an error
event in place of final and done.

State of a request: the held text, whether the hold has ended, all raw text so far (for the final clean-up),
the next event number, the next seq, the rows that wait. A request that falls silent is closed by a timeout, as
if its end had come, with the waiting rows in their order. A closed request is remembered for another timeout,
so that late rows do not open it again; then its state goes.

Timeouts are in processing time; with ``event_time`` (a timestamp column with a watermark) in event time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C
from ..plans.pipeline import CleanupOptions, finalize

OUTPUT = "request_id string, event_seq long, type string, raw string, message string"
STATE = "held string, done boolean, raw string, n long, next long, waiting string, closed boolean, seen long"


class _Request:
    """One request's state, and the events of this call."""

    def __init__(self, key: str, state: tuple | None, tag: str, hold: int):
        self.key, self.tag, self.hold = key, tag, hold
        self.held, self.done, self.raw, self.n, self.next, waiting, self.closed, self.seen = state or ("", False, "", 0, 0, "[]", False, 0)
        self.waiting = {seq: rest for seq, *rest in json.loads(waiting)}
        self.events: list[tuple] = []

    def state(self) -> tuple:
        return self.held, self.done, self.raw, self.n, self.next, json.dumps([(k, *v) for k, v in sorted(self.waiting.items())]), self.closed, self.seen

    def emit(self, kind: str, text: str | None, message: str | None = None) -> None:
        self.events.append((self.key, self.n, kind, text, message))
        self.n += 1

    def take(self, delta: str, is_end: bool, error: str | None) -> None:
        if error is not None or is_end:
            self.close(error)
            return
        self.raw += delta
        if self.done:
            visible = delta
        else:
            self.held += delta
            at = self.held.lower().find(self.tag)
            self.done = at >= 0 or len(self.held) >= self.hold
            visible = (self.held[at + len(self.tag) :] if at >= 0 else self.held) if self.done else ""
            self.held = "" if self.done else self.held
        if visible:
            self.emit("delta", visible)

    def add(self, rows: Iterator[tuple]) -> None:
        for seq, delta, is_end, error in rows:
            if seq >= self.next and not self.closed:
                self.waiting.setdefault(int(seq), [delta if isinstance(delta, str) else "", bool(is_end), error if isinstance(error, str) else None])
        while not self.closed and self.next in self.waiting:
            row = self.waiting.pop(self.next)
            self.next += 1
            self.take(*row)

    def close(self, error: str | None = None) -> None:
        if not self.done and self.held:
            self.emit("delta", self.held)
        if error is None:
            self.emit("final", self.raw)
            self.emit("done", None)
        else:
            self.emit("error", None, error)
        self.held, self.raw, self.closed, self.waiting = "", "", True, {}

    def time_out(self) -> None:
        for seq in sorted(self.waiting):
            if not self.closed:
                self.take(*self.waiting[seq])
        if not self.closed:
            self.close()


def _updater(tag: str, hold: int, timeout_ms: int | None, timed: bool):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request = _Request(key[0], state.get if state.exists else None, tag, hold)
        forget = False
        if state.hasTimedOut:
            forget = request.closed
            if not forget:
                request.time_out()
        else:
            for pdf in batches:
                if timed:
                    request.seen = max(request.seen, int(pdf["at_ms"].max()))
                request.add(zip(pdf["seq"], pdf["delta"], pdf["is_end"], pdf["error"]))
        if forget:
            state.remove()
        else:
            state.update(request.state())
            if timeout_ms is not None and timed:
                state.setTimeoutTimestamp(max(request.seen, state.getCurrentWatermarkMs()) + timeout_ms)
            elif timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(request.events, columns=["request_id", "event_seq", "type", "raw", "message"])

    return update


def _events(deltas: DataFrame, timeout_ms: int | None, event_time: str | None) -> DataFrame:
    """The stream of OUTPUT: final texts as they were said."""
    timed = event_time is not None and timeout_ms is not None
    error = F.col("error").cast("string") if "error" in deltas.columns else F.lit(None).cast("string")
    at = [F.col(event_time), F.unix_millis(event_time).alias("at_ms")] if timed else []
    rows = deltas.select("request_id", "seq", "delta", F.coalesce("is_end", F.lit(False)).alias("is_end"), error.alias("error"), *at)
    update = _updater(C.STREAM_TAG, C.STREAM_HOLD, timeout_ms, timed)
    waits = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("request_id").applyInPandasWithState(update, OUTPUT, STATE, "append", waits)


def _cleaned(events: DataFrame, options: CleanupOptions | None) -> DataFrame:
    cleaned = finalize(events.withColumn("_raw", F.when(F.col("type") == "final", F.col("raw"))), "_raw", "_final", options)
    text = F.when(F.col("type") == "final", F.col("_final")).when(F.col("type") == "delta", F.col("raw"))
    return cleaned.select("request_id", "event_seq", "type", text.alias("text"), "message")


def live_events(
    deltas: DataFrame, options: CleanupOptions | None = None, timeout_ms: int | None = 600_000, event_time: str | None = None
) -> DataFrame:
    """A stream of (request_id, event_seq, type, text, message); the final text has gone through the clean-up.

    Without a timeout (None) only an end or error row closes a request, and closed requests are remembered for
    good: for bounded inputs. A query that is to stop by itself when all input is read (availableNow) needs that
    or ``event_time``, as pending processing-time timeouts keep it running.
    """
    return _cleaned(_events(deltas, timeout_ms, event_time), options)


def write_live_events(
    deltas: DataFrame, path: str, checkpoint: str, options: Callable[[], CleanupOptions], timeout_ms: int | None = 600_000, event_time: str | None = None
) -> DataStreamWriter:
    """As ``live_events``, appended to ``path`` as Parquet, the options asked for anew in every micro-batch.

    So a changed dictionary (``read_profiles``) takes effect without a restart. A batch that is run again after a
    failure writes its own folder (``batch=N``) again, not a second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        _cleaned(batch, options()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _events(deltas, timeout_ms, event_time).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
