"""Token deltas of requests, in batch: live marker filter, final texts, events.

A request is one short recording, so its deltas are collected in one row; requests are spread over the
cluster by their id. Rows: (request_id, seq, delta); ties in seq are ordered by delta.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.rewrite import let
from ..plans.pipeline import CleanupOptions, finalize


def _ordered(deltas: DataFrame) -> DataFrame:
    turn = F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta"))
    return deltas.groupBy("request_id").agg(F.array_sort(F.collect_list(turn)).alias("_ds"))


def _visible(ds: Column) -> Column:
    """array<struct<seq, text>> of what the marker filter lets through, the flush at the end included.

    Text is held back until the tag is seen, or STREAM_HOLD characters are held. The fold carries the held
    text and where the hold ended; it stops growing there, so a long request costs what its text costs.
    """
    start = F.struct(F.lit("").alias("held"), F.lit(-1).alias("done"), F.lit(0).alias("i"))

    def step(a: Column, d: Column) -> Column:
        held = F.concat(a["held"], d["delta"])
        opened = F.contains(F.lower(held), F.lit(C.STREAM_TAG)) | (F.length(held) >= C.STREAM_HOLD)
        waiting = a["done"] < 0
        return F.struct(
            F.when(waiting, held).otherwise(a["held"]).alias("held"),
            F.when(waiting & opened, a["i"]).otherwise(a["done"]).alias("done"),
            (a["i"] + 1).alias("i"),
        )

    def told(s: Column) -> Column:
        at = F.locate(C.STREAM_TAG, F.lower(s["held"]))
        after = F.when(at > 0, F.substring(s["held"], at + len(C.STREAM_TAG), F.length(s["held"]))).otherwise(s["held"])
        text = lambda d, i: F.when(s["done"] < 0, "").when(i < s["done"], "").when(i == s["done"], after).otherwise(d["delta"])
        live = F.transform(ds, lambda d, i: F.struct(d["seq"].alias("seq"), text(d, i).alias("text")))
        last = F.element_at(ds, -1)["seq"] + 1
        flush = F.array(F.struct(last.alias("seq"), F.when(s["done"] < 0, s["held"]).otherwise("").alias("text")))
        return F.filter(F.concat(live, flush), lambda x: x["text"] != "")

    return let(F.aggregate(ds, start, step), told)


def marker_filter(deltas: DataFrame) -> DataFrame:
    """(request_id, seq, text): the visible deltas, none empty; a text held to the end comes at the last seq + 1."""
    out = _ordered(deltas).select("request_id", F.explode(_visible(F.col("_ds"))).alias("v"))
    return out.select("request_id", F.col("v.seq").alias("seq"), F.col("v.text").alias("text"))


def raw_texts(deltas: DataFrame) -> DataFrame:
    """(request_id, raw): a request's deltas, joined in order."""
    return _ordered(deltas).select("request_id", F.array_join(F.transform("_ds", lambda d: d["delta"]), "").alias("raw"))


def final_texts(deltas: DataFrame, options: CleanupOptions | None = None) -> DataFrame:
    """(request_id, raw, text): the whole clean-up of the joined deltas."""
    return finalize(raw_texts(deltas), "raw", "text", options)


def stream_events(deltas: DataFrame, options: CleanupOptions | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(request_id, event_seq, type, text, message): delta events, then final and done; or, for a request in
    ``errors`` (request_id, message), the deltas so far and an error event in place of both."""
    kind = "struct<type:string,text:string,message:string>"
    none = F.lit(None).cast("string")
    event = lambda t, text, message: F.struct(F.lit(t).alias("type"), text.alias("text"), message.alias("message")).cast(kind)
    rows = _ordered(deltas).withColumn("raw", F.array_join(F.transform("_ds", lambda d: d["delta"]), ""))
    rows = finalize(rows, "raw", "_final", options)
    if errors is None:
        rows = rows.withColumn("_error", none)
    else:
        told = errors.groupBy("request_id").agg(F.min(F.coalesce("message", F.lit(""))).alias("_error"))
        rows = rows.join(told, "request_id", "full")
    live = F.coalesce(F.transform(_visible(F.col("_ds")), lambda v: event("delta", v["text"], none)), F.array().cast(f"array<{kind}>"))
    end = F.when(F.col("_error").isNotNull(), F.array(event("error", none, F.col("_error")))).otherwise(
        F.array(event("final", F.col("_final"), none), event("done", none, none))
    )
    out = rows.select("request_id", F.posexplode(F.concat(live, end)).alias("event_seq", "e"))
    return out.select("request_id", F.col("event_seq").cast("long").alias("event_seq"), "e.type", "e.text", "e.message")


def sse_encode(events: DataFrame) -> DataFrame:
    """Adds ``line``: the event as a server-sent line, non-ASCII characters as they are, absent fields left out."""
    return events.withColumn("line", F.concat(F.lit("data: "), F.to_json(F.struct("type", "text", "message")), F.lit("\n\n")))
