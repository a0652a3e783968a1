"""Readers of raw transcripts, engine replies, server-sent streams, audio and uploads; writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from email.parser import BytesParser
from email.policy import HTTP

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text_ops import strip_blanks

REPLY = "struct<text:string>"


def read_transcripts(spark: SparkSession, path: str, raw: str = "raw", fmt: str = "parquet") -> DataFrame:
    """Any format that Spark reads; ``text`` gives one transcript a line."""
    df = spark.read.format(fmt).load(path)
    return df.withColumnRenamed("value", raw) if fmt == "text" else df


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, content)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def _json_string(json: Column, path: str) -> Column:
    """The string at a path; null if there is none, or a number or object, which get_json_object gives as text."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(json, path))


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds raw, status and error: an engine's JSON reply must be an object with a string ``text``."""
    text = _json_string(F.col(reply), "$.text")
    ok = text.isNotNull()
    return df.withColumns(
        {
            "raw": F.when(ok, text),
            "status": F.when(ok, 200).otherwise(502),
            "error": F.when(~ok, F.lit("engine reply has no text")),
        }
    )


def sse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds delta (null if the line carries none) and is_end of server-sent lines; malformed ones carry none."""
    stripped = strip_blanks(F.coalesce(F.col(line), F.lit("")))
    data = F.when(F.startswith(stripped, F.lit("data:")), strip_blanks(F.substring(stripped, 6, 1 << 30)))
    content = _json_string(data, "$.choices[0].delta.content")
    return df.withColumns({"delta": F.when(content != "", content), "is_end": F.coalesce(data == "[DONE]", F.lit(False))})


def sse_decode(df: DataFrame, line: str = "line") -> DataFrame:
    """(request_id, seq, delta) of the lines (request_id, seq, line) before a request's first end mark."""
    told = sse_lines(df, line)
    ends = told.where("is_end").groupBy("request_id").agg(F.min("seq").alias("_end"))
    kept = told.where("delta IS NOT NULL").join(ends, "request_id", "left").where("_end IS NULL OR seq < _end")
    return kept.select("request_id", "seq", "delta")


def stream_sse(spark: SparkSession, path: str, schema: str = "request_id string, seq long, line string") -> DataFrame:
    """Server-sent lines as they arrive: a stream of (request_id, seq, delta, is_end)."""
    return sse_lines(spark.readStream.schema(schema).json(path)).where("is_end OR delta IS NOT NULL").select("request_id", "seq", "delta", "is_end")


def parse_upload(content_type: str | None, body: bytes | None) -> tuple[bytes | None, str | None, str | None]:
    """(content, filename, error) of a multipart upload: the first part named "file"."""
    if not (content_type or "").lower().startswith("multipart/form-data"):
        return None, None, "not multipart/form-data"
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + (body or b""))
    for part in message.iter_parts() if message.is_multipart() else ():
        disposition = part.get("Content-Disposition", "")
        if "form-data" in disposition and part.get_param("name", header="content-disposition") == "file":
            content = part.get_payload(decode=True) or b""
            return (content, part.get_filename() or "audio.wav", None) if content else (None, None, "empty file")
    return None, None, "no file part"


def decode_uploads(df: DataFrame, content_type: str = "content_type", body: str = "body") -> DataFrame:
    """``df`` with content, filename, status (200 or 400) and error."""
    fields = [T.StructField("content", T.BinaryType()), T.StructField("filename", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *fields])
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_upload(t, None if b is None else bytes(b)) for t, b in zip(pdf[content_type], pdf[body])]
            yield pdf.assign(content=[g[0] for g in got], filename=[g[1] for g in got], status=[400 if g[2] else 200 for g in got], error=[g[2] for g in got])

    return df.mapInPandas(run, schema)


def transcribe(df: DataFrame, engine: Callable[[bytes, str], str], content: str = "content", filename: str = "filename") -> DataFrame:
    """Hook for an external engine, off unless called: adds raw, status (200 or 502) and error."""
    schema = T.StructType([*df.schema.fields, T.StructField("raw", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, status, error = [], [], []
            for c, f in zip(pdf[content], pdf[filename]):
                try:
                    raw.append(engine(bytes(c), f)), status.append(200), error.append(None)
                except Exception as e:  # an engine's failure is a row's result
                    raw.append(None), status.append(502), error.append(str(e)[:300])
            yield pdf.assign(raw=raw, status=status, error=error)

    return df.mapInPandas(run, schema)


def chat_request(df: DataFrame, model: str, prompt: str = "", temperature: float = 0.0, content: str = "content") -> DataFrame:
    """Adds payload: the JSON of a streaming chat request, the audio in base64, the prompt as a text part if any."""
    data = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))  # Spark's base64 breaks lines
    audio = F.struct(F.lit("input_audio").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(data.alias("data"), F.lit("wav").alias("format")).alias("input_audio"))
    text = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"), F.lit(None).cast("struct<data:string,format:string>").alias("input_audio"))
    parts = F.array(text, audio) if prompt else F.array(audio)
    body = F.struct(F.lit(model).alias("model"), F.lit(True).alias("stream"), F.lit(temperature).alias("temperature"), F.array(F.struct(F.lit("user").alias("role"), parts.alias("content"))).alias("messages"))
    return df.withColumn("payload", F.to_json(body))


def write_texts(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.format(fmt).save(path)
