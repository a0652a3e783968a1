"""Chat formatting as a relational plan: Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share one
block; everything is concatenated by array functions in one pass over the array (no growing
accumulator, so a conversation of n turns costs O(n)).

Template, for each run of turns with the same role::

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

Control strings inside texts are escaped reversibly: ``<``, any number of backslashes, ``|`` gets
one backslash more; reading back takes one away. A role's backslashes and line breaks are escaped.

Defined results: a null text or role is empty; a null turn number sorts first; equal turn numbers
sort by role, then text; repeated rows are turns of their own; rows with a null conversation id form
one conversation; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    # A backslash pair is one backslash, a backslash and n one line break: pairs go first, by a stand-in.
    parts = F.split(unescape(c), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv``, formatted string, segments array<struct<text, loss>>.

    The segments' texts, joined, are ``formatted``; ``loss`` marks those that a model is trained on
    (the escaped texts of the assistant's turns, without any control string).
    """
    blank = F.lit("")
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), blank).alias("role"),
            F.coalesce(F.col(text), blank).alias("text"),
        ).alias("_t"),
    )
    grouped = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    ts = F.col("_ts")

    def lead_in(t: Column, i: Column) -> Column:
        fresh = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        merged = F.get(ts, i - 1)["role"] == t["role"]
        return F.when(i == 0, fresh).when(merged, F.lit(SEP)).otherwise(F.concat(F.lit(END + "\n"), fresh))

    pairs = F.transform(
        ts,
        lambda t, i: F.array(
            F.struct(lead_in(t, i).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == F.lit(LOSS_ROLE)).alias("loss")),
        ),
    )
    tail = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    out = grouped.select("_conv", F.concat(F.flatten(pairs), tail).alias("segments"))
    return out.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted string holds, unescaped, unmerged."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)  # nothing follows the last end mark

    def turns_of(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        cut = F.locate("\n", body)
        role = unescape_role(F.substring(body, F.lit(1), cut - 1))
        texts = F.split(F.substring(body, cut + 1, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(segments: Column) -> Column:
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")


def chat_digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The digest columns of a formatted table, all read back from its strings."""
    read = formatted.select(
        conv,
        read_back(F.col("formatted")).alias("_r"),
        loss_text(F.col("segments")).alias("_l"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("_r", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv,
        F.size("_r").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_l").cast("long").alias("loss_chars"),
        F.sha2(F.col("_l").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
