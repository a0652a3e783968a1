"""Markers, noise, echoes, speech gate, trailing punctuation. Null in: null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .rewrite import let


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{C.BLANK}]+|[{C.BLANK}]+\z", "")


def strip_markers(c: Column) -> Column:
    """Drops a leading ``language NAME<asr_text>``, once."""
    return F.regexp_replace(c, rf"(?iu)\A[{C.BLANK}]*language[{C.BLANK}]+[A-Za-z()\- ]+<asr_text>", "")


def strip_sil(c: Column) -> Column:
    return F.replace(c, F.lit("/sil"), F.lit(""))


def longest_common_run(a: Column, b: Column) -> Column:
    """Length of the longest common substring: the largest k such that some k characters of a stand in b.

    Common k-grams for k imply common ones for less, so k is found by bisection in at most 31 steps.
    """

    def common(x: Column, y: Column, k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(x) - k + 1, F.lit(1)))
        return (k <= F.length(x)) & (k <= F.length(y)) & F.exists(starts, lambda i: F.contains(y, F.substring(x, i, k)))

    def search(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("lo"), F.least(F.length(p["a"]), F.length(p["b"])).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
            ok = (s["lo"] < s["hi"]) & common(p["a"], p["b"], mid)
            return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid - 1).alias("hi"))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.least(F.length(p["a"]), F.length(p["b"])) + 2)).cast("int"))
        return F.aggregate(steps, start, step, lambda s: s["lo"])

    return let(F.struct(a.alias("a"), b.alias("b")), search)


def is_prompt_echo(c: Column, prompt: str | Column) -> Column:
    """Whether at least ECHO_RUN characters and ECHO_SHARE of the text are one run of the prompt, blanks aside.

    Some run of k characters is common exactly if some k-gram of the text stands in the prompt.
    """
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), rf"[{C.BLANK}]+", "")

    def told(p: Column) -> Column:
        n = F.length(p["t"])
        k = F.greatest(F.lit(C.ECHO_RUN), F.ceil(n * C.ECHO_SHARE).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        return F.when((n >= k) & (k <= F.length(p["q"])), F.exists(starts, lambda i: F.contains(p["q"], F.substring(p["t"], i, k)))).otherwise(False)

    return let(F.struct(bare(c).alias("t"), bare(prompt).alias("q")), told)


def has_spoken_content(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[\p{L}\p{N}]")


def strip_trailing_punctuation(c: Column) -> Column:
    """Cuts the run of enders at the very end; closers behind it stay."""
    return F.regexp_replace(c, rf"[{C.TRAILING}]+([{C.CLOSERS}]*)\z", "$1")
