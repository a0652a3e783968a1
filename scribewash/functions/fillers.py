"""Spoken fillers and stutters, and the tidying after them. Column to Column, regular expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .rewrite import guarded
from .text_ops import strip_blanks

# A shielded name starts here. A shield also ends a word: what stands before a name has no word after it.
_NAME = C.alternation(C.COCOA_NAMES)
_ND, _GAP = f"(?!{_NAME})([{C.NEVER_DOUBLE}])", f"[{C.STUTTER_GAP}]*"
_SHIELD = "\ue010"

_LEFT_EDGE = f"(?<![{C.WORD}])"
_PAUSE_OR_END = f"(?=[{C.WEAK}{C.STRONG}{C.BLANK}…—]|$)"
_DEICTIC = C.alternation(C.DEICTICS)
_CONN = C.alternation(C.CONNECTORS)
_I = C.INTERJECTION


def _sub(pattern: str, by: str = ""):
    return lambda c: F.regexp_replace(c, pattern, by)


#: 可。可能: a function character, an ender, and the same character at the start of a word.
strong_stutter = _sub(f"{_ND}[{C.STRONG}…]+(?=(?!{_NAME})\\1(?!{_NAME})[{C.WORD}])")


def _chain(group: int) -> str:
    return f"(?:{_GAP}(?!{_NAME})\\{group})++"


def collapse_stutter(c: Column) -> Column:
    """A repeated function character becomes one; with a pause behind it, a comma, or nothing at a line's start."""
    c = guarded(
        c,
        f"([{C.NEVER_DOUBLE}])[{C.STUTTER_GAP}{C.STRONG}]*\\1",
        lambda v: F.regexp_replace(
            F.regexp_replace(
                F.regexp_replace(strong_stutter(v), f"(?dm)^([{C.INLINE_BLANK}]*){_ND}{_chain(2)}[{C.WEAK}]+", "$1"),
                f"{_ND}{_chain(1)}[{C.WEAK}]+",
                "$1，",
            ),
            f"{_ND}{_chain(1)}",
            "$1",
        ),
    )
    return F.replace(c, F.lit(_SHIELD), F.lit(""))


phrase_fillers = _sub(f"(?d){_LEFT_EDGE}{C.alternation(C.PHRASES)}{_PAUSE_OR_END}")
deictic_run = _sub(f"{_LEFT_EDGE}{_DEICTIC}{{2,}}(?![{C.WORD}])")
deictic_single = _sub(f"(?d){_LEFT_EDGE}{_DEICTIC}{_PAUSE_OR_END}")
topic_tail = _sub(f"(?d)(?<=[{_I}]){_DEICTIC}(?=[{C.STRONG}{C.BLANK}…]|$)")
ascii_fillers = _sub(f"(?iu)(?<![A-Za-z]){C.alternation(C.ASCII_FILLERS)}(?![A-Za-z])")

_EXCLAMATION = "(?:哎呀|哎哟)"
# First the runs that become a comma: between words, before a connector, or several with a pure stall.
_TO_COMMA = (
    f"(?<=[{C.WORD}])(?<![{_I}])(?!{_EXCLAMATION}(?![{_I}]))"
    f"(?:[{_I}]++(?={_CONN})|(?=[{_I}]*[{C.PURE}])[{_I}]{{2,}}+(?=[{C.WORD}]))"
)
# Then every other run: particles and glued exclamations are kept (captured), the rest goes.
_KEEP_OR_DROP = (
    f"(?<![{_I}])(?:((?<=[{C.WORD}])[{C.AMBIGUOUS}](?![{_I}])|(?<=[{C.WORD}]){_EXCLAMATION}(?![{_I}])"
    f"|{_EXCLAMATION}(?![{_I}])(?=[{C.WORD}]))|[{_I}]++)"
)


def starts_with_connector(c: Column) -> Column:
    return c.rlike(rf"\A{_CONN}")


def interjection_clusters(c: Column) -> Column:
    """Runs of interjection characters: kept as particles, cut as stalls, or a comma between clauses."""
    return guarded(c, f"[{_I}]", lambda v: F.regexp_replace(F.regexp_replace(v, _TO_COMMA, "，"), _KEEP_OR_DROP, "$1"))


def collapse_space(c: Column) -> Column:
    c = F.regexp_replace(c, f"[{C.HSPACE}]+", " ")
    c = F.regexp_replace(c, f"[{C.HSPACE}]+([{C.WEAK}{C.STRONG}])", "$1")
    return F.regexp_replace(c, f"([{C.FULL}])[{C.HSPACE}]+", "$1")


drop_duplicate_punct = _sub(f"([{C.WEAK}。])(?:[{C.HSPACE}]*\\1)+", "$1")


def resolve_punct_runs(c: Column) -> Column:
    """Next to an ender a pause goes; three rounds."""
    for _ in range(3):
        c = F.regexp_replace(c, f"([{C.STRONG}])[{C.HSPACE}]*([{C.WEAK}])", "$1")
        c = F.regexp_replace(c, f"([{C.WEAK}])[{C.HSPACE}]*([{C.STRONG}])", "$2")
    return c


def tidy_lines(c: Column) -> Column:
    """Of every line: blanks and pauses at both ends go; empty lines go."""
    strip = _sub(f"(?dm)^[{C.INLINE_BLANK}]+|[{C.INLINE_BLANK}]+$")
    c = strip(F.regexp_replace(strip(c), f"(?dm)^[{C.WEAK}]+|[{C.WEAK}]+$", ""))
    return F.regexp_replace(F.regexp_replace(c, r"\n{2,}", "\n"), r"\A\n|\n\z", "")


def tidy(c: Column) -> Column:
    return tidy_lines(resolve_punct_runs(drop_duplicate_punct(collapse_space(c))))


#: The filler stage, in order.
STAGES = (
    collapse_stutter, phrase_fillers, deictic_run, deictic_single, interjection_clusters, topic_tail, ascii_fillers, tidy, strip_blanks,
)


def filter_fillers(c: Column) -> Column:
    """The whole filler stage; order matters."""
    for stage in STAGES:
        c = stage(c)
    return c
