"""The composed clean-up of raw transcripts: one projection, no shuffle, no Python on the executors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import commands, fillers, numerals
from ..functions.commands import Profiles, load_profiles
from ..functions.constants import CJK
from ..functions.rewrite import Rewrite
from ..functions.text_ops import has_spoken_content, is_prompt_echo, strip_blanks, strip_markers, strip_sil, strip_trailing_punctuation

ORGANIZERS = ("none", "rule")


@dataclass(frozen=True)
class CleanupOptions:
    """organizer: "rule" drops fillers, "none" does not; the other stages run under both unless switched off."""

    organizer: str = "rule"
    prompt: str = ""
    strip_trailing_punct: bool = True
    numerals: bool = True
    commands: bool = True
    log_raw: bool = False
    profiles: Profiles = field(default_factory=load_profiles)

    def __post_init__(self) -> None:
        if self.organizer not in ORGANIZERS:
            raise ValueError(f"organizer: one of {', '.join(ORGANIZERS)}")


#: Without one of these characters no Chinese rule can apply, and no earlier stage brings one in.
CHINESE = f"[〇{CJK}]"


@dataclass(frozen=True)
class Stage:
    """Rewrites that share a projection; ``chinese`` ones are skipped for texts without a Chinese character."""

    rewrites: tuple[Rewrite, ...]
    chinese: bool = False

    def __call__(self, c: Column) -> Column:
        for rewrite in self.rewrites:
            c = rewrite(c)
        return c


def stages(options: CleanupOptions) -> list[Stage]:
    """The clean-up in order: simple rewrites share a projection, those that use their input twice have their own."""
    o = options
    found = [Stage((lambda c: F.coalesce(c, F.lit("")), strip_markers, strip_sil))]
    if o.prompt:
        found.append(Stage((lambda c: F.when(is_prompt_echo(c, o.prompt), "").otherwise(c),)))
    if o.organizer == "rule":
        f = fillers
        found += [
            Stage((f.collapse_stutter,), True),
            Stage((f.phrase_fillers, f.deictic_run, f.deictic_single, f.interjection_clusters, f.topic_tail), True),
            Stage((f.ascii_fillers, f.tidy, strip_blanks)),
        ]
    if o.numerals:
        n = numerals
        found += [Stage((x,), True) for x in (n.acronym_digits, n.clock_times, n.percentages, n.calendar_units, n.money, n.composite_numbers)]
        found.append(Stage((n.drop_reserved,)))
    if o.commands:
        tokens = lambda c: commands.ascii_tokens(c, o.profiles)
        found += [Stage((commands.join_spelled_letters, tokens)), Stage(tuple(commands.ascii_phrase_stages(o.profiles)))]
        # Listed spellings may hold any character, and a command may be Chinese: no skipping here.
        found += [Stage((x,)) for x in commands.cjk_alias_stages(o.profiles)]
    ended = strip_trailing_punctuation if o.strip_trailing_punct else (lambda c: c)
    return [*found, Stage((lambda c: F.when(has_spoken_content(c), ended(c)).otherwise(""),))]


_WORK, _CHINESE = "_scribewash_text", "_scribewash_chinese"
_BUILT: dict[tuple, list[Column]] = {}


def _built(options: CleanupOptions) -> list[Column]:
    """The stages' expressions over the working column. Building them takes some 25,000 calls into the JVM, and they
    hang on the options alone: those of the last few options are kept."""
    key = (id(SparkContext._gateway), options.organizer, options.prompt, options.strip_trailing_punct, options.numerals, options.commands, json.dumps(options.profiles))
    if key not in _BUILT:
        while len(_BUILT) >= 8:
            _BUILT.pop(next(iter(_BUILT)))
        text = F.col(_WORK)
        _BUILT[key] = [F.when(F.col(_CHINESE), s(text)).otherwise(text) if s.chinese else s(text) for s in stages(options)]
    return _BUILT[key]


def finalize(df: DataFrame, raw: str = "raw", out: str = "text", options: CleanupOptions | None = None) -> DataFrame:
    """``df`` with the cleaned text of ``raw`` as ``out``: empty (never null) if there is no speech in it.

    Each stage is a projection over a plain column: the plan grows by one node a stage, is resolved stage
    by stage, and an expression that uses its input twice does not copy the stages before it.
    """
    df = df.withColumns({_WORK: F.col(raw), _CHINESE: F.coalesce(F.col(raw).rlike(CHINESE), F.lit(False))})
    for done in _built(options or CleanupOptions()):
        df = df.withColumn(_WORK, done)
    return df.withColumn(out, F.col(_WORK)).drop(_WORK, _CHINESE)


def clean(df: DataFrame, raw: str = "raw", out: str = "text", options: CleanupOptions | None = None, observe: str | Observation | None = None) -> DataFrame:
    """``df`` with the cleaned column ``out``; with ``log_raw`` or ``observe`` the audit columns and counters, too."""
    o = options or CleanupOptions()
    cleaned = finalize(df, raw, out, o)
    if not o.log_raw and raw != out:
        cleaned = cleaned.drop(raw)
    if observe:
        cleaned = cleaned.observe(observe, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(out) == "").alias("silent"))
    return cleaned
