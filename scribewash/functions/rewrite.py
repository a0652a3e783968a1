"""Substitution with a function of the hit, as an expression.

A text is split into the gaps between hits and the hits; hits are mapped with sight of their neighbours
in the original text; gaps and hits are woven together again. No Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rewrite = Callable[[Column], Column]


def let(value: Column, body: Rewrite) -> Column:
    """Binds ``value`` once, however often ``body`` uses it: keeps the plan linear in the stages."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _woven(gaps: Column, hits: Column) -> Column:
    blank = F.lit("")
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(F.coalesce(g, blank), F.coalesce(h, blank))), "")


def sub_hits(c: Column, pattern: str, f: Rewrite) -> Column:
    """Every hit of ``pattern`` becomes ``f(hit)``. The pattern must not match the empty string."""
    return let(c, lambda v: _woven(F.split(v, pattern, -1), F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), f)))


def sub_gaps(c: Column, pattern: str, f: Rewrite) -> Column:
    """Hits stay; what lies between becomes ``f(gap)``."""
    return let(c, lambda v: _woven(F.transform(F.split(v, pattern, -1), f), F.regexp_extract_all(v, F.lit(pattern), F.lit(0))))


def sub_between(c: Column, pattern: str, f: Callable[[Column, Column, Column], Column]) -> Column:
    """Every hit becomes ``f(hit, character before, character after)``, both from the text as it was; empty at an end."""

    def with_parts(v: Column) -> Column:
        parts = F.struct(F.split(v, pattern, -1).alias("gaps"), F.regexp_extract_all(v, F.lit(pattern), F.lit(0)).alias("hits"))

        def mapped(p: Column) -> Column:
            gaps, hits = p["gaps"], p["hits"]

            def one(h: Column, i: Column) -> Column:
                left, right = F.get(gaps, i), F.get(gaps, i + 1)
                before = F.when(left != "", F.right(left, F.lit(1))).otherwise(F.coalesce(F.right(F.get(hits, i - 1), F.lit(1)), F.lit("")))
                after = F.when(right != "", F.left(right, F.lit(1))).otherwise(F.coalesce(F.left(F.get(hits, i + 1), F.lit(1)), F.lit("")))
                return f(h, before, after)

            return _woven(gaps, F.transform(hits, one))

        return let(parts, mapped)

    return let(c, with_parts)


def guarded(c: Column, trigger: str, stage: Rewrite) -> Column:
    """Runs a costly stage only on texts that match ``trigger``; others cannot change by it."""
    return let(c, lambda v: F.when(v.rlike(trigger), stage(v)).otherwise(v))
