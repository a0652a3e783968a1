"""Voice commands: observed spellings back to the command, by a dictionary and an edit distance."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from itertools import combinations
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .rewrite import Rewrite, guarded, sub_between, sub_hits

Profiles = dict[str, dict[str, Any]]
_CJK = re.compile("[㐀-䶿一-鿿]")


def _is_ascii(word: str) -> bool:
    return bool(word) and not _CJK.search(word)


def _entry(canon: str, value: Any) -> dict[str, Any] | None:
    """A value of the dictionary file: a list of spellings, or {forms, fuzzy}; others are skipped."""
    fuzzy = canon in C.FUZZY_BY_DEFAULT
    if isinstance(value, Mapping):
        forms = value.get("forms") or []
        fuzzy = value["fuzzy"] if isinstance(value.get("fuzzy"), bool) else fuzzy
    else:
        forms = value
    if not isinstance(forms, list):
        return None
    return {"forms": [x for x in forms if isinstance(x, str)], "fuzzy": fuzzy}


def load_profiles(file_json: str | None = None, extra_json: str | None = None, base: Profiles | None = None) -> Profiles:
    """Defaults; entries of the file replace theirs; extra spellings are added. Malformed JSON counts as none."""

    def parsed(text: str | None) -> dict:
        try:
            found = json.loads(text) if text else {}
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    profiles: Profiles = {k: {"forms": list(v["forms"]), "fuzzy": v["fuzzy"]} for k, v in (C.DEFAULT_PROFILES if base is None else base).items()}
    for canon, value in parsed(file_json).items():
        if canon.strip() and (entry := _entry(canon, value)) is not None:
            profiles[canon] = entry
    for canon, forms in parsed(extra_json).items():
        if isinstance(forms, list):
            held = profiles.setdefault(canon, {"forms": [], "fuzzy": canon in C.FUZZY_BY_DEFAULT})["forms"]
            held += [x for x in dict.fromkeys(x for x in forms if isinstance(x, str)) if x not in held]
    return {k: {"forms": [x for x in v["forms"] if x.strip() and x != k], "fuzzy": v["fuzzy"]} for k, v in profiles.items()}


def read_profiles(spark: SparkSession, path: str, extra_json: str | None = None) -> Profiles:
    """As ``load_profiles``, from a file on any store that Spark reads. Read it again for each batch to refresh."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return load_profiles(rows[0][0] if rows else None, extra_json)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def join_spelled_letters(c: Column) -> Column:
    """C L E A R becomes CLEAR: three or more single letters with blanks between them."""
    pattern = r"(?<![A-Za-z])[A-Za-z](?:[ \t]+[A-Za-z](?![A-Za-z])){2,}"
    return guarded(c, pattern, lambda v: sub_hits(v, pattern, lambda h: F.regexp_replace(h, r"[ \t]+", "")))


def _padded(canon: Column, before: Column, after: Column) -> Column:
    """One blank between an ASCII word and a CJK neighbour."""
    ascii_ = canon.rlike(r"\A\p{ASCII}") & canon.rlike(r"\p{ASCII}\z")
    cjk = f"[{C.CJK}]"
    left = F.when(ascii_ & before.rlike(cjk), " ").otherwise("")
    right = F.when(ascii_ & after.rlike(cjk), " ").otherwise("")
    return F.concat(left, canon, right)


def canonical_token(token: Column, profiles: Profiles) -> Column:
    """The command that an ASCII word stands for: itself in any case, a near spelling, a listed one; else the word."""
    low = F.lower(token)
    words = [k for k in profiles if _is_ascii(k) and " " not in k]
    known = F.when(low == "clear", F.lit("clear"))
    for canon in words:
        known = known.when(low == canon.lower(), F.lit(canon))
    least, most = C.FUZZY_LENGTHS
    for canon in words:
        if profiles[canon]["fuzzy"]:
            near = F.levenshtein(low, F.lit(canon.lower()), C.FUZZY_DISTANCE).between(0, C.FUZZY_DISTANCE)
            known = known.when(F.length(low).between(least, most) & near, F.lit(canon))
    for canon, profile in profiles.items():
        forms = sorted({x.lower() for x in profile["forms"]})
        if forms:
            known = known.when(low.isin(forms), F.lit(canon))
    return known.otherwise(token)


def _branches(words: set[tuple[str, ...]]) -> str:
    """Matches the letters of any of the words, in order, others between them; common beginnings once."""
    by: dict[str, set[tuple[str, ...]]] = {}
    for w in words:
        if not w:
            return ""
        by.setdefault(w[0], set()).add(w[1:])
    parts = []
    for first, rest in sorted(by.items()):
        more = _branches(rest)
        parts.append(C.quote(first) + (f"[A-Za-z]*?{more}" if more else ""))
    return f"(?:{'|'.join(parts)})"


def _near_pattern(canon: str) -> str:
    """Whole words that may be within FUZZY_DISTANCE edits of a command, by length.

    A word of m letters within d edits of a command of n keeps max(m, n) - d of its letters in order.
    """
    least, most = C.FUZZY_LENGTHS
    n, d = len(canon), C.FUZZY_DISTANCE
    by_kept: dict[int, list[int]] = {}
    for m in range(max(least, n - d), min(most, n + d) + 1):
        by_kept.setdefault(max(m, n) - d, []).append(m)
    parts = []
    for kept, sizes in by_kept.items():
        rests = _branches(set(combinations(canon, max(kept, 0))))
        parts.append(f"(?=[A-Za-z]{{{sizes[0]},{sizes[-1]}}}(?![A-Za-z]))[A-Za-z]*?{rests}[A-Za-z]*+")
    return "|".join(parts)


def _token_pattern(profiles: Profiles) -> str:
    """Whole ASCII words that may change: next to a CJK character, or possibly a spelling of a command."""
    known = {w for k, v in profiles.items() for w in (k, *v["forms"]) if re.fullmatch("[A-Za-z]+", w)} | {"clear"}
    near = [p for k, v in profiles.items() if v["fuzzy"] and _is_ascii(k) and " " not in k and (p := _near_pattern(k))]
    words = "|".join([*near, C.alternation(sorted(known))])
    return f"(?iu)(?<![A-Za-z])(?:(?<=[{C.CJK}])[A-Za-z]++|[A-Za-z]++(?=[{C.CJK}])|(?:{words})(?![A-Za-z]))"


def ascii_tokens(c: Column, profiles: Profiles) -> Column:
    pattern = _token_pattern(profiles)
    return guarded(c, pattern, lambda v: sub_between(v, pattern, lambda h, a, b: _padded(canonical_token(h, profiles), a, b)))


def _alias_pattern(alias: str) -> str:
    parts = alias.split()
    core = r"[ \t]*".join(map(C.quote, parts))
    left = "(?<![A-Za-z0-9])" if parts[0][0].isalnum() else ""
    right = "(?![A-Za-z0-9])" if parts[-1][-1].isalnum() else ""
    return f"(?iu){left}{core}{right}"


def _rewriter(pattern: str, canon: str) -> Rewrite:
    return lambda c: guarded(c, pattern, lambda v: sub_between(v, pattern, lambda h, a, b: _padded(F.lit(canon), a, b)))


def ascii_phrase_stages(profiles: Profiles) -> list[Rewrite]:
    """One for each spelling without CJK characters, in the profiles' order."""
    return [_rewriter(_alias_pattern(x), k) for k, v in profiles.items() for x in v["forms"] if _is_ascii(x)]


def cjk_alias_stages(profiles: Profiles) -> list[Rewrite]:
    """One for each command, its spellings longest first."""
    found = {k: [x for x in v["forms"] if not _is_ascii(x)] for k, v in profiles.items()}
    return [_rewriter(f"(?iu){C.alternation(forms)}", k) for k, forms in found.items() if forms]


def ascii_phrases(c: Column, profiles: Profiles) -> Column:
    return _all(c, ascii_phrase_stages(profiles))


def cjk_aliases(c: Column, profiles: Profiles) -> Column:
    return _all(c, cjk_alias_stages(profiles))


def _all(c: Column, stages: list[Rewrite]) -> Column:
    for stage in stages:
        c = stage(c)
    return c


def stages(profiles: Profiles) -> list[Rewrite]:
    """The command stage, in order."""
    return [join_spelled_letters, lambda c: ascii_tokens(c, profiles), *ascii_phrase_stages(profiles), *cjk_alias_stages(profiles)]


def normalize_commands(c: Column, profiles: Profiles | None = None) -> Column:
    return _all(c, stages(load_profiles() if profiles is None else profiles))
