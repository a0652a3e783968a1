"""Chinese numerals to Arabic figures: acronyms, clock times, percentages, dates, money, composites.

A numeral that is not well formed (two figures side by side among place values, a place value first)
stays as it is. A lone figure stays Chinese unless its position says that it is a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .rewrite import guarded, let, sub_between, sub_gaps, sub_hits

_PLACES = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
_PROTECTED = f"(?:{C.WEEKDAYS}|{C.alternation(C.FUNCTION_WORDS + C.IDIOMS)})"


def _value(s: Column) -> Column:
    """Value of a numeral with place values: one pass, characters left to right; null beyond 18 figures."""
    zero = F.lit(0).cast("long")
    # greatest() would turn the null of an overflow into 1.
    at_least_one = lambda x: F.when(x < 1, F.lit(1).cast("long")).otherwise(x)
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("figure"))

    def step(a: Column, ch: Column) -> Column:
        figure = F.instr(F.lit(C.DIGITS), ch)
        unit = F.coalesce(*[F.when(ch == k, F.lit(v).cast("long")) for k, v in _PLACES.items()], zero)
        held = F.try_add(a["section"], a["figure"])
        small = F.struct(
            a["total"].alias("total"),
            F.try_add(a["section"], F.try_multiply(F.greatest(a["figure"], F.lit(1).cast("long")), unit)).alias("section"),
            zero.alias("figure"),
        )
        wan = F.struct(F.try_add(a["total"], F.try_multiply(at_least_one(held), unit)).alias("total"), zero.alias("section"), zero.alias("figure"))
        whole = at_least_one(F.try_add(a["total"], held))
        yi = F.struct(F.try_multiply(whole, unit).alias("total"), zero.alias("section"), zero.alias("figure"))
        read = F.translate(ch, C.DIGITS, C.DIGIT_VALUES).cast("long")
        plain = F.struct(a["total"].alias("total"), a["section"].alias("section"), F.when(figure > 0, read).otherwise(zero).alias("figure"))
        return F.when(ch == "亿", yi).when(ch == "万", wan).when(unit > 0, small).otherwise(plain)

    return F.aggregate(F.split(s, ""), start, step, lambda a: F.try_add(F.try_add(a["total"], a["section"]), a["figure"]))


def to_digits(c: Column) -> Column:
    """A numeral as figures; place values alone have their value; the rest stays."""

    def told(s: Column) -> Column:
        positional = F.regexp_replace(F.translate(s, C.DIGITS, C.DIGIT_VALUES), "^0+(?=[0-9])", "")
        odd = s.rlike("[一二两三四五六七八九]{2}") | ~s.rlike(f"\\A[{C.NUMERAL}]+\\z")
        return F.when(s.rlike(f"\\A[{C.DIGITS}]+\\z"), positional).when(odd, s).otherwise(F.coalesce(_value(s).cast("string"), s))

    return let(c, told)


def _composite(c: Column) -> Column:
    """As ``to_digits``, but what starts with a place value other than 十 is a word (万一, 千万)."""
    return let(c, lambda s: F.when(s.rlike(r"\A[百千万亿]"), s).otherwise(to_digits(s)))


def acronym_digits(c: Column) -> Column:
    """M P 四 is MP4: letters joined, the figure read; at least two letters."""
    pattern = f"(?:[A-Za-z](?:[{C.BLANK}]+[A-Za-z])+|[A-Za-z]+)[{C.BLANK}]*[{C.ACRONYM_NUMERAL}](?![{C.NUMERAL}])"

    def read(h: Column) -> Column:
        letters = F.regexp_replace(h, f"[{C.BLANK}{C.ACRONYM_NUMERAL}]+", "")
        return F.when(F.length(letters) < 2, h).otherwise(F.concat(letters, to_digits(F.right(h, F.lit(1)))))

    return guarded(c, pattern, lambda v: sub_hits(v, pattern, read))


def clock_times(c: Column) -> Column:
    """Hours and minutes (三点五十), half hours, and decimals (一点八)."""
    n = f"[{C.CLOCK_NUMERAL}]{{1,3}}"
    pattern = f"{n}点(?:半|{n}分?)?"

    def read(h: Column, before: Column, _: Column) -> Column:
        hour, tail = F.substring_index(h, "点", 1), F.regexp_replace(h, f"\\A{n}点", "")
        figure = to_digits(hour)
        score = F.endswith(tail, F.lit("分"))
        minutes = F.regexp_replace(tail, "分", "")
        led = F.startswith(minutes, F.lit("零"))
        clock = F.contains(minutes, F.lit("十")) | (score & (led | (F.length(minutes) >= 2)))
        read_ = to_digits(minutes)
        suffix = F.when(score, "分").otherwise("")
        fraction = F.when(led & (F.length(read_) < F.length(minutes)), F.lpad(read_, F.length(minutes), F.lit("0"))).otherwise(read_)
        padded = F.when(led & (F.length(read_) < 2), F.concat(F.lit("0"), read_)).otherwise(read_)
        bare = (hour != "一") | (before == "") | F.contains(F.lit(C.CLOCK_CONTEXT), before)
        return (
            F.when(tail == "", F.when(bare, F.concat(figure, F.lit("点"))).otherwise(h))
            .when(tail == "半", F.concat(figure, F.lit("点半")))
            .when(clock, F.concat(figure, F.lit("点"), padded, suffix))
            .otherwise(F.concat(figure, F.lit("."), fraction, suffix))
        )

    return guarded(c, pattern, lambda v: sub_between(v, pattern, read))


def percentages(c: Column) -> Column:
    x = f"[{C.NUMERAL}]+"
    span = f"百分之{x}[到至]百分之{x}"

    def ranged(h: Column) -> Column:
        first, second = F.regexp_extract(h, f"\\A百分之({x})([到至])百分之({x})\\z", 1), F.regexp_extract(h, f"\\A百分之({x})([到至])百分之({x})\\z", 3)
        return F.concat(to_digits(first), F.lit("%"), F.regexp_extract(h, "([到至])", 1), to_digits(second), F.lit("%"))

    single = lambda h: F.concat(to_digits(F.substring(h, 4, 1 << 30)), F.lit("%"))
    return guarded(c, "百分之", lambda v: sub_hits(sub_hits(v, span, ranged), f"百分之{x}", single))


def _before(c: Column, unit: str, least: str = "+") -> Column:
    pattern = f"[{C.NUMERAL}]{least}(?={unit})"
    return guarded(c, pattern, lambda v: sub_hits(v, pattern, to_digits))


def calendar_units(c: Column) -> Column:
    return _before(_before(_before(c, "年"), "月"), "[日号]")


def money(c: Column) -> Column:
    """Any numeral before explicit money; before a bare 块 only one of two characters or more."""
    return _before(_before(c, "(?:块钱|元|角|毛)"), "块", "{2,}")


def composite_numbers(c: Column) -> Column:
    """Other numerals of two characters or more, outside weekdays and fixed words."""
    pattern = f"[{C.NUMERAL}]{{2,}}|(?<=点)[{C.SINGLE_NUMERAL}]|[{C.SINGLE_NUMERAL}](?=[点%])"
    return guarded(c, f"[{C.NUMERAL}]", lambda v: sub_gaps(v, _PROTECTED, lambda g: sub_hits(g, pattern, _composite)))


def drop_reserved(c: Column) -> Column:
    """Two private-use characters are reserved and removed."""
    return F.regexp_replace(c, r"[\ue000\ue001]", "")


#: The numeral stage, in order.
STAGES = (acronym_digits, clock_times, percentages, calendar_units, money, composite_numbers, drop_reserved)


def normalize_chinese_digits(c: Column) -> Column:
    """The whole numeral stage; order matters."""
    for stage in STAGES:
        c = stage(c)
    return c
