"""Vocabularies and regular-expression fragments.

Fragments are for Java regular expressions; they spell out what a Unicode-aware ``\\s`` and a strip of
blanks mean, since Java's own classes differ. All vocabularies here are fixed values: results depend on them.
"""

from __future__ import annotations

import re as _re

# --- character classes (insides of [...]) ---
#: Blanks, line break included; without it; horizontal ones.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE_BLANK = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HSPACE = r" \t\f\x0b"
#: Characters that make up words: CJK ideographs, full-width and ASCII letters and digits.
WORD = r"㐀-䶿一-鿿Ａ-Ｚａ-ｚ０-９A-Za-z0-9"
CJK = r"㐀-䶿一-鿿"
#: Pauses; sentence enders; full-width marks after which no blank stands.
WEAK = "，,、：:"
STRONG = "。.！!？?；;"
FULL = "，。！？；：、…"
#: What an engine puts at an utterance's end, and the closers that may follow it.
TRAILING = "。．.！!？?；;，,、：:…"
CLOSERS = r"”’\"'」』）)》】〕\]}"

# --- fillers ---
PURE = "嗯呃诶"
AMBIGUOUS = "啊呀哦噢唉哎喔哟"
INTERJECTION = PURE + AMBIGUOUS
NEVER_DOUBLE = "我你您他她它这那哪的了吗呢吧嘛呀是在有就都也还又才很不没别再已被给让从向到与及或和而但因由且并则若虽之于以其所该各每此咱俺怎可"
STUTTER_GAP = r"，,、：:；;… \t\f\x0b\u3000"
#: Names in which 可可 is no stutter.
COCOA_NAMES = ("可可西里", "可可托海", "可可豆", "可可粉", "可可脂", "可可树", "可可碱", "可可油")
PHRASES = ("哎呀", "哎哟", "哎呦", "也就是说", "就是说", "怎么说呢", "怎么说")
DEICTICS = ("这个", "那个")
CONNECTORS = (
    "而且", "然后呢", "然后", "但是呢", "但是", "可是", "因为", "所以", "于是", "那么", "接着", "还有呢", "还有", "此外",
    "另外呢", "另外", "因而", "因此", "不过呢", "不过", "然而", "只是", "只要", "如果", "既然", "并且", "甚至", "就是说",
)
ASCII_FILLERS = ("um", "umm", "uuh", "uh", "uhm", "mm", "mhm", "hm", "hmm", "eh", "ah", "oh", "er")

# --- numerals ---
DIGITS = "零〇一二两三四五六七八九"
DIGIT_VALUES = "001223456789"
SINGLE_NUMERAL = DIGITS + "十"
NUMERAL = SINGLE_NUMERAL + "百千万亿"
CLOCK_NUMERAL = "零一二两三四五六七八九十"
ACRONYM_NUMERAL = "零〇二两三四五六七八九十"
#: After these, or at the start, 一点 is a time of day.
CLOCK_CONTEXT = "早上午晚傍凌晨昨今明当夜。？！，；,.!? "
WEEKDAYS = "(?:星期|礼拜|周)[一二三四五六日天]"
FUNCTION_WORDS = (
    "一点儿", "一会儿", "一下子", "一大早", "一样一样", "一共", "一切", "一直", "一起", "一样", "一般", "一些", "一定",
    "一律", "一再", "一度", "一贯", "一并", "一道", "一向", "一连", "一经", "一举", "一路", "一同", "一味", "一气", "一色",
    "一瞬", "一丝", "一早", "一点", "两样", "两可", "两难", "两全", "两面", "再三", "三思",
)
IDIOMS = (
    "不三不四", "说三道四", "丢三落四", "三心二意", "四面八方", "五颜六色", "七上八下", "乱七八糟", "七嘴八舌", "十全十美",
    "一清二楚", "二话不说", "三番五次", "五花八门", "一心一意", "一模一样", "一来二去", "三五成群", "五湖四海", "一五一十",
    "三三两两", "半斤八两", "五光十色", "三言两语", "一举两得", "三长两短", "独一无二", "三生有幸", "十有八九", "八九不离十",
    "一心二用", "三更半夜", "一石二鸟", "三顾茅庐", "九牛一毛", "八仙过海", "两面三刀", "一波三折", "一字千金", "一心一德",
    "一时半会", "一波未平一波又起", "一不做二不休", "不管三七二十一", "一半", "另一半", "一大半", "一小半", "多一半", "少一半",
)

# --- commands ---
#: Spellings of each command that are rewritten to it, and whether near spellings are, too.
DEFAULT_PROFILES = {
    "clear": {
        "forms": ["可丽儿", "可丽尔", "可利尔", "克丽尔", "克里尔", "科里尔", "克莱儿", "可莱儿", "克莱尔", "Claire", "Clare", "C L E A R"],
        "fuzzy": True,
    },
    "发送": {"forms": ["发松", "发宋", "法送", "法松", "发耸", "发颂", "发诵"], "fuzzy": False},
}
FUZZY_BY_DEFAULT = ("clear",)
FUZZY_DISTANCE, FUZZY_LENGTHS = 2, (3, 8)

# --- echo guard, stream ---
ECHO_RUN, ECHO_SHARE = 6, 0.5
STREAM_TAG, STREAM_HOLD = "<asr_text>", 64


def alternation(words: tuple[str, ...] | list[str]) -> str:
    """Longest first, quoted."""
    return "(?:" + "|".join(quote(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


def quote(word: str) -> str:
    return _re.sub(r"([\\.\[\]{}()*+?^$|&~#\-])", r"\\\1", word)
