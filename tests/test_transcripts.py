"""Stated cases of the clean-up, dialect traps, plan shape, profiles, readers."""

import random

import pytest
from pyspark.sql import functions as F

from scribewash.functions import commands, fillers, numerals, text_ops
from scribewash.operators import alias_join, deltas
from scribewash.plans import catalog, goldens
from scribewash.plans.pipeline import CleanupOptions, clean, finalize
from scribewash.sources import readers


def apply(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize("name", sorted(goldens.OPERATORS))
def test_operator_cases(spark, name):
    raw, known = catalog._known(goldens.OPERATORS[name])
    assert apply(spark, catalog._rewrites()[name], *raw) == known


@pytest.mark.parametrize("name", sorted(goldens.FINALIZE))
def test_pipeline_cases(spark, name):
    organizer, prompt, strip, cases = goldens.FINALIZE[name]
    raw, known = catalog._known(cases)
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    options = CleanupOptions(organizer=organizer, prompt=prompt, strip_trailing_punct=strip)
    assert [r.text for r in finalize(df, "raw", "text", options).orderBy("i").collect()] == known


def test_markers_only_at_the_start(spark):
    got = apply(spark, text_ops.strip_markers, "language English<asr_text>Hi", "LANGUAGE zh<ASR_TEXT>x", "a language b<asr_text>c", "<asr_text>c", None)
    assert got == ["Hi", "x", "a language b<asr_text>c", "<asr_text>c", None]


def test_unicode_blanks_count_as_blanks(spark):
    assert apply(spark, text_ops.strip_markers, "  language  X<asr_text>y") == ["y"]
    assert apply(spark, text_ops.strip_blanks, " a　\x1c") == ["a"]


def test_spoken(spark):
    assert apply(spark, text_ops.has_spoken_content, "。！", "a", "七", "", None, "²") == [False, True, True, False, False, True]


def test_trailing_punctuation_needs_the_very_end(spark):
    got = apply(spark, text_ops.strip_trailing_punctuation, "好。 ", "好。\n", "（好！）", "……", "a.b")
    assert got == ["好。 ", "好。\n", "（好）", "", "a.b"]


def test_echo(spark):
    p = goldens.PROMPT
    got = apply(spark, lambda c: text_ops.is_prompt_echo(c, p), p, p[:6], p[:5], "甲乙丙丁戊己庚" + p[:6], "", None, p[:8] + " \n" + p[8:20])
    assert got == [True, True, False, False, False, False, True]


def test_common_run(spark):
    assert apply(spark, lambda c: text_ops.longest_common_run(c, F.lit("xabcdez")), "abcd", "zz", "", "qabxcdew") == [4, 1, 0, 3]


def test_vertical_tab_is_no_line_break(spark):
    assert apply(spark, fillers.collapse_space, "a\x0b\x0bb\nc") == ["a b\nc"]
    assert apply(spark, fillers.tidy, "，a，\n\n  \n，\nb ,") == ["a\nb"]


def test_quirks_of_punctuation(spark):
    assert apply(spark, fillers.tidy, "std::x", "e.g., x", "what??", "wait...") == ["std:x", "e.g. x", "what??", "wait..."]


def test_to_digits(spark):
    got = apply(spark, numerals.to_digits, "十", "三十五", "二千五百", "一百零五", "三万二千", "二〇二五", "百", "一亿二千万", "二五百", "零五")
    assert got == ["10", "35", "2500", "105", "32000", "2025", "100", "120000000", "二五百", "5"]


def test_huge_numerals_do_not_fail(spark):
    assert apply(spark, numerals.to_digits, "九亿亿亿亿") == ["九亿亿亿亿"]


def test_profiles():
    p = commands.load_profiles('{"clear": {"forms": ["kler", 5, "clear", " "], "fuzzy": false}, "x": 3}', '{"clear": ["klear"], "go": ["gow"], "y": 1}')
    assert p["clear"] == {"forms": ["kler", "klear"], "fuzzy": False}
    assert p["go"]["forms"] == ["gow"] and "x" not in p and "y" not in p and "发送" in p
    assert commands.load_profiles("{broken")["clear"]["fuzzy"]


def test_profiles_from_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"go": ["gow now"]}', encoding="utf-8")
    p = commands.read_profiles(spark, str(tmp_path / "a.json"))
    assert apply(spark, lambda c: commands.normalize_commands(c, p), "he said GOW  now", "clean it") == ["he said go", "clear it"]


def test_near_spellings_and_their_switch(spark):
    exact = {"clear": {"forms": [], "fuzzy": False}}
    words = ["year", "clea", "celar", "clearance", "Clear", "er"]
    assert apply(spark, commands.normalize_commands, *words) == ["clear", "clear", "clear", "clearance", "clear", "er"]
    assert apply(spark, lambda c: commands.normalize_commands(c, exact), *words) == ["year", "clea", "celar", "clearance", "clear", "er"]


def test_candidates_are_complete(spark):
    """The pattern that picks words for the distance leaves none out."""
    import itertools

    words = ["".join(w) for n in (2, 3, 4) for w in itertools.product("clearx", repeat=n)]
    rng = random.Random(1)
    for _ in range(4000):  # longer ones, by edits
        w = list("clear")
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e", "C"])
        words.append("".join(w) or "x")
    df = spark.createDataFrame([(w,) for w in words], "w string")
    p = commands.load_profiles()
    bad = df.where(commands.canonical_token(F.col("w"), p) != commands.ascii_tokens(F.col("w"), p))
    assert bad.count() == 0


def test_alias_join_agrees_with_expression(spark):
    p = commands.load_profiles()
    df = spark.createDataFrame([(w,) for w in ("claer", "Claire", "clear", "tree", "learn", "year", "")], "token string")
    joined = {r.token: r.canon for r in alias_join.lookup_tokens(df, alias_join.alias_table(df, p)).collect()}
    told = {r[0]: r[1] for r in df.select("token", commands.canonical_token(F.col("token"), p)).collect()}
    assert joined == {k: v for k, v in told.items() if v != k or k == "clear"}


def test_overlay(spark):
    schema = "canon string, forms array<string>, fuzzy boolean"
    base = spark.createDataFrame([("a", ["x"], True), ("b", ["y"], False)], schema)
    over = spark.createDataFrame([("b", ["z", "b", " "], True)], schema)
    assert {(r.canon, tuple(r.forms), r.fuzzy) for r in alias_join.profile_overlay(base, over).collect()} == {("a", ("x",), True), ("b", ("z",), True)}


def test_clean_is_one_projection(spark):
    df = spark.createDataFrame([("嗯，好",), (None,)], "raw string")
    out = clean(df, options=CleanupOptions(log_raw=True))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert [tuple(r) for r in out.collect()] == [("嗯，好", "好"), (None, "")]
    with pytest.raises(ValueError):
        CleanupOptions(organizer="llm")


def test_clean_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "谢谢！", "t")], "id int, raw string, extra string")
    assert clean(df).columns == ["id", "extra", "text"]


def test_finalize_of_no_rows(spark):
    assert finalize(spark.createDataFrame([], "raw string")).count() == 0


def _deltas(spark, rows):
    return spark.createDataFrame(rows, "request_id string, seq long, delta string")


def test_marker_filter_and_final(spark):
    parts = ["language", " Chinese", "<asr_text>", "嗯，", "第一点买牛奶", "。"]
    rows = _deltas(spark, [("a", i, p) for i, p in enumerate(parts)] + [("b", 0, "没有"), ("b", 1, "标记")])
    got = deltas.marker_filter(rows).orderBy("request_id", "seq").collect()
    assert "".join(r.text for r in got if r.request_id == "a") == "嗯，第一点买牛奶。"
    assert [(r.seq, r.text) for r in got if r.request_id == "b"] == [(2, "没有标记")]
    final = {r.request_id: r.text for r in deltas.final_texts(rows).collect()}
    assert final == {"a": "第一点买牛奶", "b": "没有标记"}


@pytest.mark.parametrize("n", [63, 64, 65])
def test_hold_limit(spark, n):
    got = deltas.marker_filter(_deltas(spark, [("a", 0, "x" * n), ("a", 1, "y"), ("a", 2, None)])).orderBy("seq").collect()
    assert [r.text for r in got] == (["x" * 63 + "y"] if n == 63 else ["x" * n, "y"])


def test_sse(spark):
    ok = 'data: {"choices":[{"delta":{"content":"%s"}}]}'
    lines = [ok % "a", "", "data:", "data: {bad", ok % "", ": comment", ok % "b", "data: [DONE]", ok % "late"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "request_id string, seq long, line string")
    assert [r.delta for r in readers.sse_decode(df).orderBy("seq").collect()] == ["a", "b"]


def test_chat_request(spark):
    import json

    df = readers.chat_request(spark.createDataFrame([(bytearray(b"RIFF"),)], "content binary"), "m", "p")
    body = json.loads(df.first().payload)
    assert body["messages"][0]["content"][1]["input_audio"]["data"] == "UklGRg==" and body["messages"][0]["content"][0]["text"] == "p"


def test_engine_hook(spark):
    def engine(content, name):
        if name == "bad":
            raise RuntimeError("down")
        return "ok"

    df = spark.createDataFrame([(bytearray(b"x"), "a"), (bytearray(b"x"), "bad")], "content binary, filename string")
    assert [(r.raw, r.status, r.error) for r in readers.transcribe(df, engine).orderBy("filename").collect()] == [("ok", 200, None), (None, 502, "down")]


def test_building_the_clean_up_again_is_quick(spark):
    import time

    df = spark.createDataFrame([], "raw string")
    finalize(df)
    start = time.time()
    finalize(df)
    assert time.time() - start < 2


def test_numerals_that_other_readings_differ_on(spark):
    """Kept as they are, or read by place; a number without its last place value is read as it stands."""
    assert apply(spark, numerals.to_digits, "一百三", "两千零五", "万五", "一二百") == ["103", "2005", "10005", "一二百"]


def test_server_sent_content_must_be_a_string(spark):
    lines = ['data: {"choices":[{"delta":{"content":%s}}]}' % x for x in ('"5"', "5", "null", "{}", '""')]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "request_id string, seq long, line string")
    assert [(r.seq, r.delta) for r in readers.sse_decode(df).collect()] == [(0, "5")]


def test_audio_in_a_request_has_no_line_breaks(spark):
    import base64
    import json

    row = readers.chat_request(spark.createDataFrame([(bytes(range(256)),)], "content binary"), "m").first()
    sent = json.loads(row.payload)["messages"][0]["content"][0]["input_audio"]["data"]
    assert base64.b64decode(sent, validate=True) == bytes(range(256))
