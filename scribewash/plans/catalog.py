"""Registered queries of the transcript operators, with the SQL that each is held against.

All run over whole tables and whole texts, against SQL that is formulated independently. The tables hold no
Chinese text: for the Chinese rules, every turn gets a line in front (for the whole clean-up, at its end) with one
of the stated cases (``goldens``), dealt by the row's ids, and a line of numerals that spell a number made of the
ids; SQL puts the case's known result and the number's figures there, and for the turn's own text what it
computes itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import commands, fillers, numerals, text_ops
from ..functions import constants as C
from ..operators import alias_join, deltas
from ..sources import readers
from ..streaming.marker_filter import live_events
from . import goldens
from .pipeline import CleanupOptions, clean, finalize

Query = Callable[[SparkSession, str], DataFrame]
ECHO_PROMPT = "Than in of the and. It was that thing, erst with the heat of an eron"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")


def _decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with engine marks, keyed on the ids (DECORATED in SQL)."""
    k = F.col("conv_id") % 4
    mark = F.when(k == 0, "language English<asr_text>").when(k == 1, "  Language Chinese (x)<asr_text>").when(k == 2, "so language en<asr_text>").otherwise("")
    noise = F.when(F.col("turn") % 2 == 0, "/sil").otherwise("")
    t = F.col("turn") % 5
    end = F.when(t == 0, "。").when(t == 1, "!?”").when(t == 2, "...)").when(t == 3, "\n.").otherwise(" a")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.concat(mark, noise, "text", end).alias("raw"))


DECORATED = """
decorated AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn,
  CASE conv_id % 4 WHEN 0 THEN 'language English<asr_text>' WHEN 1 THEN '  Language Chinese (x)<asr_text>'
    WHEN 2 THEN 'so language en<asr_text>' ELSE '' END
  || CASE WHEN turn % 2 = 0 THEN '/sil' ELSE '' END || text
  || CASE turn % 5 WHEN 0 THEN '。' WHEN 1 THEN '!?”' WHEN 2 THEN '...)' WHEN 3 THEN chr(10) || '.' ELSE ' a' END AS raw
  FROM conversations)"""


def _over_turns(name: str, f: Callable[[Column], Column], out: str = "text") -> tuple[str, Query]:
    return name, lambda s, d: _decorated(s, d).select("conv_id", "turn", f(F.col("raw")).alias(out))


def _over_documents(name: str, f: Callable[[Column], Column]) -> tuple[str, Query]:
    return name, lambda s, d: dealt_out(_table(s, d, "documents").select("doc_id", "text")).select("doc_id", f(F.col("text")).alias("text"))


def _case_number(n: int) -> Column:
    return ((F.col("conv_id") * 8 + F.col("turn")) % n).cast("int") + 1


def _dealt(values: list[str]) -> Column:
    """One of the values for each turn (DEALT in SQL)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), _case_number(len(values)))


def _dealt_sql(values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST((conv_id * 8 + turn) % {len(values)} AS INTEGER) + 1)"


def _known(cases: list[tuple[str, str | None]]) -> tuple[list[str], list[str]]:
    return [a for a, _ in cases], [a if b is None else b for a, b in cases]


def _number() -> Column:
    """A number from 20 to 9,999 made of a turn's ids (NUMBER in SQL); two figures beside each other are common."""
    return (F.col("conv_id") * 397 + F.col("turn") * 83) % 9980 + 20


NUMBER = "((conv_id * 397 + turn * 83) % 9980 + 20)"


def _spelled(n: Column) -> Column:
    """A number below 10,000 in Chinese, with place values: the places that have a figure, one 零 for a gap between."""
    figures = "零一二三四五六七八九"
    figure = lambda k: F.floor(n / 10**k) % 10
    parts = [F.when(figure(k) > 0, F.concat(F.substring(F.lit(figures), figure(k).cast("int") + 1, F.lit(1)), F.lit(unit))).otherwise("零") for k, unit in ((3, "千"), (2, "百"), (1, "十"), (0, ""))]
    return F.regexp_replace(F.regexp_replace(F.concat(*parts), "零+", "零"), "^零|零$", "")


def _in_front(f: Callable[[Column], Column], cases: list, numerals_line: str | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f`` over every turn, after a line with a case and, if any, one with a numeral in ``numerals_line`` (%s)."""
    lines = [_dealt(_known(cases)[0])]
    if numerals_line:
        before, _, after = numerals_line.partition("%s")
        lines.append(F.concat(F.lit(before), _spelled(_number()), F.lit(after)))
    raw = F.concat_ws("\n", *lines, "text")
    return _turns(spark, sf_dir).select("conv_id", "turn", f(raw).alias("text"))


def _numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", numerals.to_digits(_spelled(_number())).alias("text"))


def _at_the_end(options: CleanupOptions, cases: list, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clean-up of every turn, with a line that holds a case at its end; the prompt itself in every third row if there is one."""
    raw = F.concat_ws("\n", "text", _dealt(_known(cases)[0]))
    if options.prompt:
        raw = F.when(F.col("conv_id") % 3 == 0, options.prompt).otherwise(raw)
    return finalize(_turns(spark, sf_dir).select("conv_id", "turn", raw.alias("raw")), "raw", "text", options).select("conv_id", "turn", "text")


def _finals(name: str) -> tuple[CleanupOptions, list[tuple[str, str | None]]]:
    """Options, and the cases that may stand at a text's end: markers belong to its start, an empty result to a whole text."""
    organizer, prompt, strip, cases = goldens.FINALIZE[name]
    return CleanupOptions(organizer=organizer, prompt=prompt, strip_trailing_punct=strip), [c for c in cases if c[1] != "" and "<asr_text>" not in c[0] and c[0] != goldens.PROMPT]


def _rewrites() -> dict[str, Callable[[Column], Column]]:
    p = commands.load_profiles()
    org = {"org model": {"forms": ["ORG model", "o r g model", "og model"], "fuzzy": False}}
    return {
        "clause_connectors": lambda c: fillers.starts_with_connector(c).cast("string"),
        "to_digits": numerals.to_digits,
        "ascii_phrases": lambda c: commands.ascii_phrases(c, org),
        "strong_stutter": fillers.strong_stutter,
        "stutter": fillers.collapse_stutter,
        "phrase_fillers": fillers.phrase_fillers,
        "deictic_run": fillers.deictic_run,
        "deictic_single": fillers.deictic_single,
        "interjection_clusters": fillers.interjection_clusters,
        "topic_tail": fillers.topic_tail,
        "filter_fillers": fillers.filter_fillers,
        "acronym_digits": numerals.acronym_digits,
        "clock_times": numerals.clock_times,
        "percent": numerals.percentages,
        "units": numerals.calendar_units,
        "money": numerals.money,
        "composite_numbers": numerals.composite_numbers,
        "normalize_digits": numerals.normalize_chinese_digits,
        "spelled_letters": commands.join_spelled_letters,
        "cjk_ascii_spacing": lambda c: commands.ascii_tokens(c, p),
        "cjk_aliases": lambda c: commands.cjk_aliases(c, p),
        "normalize_commands": lambda c: commands.normalize_commands(c, p),
    }


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))
    return words.distinct()


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("token", commands.edit_distance(F.lower("token"), F.lit("clear")).cast("long").alias("distance"))


def fuzzy_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("token", commands.canonical_token(F.col("token"), commands.load_profiles()).alias("canon"))


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    return alias_join.lookup_tokens(words, alias_join.alias_table(words, commands.load_profiles(extra_json='{"thing": ["then"], "heat": ["the"]}')))


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = commands.load_profiles('{"clear": {"forms": ["kler", "clear", " "], "fuzzy": false}}', '{"clear": ["klear"], "go": ["gow"]}')
    rows = [(k, ",".join(v["forms"]), v["fuzzy"]) for k, v in profiles.items()]
    return spark.createDataFrame(rows, "canon string, forms string, fuzzy boolean")


def common_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", text_ops.longest_common_run(F.col("text"), F.lit(ECHO_PROMPT)).cast("long").alias("run"))


def prompt_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn after a part of the prompt; in every third conversation, the part and the turn's number alone."""
    k, part = F.col("conv_id") % 3, F.lit(ECHO_PROMPT[8:40])
    text = F.when(k == 0, F.concat(part, F.repeat(F.lit("w"), F.col("turn").cast("int") * 8))).when(k == 1, F.concat(part, "text")).otherwise(F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", text_ops.is_prompt_echo(text, ECHO_PROMPT).alias("echo"))


#: Characters of a delta.
DELTA_CHARS = 40


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as token deltas, counted from 0 (DELTAS in SQL)."""
    k = F.col("conv_id") % 3
    first = F.when(k == 0, "language English<asr_text>").when(k == 1, "lang").otherwise("")
    last = F.floor(F.length("text") / DELTA_CHARS).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", i * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
    parts = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(cut).alias("part", "t"))
    delta = F.concat(F.when((F.col("turn") == 0) & (F.col("part") == 0), first).otherwise(""), "t")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part")) - 1
    return parts.select(F.col("conv_id").cast("string").alias("request_id"), seq.cast("long").alias("seq"), delta.alias("delta"))


DELTAS = f"""
parts AS (SELECT conv_id, turn, text, unnest(range(0, length(text) // {DELTA_CHARS} + 1)) AS part FROM conversations),
deltas AS (SELECT CAST(conv_id AS VARCHAR) AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS seq,
  CASE WHEN turn = 0 AND part = 0 THEN CASE conv_id % 3 WHEN 0 THEN 'language English<asr_text>' WHEN 1 THEN 'lang' ELSE '' END ELSE '' END
  || substr(text, part * {DELTA_CHARS} + 1, {DELTA_CHARS}) AS delta FROM parts)"""

VISIBLE = (
    DELTAS
    + """,
grown AS (SELECT *, string_agg(delta, '') OVER (PARTITION BY request_id ORDER BY seq) AS c FROM deltas),
opened AS (SELECT request_id, min(seq) AS d FROM grown WHERE contains(lower(c), '<asr_text>') OR length(c) >= 64 GROUP BY 1),
last AS (SELECT request_id, max(seq) AS top, arg_max(c, seq) AS c FROM grown GROUP BY 1),
visible AS (
  SELECT g.request_id, g.seq, CASE WHEN g.seq > o.d THEN g.delta
    WHEN contains(lower(g.c), '<asr_text>') THEN substr(g.c, instr(lower(g.c), '<asr_text>') + 10) ELSE g.c END AS text
  FROM grown g JOIN opened o USING (request_id) WHERE g.seq >= o.d
  UNION ALL SELECT l.request_id, l.top + 1, l.c FROM last l LEFT JOIN opened o USING (request_id) WHERE o.d IS NULL)"""
)


def _sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent lines with junk, keyed on the ids (SSE in SQL)."""
    rows = _deltas(spark, sf_dir)
    k = F.col("seq") % 50
    content = F.to_json(F.struct(F.col("delta").alias("content")))
    line = (
        F.when(k == 45, "data: [DONE]").when(k == 2, "data: {broken").when(k == 3, 'data: {"choices":[{"delta":{"content":5}}]}').when(k == 4, "data:")
        .otherwise(F.concat(F.lit('  data: {"choices":[{"index":0,"delta":'), content, F.lit("}]} ")))
    )
    return rows.select("request_id", "seq", line.alias("line"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ['{"text": "ok"}', '{"text": 5}', '{"other": "x"}', "[1]", "broken", '{"text": ""}']
    return readers.parse_replies(spark.createDataFrame(list(enumerate(kinds)), "case_id long, reply string")).select("case_id", "raw", F.col("status").cast("long").alias("status"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b'--b\r\nContent-Disposition: form-data; name="%s"%s\r\n\r\nRIFFfake\r\n--b--\r\n'
    kind = "multipart/form-data; boundary=b"
    rows = [(0, kind, part % (b"file", b'; filename="a.wav"')), (1, kind, part % (b"file", b"")), (2, kind, part % (b"other", b"")), (3, "text/plain", b"x")]
    found = readers.decode_uploads(spark.createDataFrame(rows, "case_id long, content_type string, body binary"))
    return found.select("case_id", "filename", F.length("content").cast("long").alias("n_bytes"), F.col("status").cast("long").alias("status"))


def finalize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalize(_decorated(spark, sf_dir), "raw", "text").select("conv_id", "turn", "text")


def dealt_out(df: DataFrame) -> DataFrame:
    """For tables of few files, such as the one file of each table here: as many partitions as there are cores.

    Whether it is done hangs on the number of files alone; a table of many files is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 8) else df


def finalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalize(dealt_out(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw")))).select("doc_id", "text")


def stream_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.final_texts(_deltas(spark, sf_dir)).select("request_id", "text")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.stream_events(_deltas(spark, sf_dir))


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("request_id")).distinct()
    return ids.where("CAST(request_id AS BIGINT) % 7 = 0").select("request_id", F.lit("engine failed").alias("message"))


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = deltas.stream_events(_deltas(spark, sf_dir), None, _failed(spark, sf_dir))
    return deltas.sse_encode(events.where("type IN ('error', 'done')")).select("request_id", "type", "line")


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder in the cluster's shared one; a folder of our own on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or 'file://' + tempfile.mkdtemp(prefix='scribewash-')}/{name}-{uuid.uuid4().hex}"


def live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of ``stream_events`` with the failures of ``stream_errors``, through the live filter: the rows of
    every request come in three micro-batches, dealt by a hash, so out of order, and some of them twice."""
    rows = _deltas(spark, sf_dir).select("*", F.lit(False).alias("is_end"), F.lit(None).cast("string").alias("error"))
    ends = rows.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).join(_failed(spark, sf_dir), "request_id", "left")
    rows = rows.unionByName(ends.select("request_id", "seq", F.lit("").alias("delta"), F.col("message").isNull().alias("is_end"), F.col("message").alias("error")))
    times = F.when(F.pmod(F.xxhash64("seq", "request_id"), F.lit(5)) == 0, 2).otherwise(1)
    source, sink = _scratch(spark, "live-in"), _scratch(spark, "live-out")
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).withColumn("batch", F.pmod(F.xxhash64("request_id", "seq", "copy"), F.lit(3)))
    for k in range(3):  # files are read in the order of their times
        dealt.where(F.col("batch") == k).drop("copy", "batch").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = live_events(stream, timeout_ms=None).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.parquet(sink)


def cleanup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean-up with each stage switched off in turn: (stage, conv_id, turn, text)."""
    off = {"fillers": {"organizer": "none"}, "numerals": {"numerals": False}, "commands": {"commands": False}, "ending": {"strip_trailing_punct": False}}
    out = [finalize(_decorated(spark, sf_dir), "raw", "text", CleanupOptions(**o)).select(F.lit(k).alias("stage"), "conv_id", "turn", "text") for k, o in off.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw text beside the clean one, with the counters of the whole run: (conv_id, turn, raw, text, n_rows, n_silent)."""
    counted = Observation("audit")
    texts = clean(_decorated(spark, sf_dir).withColumn("raw", F.when(F.col("turn") % 4 == 3, "。！").otherwise(F.col("raw"))), "raw", "text", CleanupOptions(log_raw=True), counted)
    path = _scratch(spark, "audit")
    texts.write.parquet(path)
    n = counted.get
    return spark.read.parquet(path).select("conv_id", "turn", "raw", "text", F.lit(n["rows"]).cast("long").alias("n_rows"), F.lit(n["silent"]).cast("long").alias("n_silent"))


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of an engine call for every turn, its text's bytes standing for the audio, and the prompt."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.col("text").cast("binary").alias("content"))
    return readers.chat_request(rows, "asr", 'say "x"').select("conv_id", "turn", "payload")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = dict(
        [
            _over_turns("strip_markers", text_ops.strip_markers),
            _over_turns("strip_sil", text_ops.strip_sil),
            _over_turns("spoken_gate", lambda c: text_ops.has_spoken_content(F.regexp_replace(c, "[a-fA-F]", "")), "spoken"),
            _over_turns("strip_trailing_punct", text_ops.strip_trailing_punctuation),
            _over_documents("ascii_fillers", fillers.ascii_fillers),
            _over_documents("tidy_space", fillers.collapse_space),
            _over_documents("dup_punct", fillers.drop_duplicate_punct),
            _over_documents("punct_runs", fillers.resolve_punct_runs),
            _over_documents("tidy_lines", fillers.tidy_lines),
        ]
    )
    for f in (edit_distance, fuzzy_commands, alias_lookup, profile_table, common_run, prompt_echo, finalize_conversations, finalize_documents, stream_final, stream_events, stream_errors, live_stream, cleanup_flags, audit, chat_requests):
        found[f.__name__] = f
    found["stream_marker_filter"] = lambda s, d: deltas.marker_filter(_deltas(s, d))
    found["sse_decode"] = lambda s, d: readers.sse_decode(_sse(s, d))
    found["engine_replies"] = _replies
    found["uploads"] = _uploads
    for name, f in _rewrites().items():
        found[name] = partial(_in_front, f, goldens.OPERATORS[name], NUMERAL_LINES.get(name, (None,))[0])
    found["to_digits"] = _numerals
    for name in goldens.FINALIZE:
        found[name] = partial(_at_the_end, *_finals(name))
    return found


#: A line with a numeral, and what the operator makes of it (%s: the figures); both as they stand in a text.
NUMERAL_LINES = {
    "percent": ("涨了百分之%s。", "涨了%s%。"), "units": ("在%s年里", "在%s年里"), "money": ("付了%s块钱", "付了%s块钱"),
    "composite_numbers": ("买了%s份", "买了%s份"), "normalize_digits": ("共%s元", "共%s元"),
}


_HS, _PUNCT = r"[ \t\f\v]", C.WEAK + C.STRONG
_UNMARKED = "regexp_replace(raw, '^\\s*language\\s+[A-Za-z()\\- ]+<asr_text>', '', 'i')"


def _replace(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def _space_sql(x: str) -> str:
    x = _replace(_replace(x, f"{_HS}+", " "), f"{_HS}+([{_PUNCT}])", "\\1")
    return _replace(x, f"([{C.FULL}]){_HS}+", "\\1")


def _dup_sql(x: str) -> str:
    for ch in C.WEAK + "。":
        x = _replace(x, f"{ch}(?:{_HS}*{ch})+", ch)
    return x


def _runs_sql(x: str) -> str:
    for _ in range(3):
        x = _replace(_replace(x, f"([{C.STRONG}]){_HS}*([{C.WEAK}])", "\\1"), f"([{C.WEAK}]){_HS}*([{C.STRONG}])", "\\2")
    return x


def _lines_sql(x: str) -> str:
    blanks = "' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
    line = f"trim(trim(trim(l, {blanks}), '{C.WEAK}'), {blanks})"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {line}), lambda l: l <> ''), chr(10))"


def _fillers_sql(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in C.ASCII_FILLERS)
    return f"array_to_string(list_filter(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda t: lower(t) NOT IN ({words})), '')"


def _canon_sql(t: str, distance: str = "levenshtein(lower({t}), 'clear')") -> str:
    return (
        f"CASE WHEN lower({t}) = 'clear' THEN 'clear' WHEN length({t}) BETWEEN 3 AND 8 AND {distance.format(t=t)} <= 2 THEN 'clear' "
        f"WHEN lower({t}) IN ('claire', 'clare') THEN 'clear' ELSE {t} END"
    )


def _spelled_sql(x: str) -> str:
    """Three or more single letters in a row lose the blanks between them: words and gaps, seen with their neighbours."""
    single = lambda k: f"coalesce(regexp_matches(ts[i + {k}], '^[A-Za-z]$'), false)"
    blank = lambda k: f"coalesce(regexp_matches(ts[i + {k}], '^[ \t]+$'), false)"
    more = f"(({blank(-2)} AND {single(-3)}) OR ({blank(2)} AND {single(3)}))"
    gone = f"({blank(0)} AND {single(-1)} AND {single(1)} AND {more})"
    return f"list_transform([regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+')], lambda ts: array_to_string(list_filter(ts, lambda t, i: NOT {gone}), ''))[1]"


def _organized_sql(x: str) -> str:
    return _lines_sql(_runs_sql(_dup_sql(_space_sql(_fillers_sql(x)))))


def _tokens_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN {_canon_sql('t')} ELSE t END), '')"


def _final_sql(raw: str) -> str:
    """All but the speech gate and the ending."""
    return _tokens_sql(_spelled_sql(_organized_sql(f"replace({raw}, '/sil', '')")))


def _spoken_sql(x: str) -> str:
    return f"list_transform([{x}], lambda t: CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN t ELSE '' END)[1]"


def _whole_sql(raw: str) -> str:
    return _spoken_sql(_ended_sql(_final_sql(raw)))


def _events_sql(failed: str) -> str:
    return f"""{VISIBLE}, joined AS (SELECT request_id, string_agg(delta, '' ORDER BY seq) AS raw FROM deltas GROUP BY 1),
        live AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY seq) - 1 AS event_seq, text FROM visible WHERE text <> ''),
        counted AS (SELECT j.request_id, count(l.text) AS n, any_value({_whole_sql(_UNMARKED)}) AS text FROM joined j LEFT JOIN live l USING (request_id) GROUP BY 1)
        SELECT request_id, event_seq, 'delta' AS type, text, CAST(NULL AS VARCHAR) AS message FROM live
        UNION ALL SELECT request_id, n, 'final', text, NULL FROM counted WHERE NOT ({failed})
        UNION ALL SELECT request_id, n + 1, 'done', NULL, NULL FROM counted WHERE NOT ({failed})
        UNION ALL SELECT request_id, n, 'error', NULL, 'engine failed' FROM counted WHERE {failed}"""


def _ended_sql(x: str) -> str:
    return f"regexp_replace({x}, '[{C.TRAILING}]+([”’\"''」』）)》】〕\\]}}]*)$', '\\1')"


def oracle_sql() -> dict[str, str]:
    words = "words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents)"
    turn = lambda x, out="text": f"WITH {DECORATED} SELECT conv_id, turn, {x} AS {out} FROM decorated"
    doc = lambda x: f"SELECT doc_id, {x} AS text FROM documents"
    prompt = ECHO_PROMPT
    bare = prompt.replace(" ", "")
    n_run = f"coalesce(list_max(list_transform(range(1, {len(prompt) + 1}), lambda k: CASE WHEN len(list_filter(range(1, length(t) - k + 2), lambda i: contains('{prompt}', substr(t, i, k)))) > 0 THEN k ELSE 0 END)), 0)"
    k = "greatest(6, CAST(ceil(length(t) * 0.5) AS BIGINT))"
    found = {
        "strip_markers": turn("CASE WHEN conv_id % 4 IN (0, 1) THEN substr(raw, instr(raw, '<asr_text>') + 10) ELSE raw END"),
        "strip_sil": turn("array_to_string(string_split(raw, '/sil'), '')"),
        "spoken_gate": turn("len(list_filter(string_split(regexp_replace(raw, '[a-fA-F]', '', 'g'), ''), lambda c: regexp_matches(c, '^[\\p{L}\\p{N}]$'))) > 0", "spoken"),
        "strip_trailing_punct": turn(_ended_sql("raw")),
        "ascii_fillers": doc(_fillers_sql("text")),
        "tidy_space": doc(_space_sql("text")),
        "dup_punct": doc(_dup_sql("text")),
        "punct_runs": doc(_runs_sql("text")),
        "tidy_lines": doc(_lines_sql("text")),
        "edit_distance": f"WITH {words} SELECT token, levenshtein(lower(token), 'clear') AS distance FROM words",
        "fuzzy_commands": f"WITH {words} SELECT token, {_canon_sql('token')} AS canon FROM words",
        "alias_lookup": f"""WITH {words}, told AS (SELECT token, CASE WHEN lower(token) IN ('clear', 'thing', 'heat') THEN lower(token)
            WHEN length(token) BETWEEN 3 AND 8 AND levenshtein(lower(token), 'clear') <= 2 THEN 'clear'
            WHEN lower(token) IN ('claire', 'clare') THEN 'clear' WHEN lower(token) = 'then' THEN 'thing' WHEN lower(token) = 'the' THEN 'heat' END AS canon FROM words)
            SELECT token, canon FROM told WHERE canon IS NOT NULL""",
        "profile_table": "SELECT canon, forms, fuzzy FROM (VALUES ('clear', 'kler,klear', false), ('发送', '发松,发宋,法送,法松,发耸,发颂,发诵', false), ('go', 'gow', false)) AS t(canon, forms, fuzzy)",
        "common_run": f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST({n_run} AS BIGINT) AS run FROM (SELECT conv_id, turn, text AS t FROM conversations)",
        "prompt_echo": f"""WITH x AS (SELECT conv_id, turn, regexp_replace(CASE conv_id % 3 WHEN 0 THEN '{prompt[8:40]}' || repeat('w', turn * 8)
            WHEN 1 THEN '{prompt[8:40]}' || text ELSE text END, '\\s+', '', 'g') AS t FROM conversations)
            SELECT conv_id, CAST(turn AS BIGINT) AS turn, len(list_filter(range(1, length(t) - {k} + 2), lambda i: contains('{bare}', substr(t, i, {k})))) > 0 AS echo FROM x""",
        "finalize_conversations": f"""WITH {DECORATED}, done AS (SELECT conv_id, turn, {_final_sql(_UNMARKED)} AS t FROM decorated)
            SELECT conv_id, turn, CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN {_ended_sql('t')} ELSE '' END AS text FROM done""",
        "finalize_documents": f"""WITH done AS (SELECT doc_id, {_final_sql('text')} AS t FROM documents)
            SELECT doc_id, CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN {_ended_sql('t')} ELSE '' END AS text FROM done""",
        "stream_marker_filter": f"WITH {VISIBLE} SELECT request_id, seq, text FROM visible WHERE text <> ''",
        "stream_final": f"""WITH {DELTAS}, joined AS (SELECT request_id, string_agg(delta, '' ORDER BY seq) AS raw FROM deltas GROUP BY 1)
            SELECT request_id, {_whole_sql(_UNMARKED)} AS text FROM joined""",
        "stream_events": f"WITH {_events_sql('false')}",
        "live_stream": f"WITH {_events_sql('CAST(request_id AS BIGINT) % 7 = 0')}",
        "stream_errors": f"""WITH {DELTAS} SELECT DISTINCT request_id, CASE WHEN CAST(request_id AS BIGINT) % 7 = 0 THEN 'error' ELSE 'done' END AS type,
            CASE WHEN CAST(request_id AS BIGINT) % 7 = 0 THEN 'data: {{"type":"error","message":"engine failed"}}' ELSE 'data: {{"type":"done"}}' END || chr(10) || chr(10) AS line FROM deltas""",
        "sse_decode": f"""WITH {DELTAS} SELECT request_id, seq, delta FROM deltas WHERE seq < 45 AND seq NOT IN (2, 3, 4) AND delta <> ''""",
        "engine_replies": "SELECT CAST(case_id AS BIGINT) AS case_id, raw, CAST(status AS BIGINT) AS status FROM (VALUES (0, 'ok', 200), (1, NULL, 502), (2, NULL, 502), (3, NULL, 502), (4, NULL, 502), (5, '', 200)) AS t(case_id, raw, status)",
        "uploads": "SELECT CAST(case_id AS BIGINT) AS case_id, filename, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(status AS BIGINT) AS status FROM (VALUES (0, 'a.wav', 8, 200), (1, 'audio.wav', 8, 200), (2, NULL, NULL, 400), (3, NULL, NULL, 400)) AS t(case_id, filename, n_bytes, status)",
    }
    own = {
        "filter_fillers": _organized_sql("text"), "spelled_letters": _spelled_sql("text"), "cjk_ascii_spacing": _tokens_sql("text"),
        "normalize_commands": _tokens_sql(_spelled_sql("text")), "ascii_phrases": "text",
    }
    lined = lambda values, *rest: "array_to_string(list_filter([" + ", ".join((_dealt_sql(values), *rest)) + "], lambda x: x IS NOT NULL), chr(10))"
    for name, cases in goldens.OPERATORS.items():
        line = NUMERAL_LINES.get(name, (None, None))[1]
        more = ["replace('" + line + f"', '%s', CAST({NUMBER} AS VARCHAR))"] if line else []
        text = lined(_known(cases)[1], *more, own.get(name, "text"))
        if name == "filter_fillers":
            text = f"trim({text}, chr(10))"
        found[name] = f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, {text} AS text FROM conversations"
    found["clause_connectors"] = f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, {_dealt_sql(_known(goldens.OPERATORS['clause_connectors'])[1])} AS text FROM conversations"
    found["to_digits"] = f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST({NUMBER} AS VARCHAR) AS text FROM conversations"
    for name in goldens.FINALIZE:
        options, cases = _finals(name)
        of_text = _final_sql("text") if options.organizer == "rule" else _tokens_sql(_spelled_sql("replace(text, '/sil', '')"))
        expected = f"{of_text} || chr(10) || {_dealt_sql(_known(cases)[1])}"
        echo = "CASE WHEN conv_id % 3 = 0 THEN '' ELSE " if options.prompt else "CASE WHEN false THEN '' ELSE "
        found[name] = f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, {echo}trim({expected}, chr(10)) END AS text FROM conversations"
    flag = lambda stage, x: f"SELECT '{stage}' AS stage, conv_id, turn, {_spoken_sql(x)} AS text FROM decorated"
    quiet = f"replace({_UNMARKED}, '/sil', '')"
    found["cleanup_flags"] = f"WITH {DECORATED} " + " UNION ALL ".join([
        flag("fillers", _ended_sql(_tokens_sql(_spelled_sql(quiet)))), flag("numerals", _ended_sql(_final_sql(_UNMARKED))),
        flag("commands", _ended_sql(_organized_sql(quiet))), flag("ending", _final_sql(_UNMARKED)),
    ])
    raws = f"{DECORATED}, raws AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '。！' ELSE raw END AS raw FROM decorated)"
    found["audit"] = f"""WITH {raws}, done AS (SELECT conv_id, turn, raw, {_whole_sql(_UNMARKED)} AS text FROM raws)
        SELECT *, count(*) OVER () AS n_rows, count(*) FILTER (text = '') OVER () AS n_silent FROM done"""
    found["chat_requests"] = """SELECT conv_id, CAST(turn AS BIGINT) AS turn, '{"model":"asr","stream":true,"temperature":0.0,"messages":[{"role":"user","content":'
        || '[{"type":"text","text":"say \\"x\\""},{"type":"input_audio","input_audio":{"data":"' || base64(encode(text)) || '","format":"wav"}}]}]}' AS payload FROM conversations"""
    return found
