"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, names and units become typed placeholders, other words are lower-cased
and stripped of punctuation. Windows of five template tokens are hashed and joined with those of the
benchmark. A document is reported for an item if it holds four fifths of the item's windows, or a run
of thirteen tokens in a row, and the slots agree: each value of the item stands for one value in the
document, so that a question with other numbers or names is caught, a chance template is not. Slots are
compared within one place: a pair is reported if any of its alignments (a run, a verbatim run, one offset,
offsets that differ by at most SHIFT, the whole document) passes, so that no other place can veto it.

Only windows whose hash may be in the benchmark leave the scan: they are looked up in a bit map of fixed
size, which lets too many through if the benchmark is huge, but never too few. The join then decides.

Windows with fewer than two literal words are no evidence and are not counted on either side; an item
without any other window is looked for by its exact tokens instead. An item of fewer than five tokens is
one window; documents are then searched for windows of that length, too. A capitalised word is a name
wherever it stands, at the start of a sentence, too (words all in capitals are literals), so that a token's
kind depends on nothing but itself, but for unit words: they are units only after a number.

Long texts are read part by part, with the tokens before a part as its context.

Defined results: null and empty texts have no windows and are never reported; null ids take part as rows of
a null id; repeated rows count once for an id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import byte_parts, materialise, utf8

WINDOW, SIMILARITY, RUN_TOKENS, CONSISTENCY = 5, 0.8, 13, 0.8
MIN_WORDS = 2
#: Offsets of one alignment differ from its centre by this at most: words lost or put in.
SHIFT = 4
FILTER_BITS = 24
#: Tokens that a task remembers; bytes of a text that are split at once, tokens whose windows are formed at once.
CACHE_TOKENS, PART_BYTES, PART_TOKENS = 120_000, 1 << 18, 1 << 16

# Unit words and symbols.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l dl ms s sec min h hr hrs hours hour minutes minute seconds "
    b"second days day weeks week months month years year hz khz mhz ghz b kb mb gb tb v kv w kw mw kwh j kj cal kcal "
    b"pa kpa bar psi k c f usd eur gbp dollars dollar euros euro cents cent percent meters meter metres metre "
    b"kilometers kilometres miles mile inches inch feet foot grams gram kilograms kilogram pounds pound litres liters".split()
)
_NUMBER = re.compile(rb"[+-]?[$\xc2\xa3\xe2\x82\xac]*\d[\d.,:/]*%?\Z")
_MEASURE = re.compile(rb"([+-]?\d[\d.,]*)([A-Za-z]+)\Z")
_EDGES = b"\"'()[]{}<>.,;:!?*#|&$-_/\\`~=+"
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
#: A literal that is a unit after a number.
UNIT_WORD = 4
_CODES = {NUM: b"\x00num", UNIT: b"\x00unit", NAME: b"\x00name"}


_code = xxhash.xxh64_intdigest
_PLAIN = re.compile(rb"[a-z]+[.,!?:;]?\Z")


def token_kind(token: bytes) -> tuple[int, int]:
    """(kind, code) of a token by itself."""
    if _PLAIN.match(token):
        core = token.rstrip(b".,!?:;")
        return (UNIT_WORD if core in UNITS else LITERAL), _code(core)
    core = token.strip(_EDGES) or token
    text = core.decode("utf-8", "replace")
    low = text.lower().encode()
    if _NUMBER.match(core):
        return NUM, _code(_CODES[NUM])
    if low in UNITS:
        return UNIT_WORD, _code(low)
    if (m := _MEASURE.match(core)) and m[2].lower() in UNITS:
        return UNIT, _code(_CODES[UNIT])
    if text[:1].isupper() and not (len(text) > 1 and text.isupper()):
        return NAME, _code(_CODES[NAME])
    return LITERAL, _code(low)


class Canon:
    """Turns texts into template codes; remembers a bounded number of tokens."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.codes, self.kinds = np.zeros(CACHE_TOKENS, np.uint64), np.zeros(CACHE_TOKENS, np.uint8)

    def _index(self, token: bytes) -> int:
        i = self.at[token] = len(self.at)
        if i >= len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros(len(self.codes) // 2, np.uint64)])
            self.kinds = np.concatenate([self.kinds, np.zeros(len(self.codes) - len(self.kinds), np.uint8)])
        self.kinds[i], self.codes[i] = token_kind(token)
        return i

    def __call__(self, tokens: list[bytes], starts: list[int] | np.ndarray = (0,)) -> tuple[np.ndarray, np.ndarray]:
        """(code, kind) of each token of texts that lie one after another and begin at ``starts``."""
        if len(self.at) > CACHE_TOKENS:
            self._reset()
        get, new = self.at.get, self._index
        idx = np.array([i if (i := get(t)) is not None else new(t) for t in tokens], np.int64)
        codes, kinds = self.codes[idx], self.kinds[idx]
        after = np.zeros(len(idx), bool)
        after[1:] = kinds[:-1] == NUM
        after[np.asarray(starts, np.int64)] = False
        word = kinds == UNIT_WORD
        kinds[word] = LITERAL
        codes[word & after], kinds[word & after] = _code(_CODES[UNIT]), UNIT
        return codes, kinds


def window_hashes(codes: np.ndarray, kinds: np.ndarray, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it is evidence) of every window of w tokens."""
    n = max(0, len(codes) - w + 1)
    h = np.full(n, w, np.uint64)
    words = np.zeros(n, np.uint8)
    for k in range(w):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        words += kinds[k : k + n] == LITERAL
    return h, words >= min(MIN_WORDS, w)


#: Added to the width of a window of exact tokens: it has no slots.
EXACT = 16


def _exact_hashes(tokens: list[bytes], w: int) -> np.ndarray:
    codes = np.array([_code((t.strip(_EDGES) or t).decode("utf-8", "replace").lower().encode()) for t in tokens], np.uint64)
    return window_hashes(codes, np.zeros(len(codes), np.uint8), w)[0] ^ np.uint64(0x5851F42D4C957F2D)


def item_windows(canon: Canon, tokens: list[bytes]) -> tuple[int, list[tuple[int, int, int, list[int]]]]:
    """(number of windows, (mode, position, hash, kinds) of each) of a benchmark item; mode: width, EXACT more if exact."""
    w = min(WINDOW, len(tokens))
    codes, kinds = canon(tokens)
    h, good = window_hashes(codes, kinds, w)
    if good.any():
        at = np.flatnonzero(good).tolist()
        return len(at), [(w, i, int(h[i]), kinds[i : i + w].tolist()) for i in at]
    h = _exact_hashes(tokens, w)
    return len(h), [(w + EXACT, i, x, [LITERAL] * w) for i, x in enumerate(h.tolist())]


class Part(NamedTuple):
    """Tokens of a text from number ``first`` on; the first ``known`` are context and belong to the part before."""

    row: int
    first: int
    known: int
    tokens: list[bytes]


def text_parts(row: int, body: bytes) -> Iterator[Part]:
    before, n = [], 0
    for piece in byte_parts(body, PART_BYTES):
        if own := piece.split():
            yield Part(row, n - len(before), len(before), before + own)
            n += len(own)
            before = (before + own)[-WINDOW:]


def document_windows(canon: Canon, parts: list[Part], modes: list[int], seen: np.ndarray) -> Iterator[tuple[Part, int, int, list[int]]]:
    """(part, position in it, hash, kinds) of the windows whose bit is set in ``seen``."""
    sizes = np.array([len(p.tokens) for p in parts])
    starts = np.cumsum(sizes) - sizes
    tokens = [t for p in parts for t in p.tokens]
    codes, kinds = canon(tokens, starts)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(tokens))  # tokens up to the part's end
    # A window that ends in the context was told by the part before.
    old = np.repeat(starts + np.array([p.known for p in parts]), sizes) - np.arange(len(tokens))
    number = np.repeat(np.arange(len(parts)), sizes)
    for mode in modes:
        w = mode % EXACT
        if mode > EXACT:
            h = _exact_hashes(tokens, w)
            good = np.ones(len(h), bool)
        else:
            h, good = window_hashes(codes, kinds, w)
        n = len(h)
        for i in np.flatnonzero(good & seen[h >> np.uint64(64 - FILTER_BITS)] & (left[:n] >= w) & (old[:n] < w)).tolist():
            part = parts[number[i]]
            yield part, i - int(starts[number[i]]), int(h[i]), [LITERAL] * w if mode > EXACT else kinds[i : i + w].tolist()


def _slots(tokens: list[bytes], kinds: list[int], at: int) -> list[str]:
    return [tokens[at + k].strip(_EDGES).decode("utf-8", "replace") for k, kind in enumerate(kinds) if kind != LITERAL]


_WINDOWS = "id long, n_windows int, mode int, at int, h long, slots array<string>"


def _windows(rows: DataFrame, id_col: str, text: str, passing: np.ndarray | None, modes: list[int] | None = None) -> DataFrame:
    """(id, n_windows, mode, at, h, slots) of an item's windows; with ``passing`` those of documents whose bit is set there."""
    bits = None if passing is None else np.packbits(passing).tobytes()

    def hits(canon: Canon, batch: pa.RecordBatch, seen: np.ndarray | None) -> Iterator[tuple]:
        if seen is None:
            for k, b in enumerate(batch.column(1).to_pylist()):
                if tokens := b.split():
                    n, windows = item_windows(canon, tokens)
                    for mode, at, h, kinds in windows:
                        yield k, n, mode, at, h, _slots(tokens, kinds, at)
            return
        held: list[Part] = []
        size = 0
        for k, x in enumerate(batch.column(1)):
            for part in text_parts(k, x.as_py()):
                held.append(part)
                size += len(part.tokens)
                if size >= PART_TOKENS:
                    yield from told(canon, held, seen)
                    held, size = [], 0
        if held:
            yield from told(canon, held, seen)

    def told(canon: Canon, parts: list[Part], seen: np.ndarray) -> Iterator[tuple]:
        for part, at, h, kinds in document_windows(canon, parts, modes, seen):
            yield part.row, 0, 0, part.first + at, h, _slots(part.tokens, kinds, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        seen = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = hits(canon, batch, seen)
            while rows := list(itertools.islice(found, 1 << 14)):
                cols = [[ids[r[0]] for r in rows], *([r[i] for r in rows] for i in (1, 2, 3)), [r[4] - (1 << 64) if r[4] >> 63 else r[4] for r in rows], [r[5] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "n_windows", "mode", "at", "h", "slots"])

    picked = rows.select(F.col(id_col).cast("long").alias("id"), utf8(text).alias("_b"))
    return picked.mapInArrow(run, _WINDOWS)


def benchmark_filter(bench: DataFrame) -> np.ndarray:
    """Which leading FILTER_BITS bits occur among the window hashes: a map of fixed size."""
    lead = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    # One row for each 4096 of the map: at most 4096 rows of 512 bytes reach the driver.
    parts = bench.select((lead / 4096).cast("int").alias("part"), (lead % 4096).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << FILTER_BITS, bool)
    for r in parts.groupBy("part").agg(F.collect_set("bit").alias("bits")).toLocalIterator():
        out[r.part * 4096 + np.array(r.bits)] = True
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document and item it holds: share of the windows, longest run of tokens, slot
    values, their consistency, and whether all slots are equal (kind: exact, or reparameterised)."""
    bench = materialise(_windows(benchmark, item_id, item_text, None), "bench")
    items = bench.select(F.col("id").alias("item"), "n_windows", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots")).distinct()
    modes = sorted(r.mode for r in bench.select("mode").distinct().collect())
    found = _windows(docs, doc_id, text, benchmark_filter(bench), modes).select(F.col("id").alias("doc"), "at", "h", "slots")
    hits = materialise(found.join(items, "h"), "hits")
    pair = ["doc", "item"]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in pair]
    both = same[0] & same[1]

    # No alignment holds more windows, or a longer run, than all places together: other pairs go first.
    on_line = hits.select(*pair, "item_at", (F.col("at") - F.col("item_at")).alias("line")).distinct()
    order = W.partitionBy(*pair, "line").orderBy("item_at")  # an item's windows at most
    runs = on_line.withColumn("island", F.col("item_at") - F.row_number().over(order)).groupBy(*pair, "line", "island").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy(*pair).agg((F.max("n") + WINDOW - 1).alias("run"))
    held = hits.groupBy(*pair).agg(F.count_distinct("item_at").alias("n_held"), F.max("n_windows").alias("n_windows"))
    told = held.alias("l").join(longest.alias("r"), both).select("l.*", "r.run")
    told = told.where((F.col("n_held") / F.col("n_windows") >= SIMILARITY) | (F.col("run") >= RUN_TOKENS))

    near = hits.select(*pair, "item_at", (F.col("at") - F.col("item_at")).alias("line"), "item_slots", "slots").distinct()
    near = near.alias("l").join(told.alias("r"), both).select("l.*", "r.n_windows").withColumn("verbatim", F.col("item_slots") == F.col("slots"))
    of_line, of_copy = W.partitionBy(*pair, "line").orderBy("item_at"), W.partitionBy(*pair, "line", "verbatim").orderBy("item_at")
    near = near.withColumn("island", F.col("item_at") - F.dense_rank().over(of_line)).withColumn("copied", F.col("item_at") - F.dense_rank().over(of_copy))
    length = lambda *by: F.max("item_at").over(W.partitionBy(*pair, "line", *by)) - F.min("item_at").over(W.partitionBy(*pair, "line", *by)) + WINDOW
    near = materialise(near.withColumn("run", length("island")).withColumn("copy_run", length("verbatim", "copied")), "near")

    # A line with all windows of the item, every slot equal, is the best alignment there can be: share and consistency
    # are one, all slots are equal, no run is longer, no alignment without other slots has more. The rest is for others.
    whole = near.groupBy(*pair, "line").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_windows").alias("n_windows"), F.max("run").alias("run_tokens"), F.bool_and("verbatim").alias("all"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("s"),
    ).where((F.col("n") == F.col("n_windows")) & F.col("all"))
    whole = materialise(whole.groupBy(*pair).agg(F.max("run_tokens").cast("long").alias("run_tokens"), F.max(F.size("s")).cast("long").alias("n_slots")), "whole")
    near = near.alias("l").join(whole.alias("r"), both, "left_anti")

    # Members of every alignment: (way, where); "offsets" takes for each window of the item its hits nearest to the centre.
    place = lambda way, where, run="run": F.struct(F.lit(way).alias("way"), where.alias("where"), F.col(run).alias("run"))
    at = lambda *cols: F.concat_ws(" ", *cols)
    places = F.array(
        place("document", F.lit("")),
        place("offset", at("line")),
        F.when(F.col("run") >= RUN_TOKENS, place("run", at("line", "island"))),
        F.when(F.col("verbatim") & (F.col("copy_run") >= RUN_TOKENS), place("copy", at("line", "copied"), "copy_run")),
    )
    columns = [*pair, "n_windows", "item_at", "item_slots", "slots"]
    members = near.select(*columns, F.explode(F.filter(places, lambda x: x.isNotNull())).alias("p")).select(*columns, "p.*")
    centred = near.select(*columns, "line", "run", F.explode(F.sequence(F.col("line") - SHIFT, F.col("line") + SHIFT)).alias("centre"))
    centred = centred.withColumn("away", F.abs(F.col("line") - F.col("centre")))
    centred = centred.withColumn("least", F.min("away").over(W.partitionBy(*pair, "centre", "item_at"))).where("away = least")
    members = members.unionByName(centred.select(*columns, F.lit("offsets").alias("way"), at("centre").alias("where"), "run"))

    one = [*pair, "way", "where"]
    values = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))))
    ways = members.groupBy(*one).agg(F.count_distinct("item_at").alias("n_held"), F.max("n_windows").alias("n_windows"), F.max("run").alias("run"), values.alias("s"))
    distinct = lambda x: F.size(F.array_distinct(F.col(f"s.{x}")))
    consistency = F.when(F.size("s") == 0, 1.0).otherwise(F.least(distinct("a"), distinct("b")) / F.size("s"))
    share = F.col("n_held") / F.col("n_windows")
    ways = ways.select(
        *pair, share.alias("share"), consistency.alias("consistency"), F.col("run").cast("long").alias("run_tokens"),
        F.forall("s", lambda x: x["a"].eqNullSafe(x["b"])).alias("equal"), F.size("s").cast("long").alias("n_slots"),
    )
    passed = ways.where(((F.col("share") >= SIMILARITY) | (F.col("run_tokens") >= RUN_TOKENS)) & (F.col("consistency") >= CONSISTENCY))
    passed = passed.select(*pair, "share", "consistency", "equal", "run_tokens", "n_slots")
    passed = passed.unionByName(whole.select(*pair, F.lit(1.0).alias("share"), F.lit(1.0).alias("consistency"), F.lit(True).alias("equal"), "run_tokens", "n_slots"))
    best = passed.groupBy(*pair).agg(F.max(F.struct("share", "consistency", "equal", "run_tokens", "n_slots")).alias("m"))
    return best.select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "m.share", "m.run_tokens", "m.n_slots", "m.consistency",
        F.when(F.col("m.equal"), "exact").otherwise("reparameterised").alias("kind"),
    )
