"""Quality rules with robust multivariate outlier rejection.

Every whole text gives base counts and a vector of transformed statistics. For each language and
source a minimum-covariance-determinant estimate (centre and scatter of the tightest three quarters)
is found by concentration steps; a document whose squared Mahalanobis distance passes the cut is
rejected. The same is estimated for each language and for the table; a group's estimate is drawn towards
its parent's (source to language to table) with the weight of ``PRIOR_ROWS`` rows against the group's own
number: every group has an estimate of its own, a small one leans on its parent, at no size is there a switch.

Scale: a concentration step is one aggregation of moments by (group, distance bin), combined before
the shuffle, so a group with a third of all rows still sends at most one row per bin and task. The
step's half-sample is "the nearest bins that hold three quarters", which needs no sort. The solver
sees at most ``N_BINS`` rows a group. Long texts are read part by part.

Defined results: a null text has no words; a text without words fails the base rules; null languages
or sources form groups of their own; null or repeated ids are ordinary rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, materialise, utf8

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
SYMBOLS, _BLANKS = b"#*$%&|<>", b"\x20\t\n\x0b\x0c\r"
DIMS = ("log_words", "word_len", "symbol_pct", "dup_line_pct", "repeat_pct", "upper_pct")
#: Spread that each statistic has at least: most texts have no symbol, no repeated line.
FLOOR = (0.5, 0.10, 0.25, 1.0, 1.0, 0.35)
#: Statistics are held in steps of 1/QUANTUM: their sums are then exact in doubles, in any order.
QUANTUM = 1024
KEEP_SHARE, STEPS, N_BINS = 0.75, 4, 512
#: Rows that a parent's estimate counts for.
PRIOR_ROWS = 50
#: Texts longer than this are read in parts of this size.
PART_BYTES = 1 << 18
#: Groups whose estimates are broadcast (some 400 bytes each); beyond, both sides are salted and shuffled.
MAX_BROADCAST_GROUPS, SALTS = 10_000, 32
#: The cut as the share of regular documents beyond it.
TAIL = 1e-5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(windows_twice: list[bool] | np.ndarray) -> int:
    """Words in windows of three that are marked, by position."""
    repeat = end = 0  # positions before end are counted
    for i in np.flatnonzero(windows_twice).tolist():
        repeat += i + 3 - max(i, end)
        end = i + 3
    return repeat


def _equal_neighbours(digests: bytearray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each but the first equals the one before) of 16-byte digests, sorted."""
    parts = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    order = np.lexsort((parts[:, 1], parts[:, 0]))
    same = np.ones(max(len(order) - 1, 0), bool)
    for column in (0, 1):
        x = parts[order, column]
        same &= x[1:] == x[:-1]
    return order, same


def _twice(digests: bytearray) -> np.ndarray:
    """Which of the digests occur more than once."""
    order, same = _equal_neighbours(digests)
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _long_counts(b: bytes) -> tuple[int, ...]:
    """``text_counts`` of a long text: 16 bytes are held for each window and line, no words."""
    n = chars = upper = n_lines = 0
    windows, lines, carried, line = bytearray(), bytearray(), [], None
    digest = xxhash.xxh3_128_digest
    for part in byte_parts(b, PART_BYTES):
        words = part.split()
        n += len(words)
        text = part.decode("utf-8", "replace")
        chars += len(text) - (len(part) - len(part.translate(None, _BLANKS)))
        upper += sum(map(str.isupper, text))
        carried += words
        for w in zip(carried, carried[1:], carried[2:]):
            windows += digest(b" ".join(w))
        carried = carried[-2:]
        *full, rest = part.split(b"\n")
        for x in full:
            if line is not None:
                line.update(x)
                blank, told = blank and not x.strip(_BLANKS), line.digest()
                line = None
            else:
                blank, told = not x.strip(_BLANKS), digest(x)
            if not blank:
                lines += told
        if line is None:
            line, blank = xxhash.xxh3_128(rest), not rest.strip(_BLANKS)
        else:
            line.update(rest)
            blank = blank and not rest.strip(_BLANKS)
    if not blank:
        lines += line.digest()
    n_lines = len(lines) // 16
    dup = int(_equal_neighbours(lines)[1].sum())
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    return n, chars, symbols, dup, _repeated_words(_twice(windows)), upper, n_lines


def text_counts(b: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines of a whole text."""
    if len(b) > PART_BYTES:
        return _long_counts(b)
    words = b.split()  # exactly the six ASCII blanks
    n = len(words)
    text = b.decode("utf-8", "replace")
    chars = len(text) - (len(b) - len(b.translate(None, _BLANKS)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip(_BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            repeat = _repeated_words([seen[w] > 1 for w in windows])
    upper = sum(map(str.isupper, text))
    return n, chars, symbols, dup, repeat, upper, len(lines)


def _vector(n: int, chars: int, symbols: int, dup: int, repeat: int, upper: int, lines: int) -> tuple[float, ...]:
    pct = lambda a, b: math.log1p(100 * a / max(b, 1))
    # Square roots: a logarithm of these two never gets as far from 0 as the cut, given their floors.
    root = lambda a, b: math.sqrt(100 * a / max(b, 1))
    raw = (math.log1p(n), math.log1p(chars / max(n, 1)), pct(symbols, chars), root(dup, lines), root(repeat, n), pct(upper, chars))
    return tuple(float(round(x * QUANTUM)) for x in raw)


def text_statistics(docs: DataFrame, doc_id: str, text: str, groups: list[str]) -> DataFrame:
    """Id, group columns, counts and vector (v0 ...) of every document; one pass, no shuffle."""
    keys = [F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keys, utf8(text).alias("_b"))
    schema = (
        "doc_id long, " + "".join(f"g{i} string, " for i in range(len(groups)))
        + ", ".join(f"{c} long" for c in COUNTS) + "".join(f", v{i} double" for i in range(len(DIMS)))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [text_counts(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            vectors = [_vector(*c) for c in counts]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols += [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
            cols += [pa.array([v[i] for v in vectors], pa.float64()) for i in range(len(DIMS))]
            names = ["doc_id", *(f"g{i}" for i in range(len(groups))), *COUNTS, *(f"v{i}" for i in range(len(DIMS)))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(scan, schema)


def chi2_cdf(x: float, even: int) -> float:
    """Closed form for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(even // 2):
        total += term
        term *= (x / 2) / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, even: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, even) < p else (lo, mid)
    return hi


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance of v0... from ``center`` under ``precision`` (row by row)."""
    diff = [F.col(f"v{i}") - F.col("center")[i] for i in range(d)]
    terms = [diff[i] * diff[j] * F.col("precision")[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


MODEL = "gkey string, n double, center array<double>, scatter array<double>, precision array<double>"


def _with_model(stats: DataFrame, model: DataFrame, n_groups: int) -> DataFrame:
    """Each document with its group's estimate; a group with a third of all rows does not meet in one task."""
    model = model.select("gkey", "center", "precision")
    if n_groups <= MAX_BROADCAST_GROUPS:
        return stats.join(F.broadcast(model), "gkey")
    salted = stats.withColumn("salt", F.pmod(F.xxhash64(*[f"v{i}" for i in range(len(DIMS))]), F.lit(SALTS)).cast("int"))
    return salted.join(model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["gkey", "salt"]).drop("salt")


def _floor() -> np.ndarray:
    return np.diag((np.array(FLOOR) * QUANTUM) ** 2)


def _concentrate(model: DataFrame, stats: DataFrame, n_groups: int) -> DataFrame:
    """One concentration step: the centre and scatter of the nearest bins that hold KEEP_SHARE."""
    d = len(DIMS)
    # Bins grow by 3 %; the last is open.
    bin_ = F.least(F.lit(N_BINS - 1), F.floor(F.log1p(_distance(d)) * 32)).cast("int")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count(F.lit(1)).cast("double").alias("n")]
    sums += [F.sum(f"v{i}").alias(f"s{i}") for i in range(d)]
    sums += [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in pairs]
    moments = _with_model(stats, model, n_groups).withColumn("bin", bin_).groupBy("gkey", "bin").agg(*sums)
    inner = chi2_quantile(KEEP_SHARE, d)
    consistency = KEEP_SHARE / chi2_cdf(inner, d + 2)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        rows = float(pdf["n"].sum())
        upto = int(np.searchsorted(pdf["n"].cumsum().to_numpy(), math.ceil(KEEP_SHARE * rows) - 0.5)) + 1
        total = pdf.drop(columns=["gkey", "bin"]).iloc[:upto].sum()
        n, mean = total["n"], np.array([total[f"s{i}"] for i in range(d)]) / total["n"]
        scatter = np.zeros((d, d))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = total[f"s{i}_{j}"] / n - mean[i] * mean[j]
        scatter = scatter * consistency + _floor()
        return pd.DataFrame({"gkey": [pdf["gkey"].iloc[0]], "n": [rows], "center": [mean], "scatter": [scatter.ravel()], "precision": [np.linalg.inv(scatter).ravel()]})

    return moments.groupBy("gkey").applyInPandas(solve, MODEL)


def _keys(stats: DataFrame, n_groups: int) -> list[Column]:
    """The keys of a row's groups: the table, the first column, the first two and so on."""
    part = lambda i: F.concat(F.lit(f"{i}"), F.coalesce(F.concat(F.lit("="), F.col(f"g{i}")), F.lit("?")), F.lit("\x1f"))
    keys = [F.lit("all\x1f")]
    for i in range(n_groups):
        keys.append(F.concat(keys[-1], part(i)))
    return keys


def mcd(members: DataFrame, n_groups: int) -> DataFrame:
    """(gkey, n, center, scatter, precision): the estimate of each group of rows (gkey, v0 ...)."""
    d = len(DIMS)
    quartiles = members.groupBy("gkey").agg(*[F.percentile(f"v{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(d)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i] * QUANTUM)) for i in range(d)]
    model = quartiles.select(
        "gkey",
        F.array(*[F.col(f"q{i}")[1] for i in range(d)]).alias("center"),
        F.array(*[(1 / (spread[i] * spread[i])) if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("precision"),
    )
    for _ in range(STEPS):
        model = _concentrate(model, members, n_groups)
    return model


def shrunk(model: DataFrame, groups: DataFrame, depths: int) -> DataFrame:
    """(gkey, center, precision) of the deepest groups, each estimate drawn towards its parent's.

    groups: (gkey, parent, depth), a row for each group.
    """
    d = len(DIMS)
    known = model.join(groups, "gkey")
    towards = lambda c: F.zip_with(c, f"parent_{c}", lambda x, y: (F.col("n") * x + PRIOR_ROWS * y) / (F.col("n") + PRIOR_ROWS))
    level = known.where("depth = 0").select("gkey", "center", "scatter")
    for depth in range(1, depths + 1):
        parents = level.select(F.col("gkey").alias("parent"), F.col("center").alias("parent_center"), F.col("scatter").alias("parent_scatter"))
        level = known.where(F.col("depth") == depth).join(parents, "parent").select("gkey", towards("center").alias("center"), towards("scatter").alias("scatter"))

    def inverse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            precision = [np.linalg.inv(np.asarray(x).reshape(d, d)).ravel() for x in pdf["scatter"]]
            yield pd.DataFrame({"gkey": pdf["gkey"], "center": pdf["center"], "precision": precision})

    return level.mapInPandas(inverse, "gkey string, center array<double>, precision array<double>")


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")
) -> DataFrame:
    """One row per document: id, the counts, base_failed, distance (squared), kept."""
    d, depths = len(DIMS), len(groups)
    stats = materialise(text_statistics(docs, doc_id, text, list(groups)), "stats")
    keys = _keys(stats, depths)
    stats = stats.withColumn("gkey", keys[-1])
    parents = [F.lit(None).cast("string"), *keys[:-1]]
    names = [f"g{i}" for i in range(depths)]
    chain = F.array(*[F.struct(k.alias("gkey"), p.alias("parent"), F.lit(i).alias("depth")) for i, (k, p) in enumerate(zip(keys, parents))])
    seen = stats.groupBy(*names).agg(F.lit(1).alias("one")) if names else stats.limit(1)
    tree = materialise(seen.select(F.explode(chain).alias("k")).select("k.*").distinct(), "groups")
    n_groups = tree.count()
    members = stats.select(F.explode(F.array(*keys)).alias("gkey"), *[f"v{i}" for i in range(d)])
    model = materialise(mcd(members, n_groups), "mcd")
    model = materialise(shrunk(model, tree, depths), "estimates")
    judged = _with_model(stats, model, n_groups).withColumn("distance", _distance(d))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return judged.select(
        F.col("doc_id").alias(doc_id), *COUNTS, base.alias("base_failed"), "distance",
        (~base & (F.col("distance") <= chi2_quantile(1 - TAIL, d))).alias("kept"),
    )
