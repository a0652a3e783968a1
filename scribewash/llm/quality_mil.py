"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes; only documents have labels. Every passage is encoded
from its byte-class pairs and its self-similarity (how often a byte equals the one some places before);
a gated attention learns from the document labels how much each passage counts; the weighted sum of the
passages' representations is scored.

Fitting: plain gradient descent (Adam) on the driver, at most ``2 * PER_LABEL`` documents of each label,
chosen by a hash of the text. Scoring: one pass, no shuffle, whole texts; features are counted part by part,
and what is held of a long text is one row of WIDTH floats for each passage: a fraction over its own bytes.

Defined results: null and empty texts are a bag of one passage without bytes; without any label every
score is 0.5; null ids and repeated rows are ordinary rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sample_by_labels, utf8

PER_LABEL = 800
PASSAGE, LAGS = 512, tuple(range(2, 18))
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 16, 40, 64, 0.01, 1e-4
THRESHOLD = 0.3
#: Bytes of texts whose passages are scored at once; passages whose features are counted at once.
PART_BYTES, PART_PASSAGES = 1 << 20, 1 << 10


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: vowels, other letters, capitals, digits, blanks, line ends, each sign by itself."""
    of = np.zeros(256, np.int64)
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    for b in range(256):
        c = chr(b) if b < 128 else ""
        if b in signs:
            of[b] = 8 + signs.index(b)
        elif b >= 128:
            of[b] = 1 if b >= 192 else 2
        elif c.islower():
            of[b] = 3 if c in "aeiou" else 4
        elif c.isupper():
            of[b] = 5
        elif c.isdigit():
            of[b] = 6
        elif c == "\n":
            of[b] = 7
    return of, 8 + len(signs)


CLASS, N_CLASSES = _classes()
COARSE = np.minimum(np.arange(N_CLASSES), 8)
WIDTH = N_CLASSES + 9 * 9 + len(LAGS) + 1


def passage_features(body: np.ndarray) -> np.ndarray:
    """One row of features for each PASSAGE bytes of a text, PART_PASSAGES at a time."""
    n = max(1, -(-len(body) // PASSAGE))
    out = np.zeros((n, WIDTH), np.float32)
    back = max(LAGS)
    for first in range(0, n if len(body) else 0, PART_PASSAGES):
        rows = min(PART_PASSAGES, n - first)
        begin, end = first * PASSAGE, min(len(body), (first + rows) * PASSAGE)
        before = min(begin, back)  # bytes that the part's own are compared with
        part = body[begin - before : end]
        own = part[before:]
        at = np.arange(len(own), dtype=np.int32) // PASSAGE
        size = np.bincount(at, minlength=rows).astype(np.float32)
        cls = CLASS[part]
        f = out[first : first + rows]
        f[:, :N_CLASSES] = np.bincount(at * N_CLASSES + cls[before:], minlength=rows * N_CLASSES).reshape(rows, -1) / size[:, None]
        rough = COARSE[cls]
        skip = 0 if before else 1  # the text's first byte follows none
        pairs = at[skip:] * 81 + rough[before + skip - 1 : len(part) - 1] * 9 + rough[before + skip :]
        f[:, N_CLASSES : N_CLASSES + 81] = np.bincount(pairs, minlength=rows * 81).reshape(rows, -1) / size[:, None]
        for k, lag in enumerate(LAGS):
            skip = max(0, lag - before)
            if len(own) > skip:
                same = own[skip:] == part[before + skip - lag : len(part) - lag]
                f[:, N_CLASSES + 81 + k] = np.bincount(at[skip:], weights=same, minlength=rows) / size
        np.sqrt(f, out=f)
        f[:, -1] = np.log1p(size) / 8
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """z = (x - mean) / scale; h = tanh(z E); a = softmax over a document of (tanh(h V) * sigmoid(h U)) w; s = sum(a h) c + b."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, params: dict[str, np.ndarray], shift: float = 0.0):
        self.mean, self.scale, self.p, self.shift = mean, scale, params, shift

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        q = (v * u) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        ex = np.exp(q - np.repeat(np.maximum.reduceat(q, starts), sizes))
        a = ex / np.repeat(np.add.reduceat(ex, starts), sizes)
        r = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "v": v, "u": u, "a": a, "r": r, "sizes": sizes, "s": r @ p["c"] + p["b"]}

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, starts)["s"] + self.shift)

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, starts)
        ds = (_sigmoid(f["s"]) - y) / len(y)
        g = {"c": f["r"].T @ ds, "b": ds.sum(keepdims=True)}
        dr = np.repeat(ds[:, None] * p["c"], f["sizes"], axis=0)  # of each passage's document
        da = (dr * f["h"]).sum(axis=1)
        dq = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
        dvu = dq[:, None] * p["w"]
        dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dr + dv @ p["V"].T + du @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        return g | {"w": (f["v"] * f["u"]).T @ dq, "V": f["h"].T @ dv, "U": f["h"].T @ du, "E": f["z"].T @ de, "e": de.sum(axis=0)}


def fit(sample: list[tuple[int, bytes]], counts: dict[int, int]) -> Model | None:
    if len({y for y, _ in sample}) < 2:
        return None
    rng = np.random.default_rng(7)
    bags = [passage_features(np.frombuffer(t, np.uint8)) for _, t in sample]
    y = np.array([y for y, _ in sample], float)
    every = np.concatenate(bags)
    model = Model(every.mean(axis=0), every.std(axis=0) + 0.02, {
        "E": rng.normal(0, 1 / math.sqrt(WIDTH), (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
    })
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            sizes = np.array([len(bags[i]) for i in some])
            g = model.gradient(np.concatenate([bags[i] for i in some]), np.cumsum(sizes) - sizes, y[some])
            step += 1
            for k in model.p:
                d = g[k] + DECAY * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.999 * v2[k] + 0.001 * d * d
                model.p[k] = model.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    # The sample holds the labels in other shares than the corpus.
    share, prior = y.mean(), min(0.98, max(0.02, counts.get(1, 0) / max(1, sum(counts.values()))))
    model.shift = math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return model


def score_texts(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            scores: list[np.ndarray] = []
            held: list[np.ndarray] = []

            def flush() -> None:
                if held:
                    sizes = np.array([len(x) for x in held])
                    scores.append(model.scores(np.concatenate(held), np.cumsum(sizes) - sizes))
                    held.clear()

            if model is None:
                scores.append(np.full(part.num_rows, 0.5))
            else:
                size = 0
                for x in part.column(1):
                    held.append(passage_features(np.frombuffer(x.as_py(), np.uint8)))
                    size += len(held[-1]) * PASSAGE
                    if size >= PART_BYTES:
                        flush()
                        size = 0
                flush()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_b"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumnRenamed("doc_id", doc_id)


def quality_mil(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_out: int = 0
) -> DataFrame:
    """(id, held_out, score, predicted): learnt from labelled rows outside the held-out fold of crc32(id)."""
    fold = crc_mod(doc_id, folds)
    sample, counts = sample_by_labels(docs, labels.where(fold != held_out), doc_id, text, label, PER_LABEL)
    out = score_texts(docs, fit(sample, counts), doc_id, text)
    return out.select(doc_id, (fold == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
