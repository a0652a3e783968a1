"""Language identification by string kernels.

A text is the set of the byte n-grams of 1 to 4 of its lower-cased form: a blended-spectrum presence kernel,
normalised. A bounded set of landmark texts spans the Nystroem approximation; one-versus-rest kernel
ridge regression gives each language a weight on every landmark. As the presence kernel is linear in the
presence vector, a batch of texts is scored by one product of its presence matrix with the landmarks'
weighted presence vectors: the same figures as the product through the kernel matrix.

The kernel lives on ``MAX_FEATURES`` hashed n-grams, those that most landmarks hold (of equals, by hash); rarer
ones are left out of it, so that a model's size does not grow with the number of languages. Fitting uses at
most ``2 * PER_LANGUAGE`` texts of each of the ``MAX_LANGUAGES`` most frequent languages, chosen by a hash of
the text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled
text every prediction is ``und``; equal scores go to the language that sorts first; null ids and repeated
rows are ordinary rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, utf8

NGRAMS = (1, 2, 3, 4)
HASH_BITS = 20
#: Documented bounds of the fit: texts and landmarks of each language, n-grams of the kernel, languages.
PER_LANGUAGE, LANDMARKS, MAX_FEATURES, MAX_LANGUAGES = 200, 48, 1 << 15, 300
RIDGE = 1e-3
UNDETERMINED = "und"
#: Bytes of text whose n-grams are held at once.
PART_BYTES = 1 << 20


def gram_codes(body: np.ndarray, n: int) -> np.ndarray:
    """A hash of HASH_BITS bits of each n bytes."""
    m = len(body) - n + 1
    code = np.full(max(m, 0), n, np.uint32)
    for k in range(n):
        code = (code << np.uint32(8)) ^ (code >> np.uint32(24)) * np.uint32(0x01000193) ^ body[k : k + m]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)


def lowered(t: bytes) -> bytes:
    return t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode()


def presence(texts: list[bytes], lookup: np.ndarray, width: int) -> np.ndarray:
    """0/1 matrix: which kernel features (by ``lookup`` of the hash; -1: none) each text holds."""
    out = np.zeros((len(texts), width + 1), bool)  # the last column takes what is no feature
    flat = out.reshape(-1)

    def mark(body: np.ndarray, row: np.ndarray) -> None:
        base = row * (width + 1)
        for n in NGRAMS:
            if len(body) >= n:
                at = base[: len(body) - n + 1] + lookup[gram_codes(body, n)]
                flat[at[row[: len(body) - n + 1] == row[n - 1 :]]] = True

    held: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(texts):
        body = np.frombuffer(lowered(t), np.uint8)
        for a in range(0, len(body), PART_BYTES):  # parts overlap, so no n-gram is lost
            part = body[a : a + PART_BYTES + max(NGRAMS) - 1]
            held.append(part), rows.append(np.full(len(part), i, np.int64))
            size += len(part)
            if size >= PART_BYTES:
                mark(np.concatenate(held), np.concatenate(rows))
                held, rows, size = [], [], 0
    if held:
        mark(np.concatenate(held), np.concatenate(rows))
    return out[:, :width]


class Model:
    def __init__(self, languages: list[str], lookup: np.ndarray, weights: np.ndarray):
        self.languages, self.lookup, self.weights = languages, lookup, weights

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = presence(texts, self.lookup, len(self.weights)).astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return (x @ self.weights) / norm[:, None]


def fit(sample: list[tuple[str, bytes]]) -> Model | None:
    """Nystroem kernel ridge regression, one language against the rest."""
    languages = sorted({y for y, _ in sample})
    if not languages:
        return None
    of = {y: [t for z, t in sample if z == y] for y in languages}
    landmarks = [t for y in languages for t in of[y][:LANDMARKS]]
    everything = np.arange(1 << HASH_BITS)
    counts = np.zeros(1 << HASH_BITS, np.int32)
    for t in landmarks:
        counts += presence([t], everything, 1 << HASH_BITS)[0]
    # The kernel's n-grams: those that most landmarks hold; ties by hash.
    chosen = np.lexsort((everything, -counts))[:MAX_FEATURES]
    chosen = np.sort(chosen[counts[chosen] > 0])
    lookup = np.full(1 << HASH_BITS, len(chosen), np.int32)
    lookup[chosen] = np.arange(len(chosen))

    def unit(texts: list[bytes]) -> np.ndarray:
        x = presence(texts, lookup, len(chosen)).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    marks = unit(landmarks)
    k_nm = np.concatenate([unit([t for _, t in sample[a : a + 64]]) @ marks.T for a in range(0, len(sample), 64)]).astype(np.float64)
    k_mm = (marks @ marks.T).astype(np.float64)
    y = np.array([[1.0 if z == lang else -1.0 for lang in languages] for z, _ in sample])
    left = k_nm.T @ k_nm + RIDGE * len(sample) * k_mm + 1e-8 * np.eye(len(landmarks))
    alpha = np.linalg.solve(left, k_nm.T @ y)
    return Model(languages, lookup, (marks.T @ alpha).astype(np.float32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the winning one-versus-rest output, mapped from -1..1 to 0..1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            texts = part.column(1).to_pylist()
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t.decode("utf-8", "replace"))]
            if rows:
                s = model.scores([texts[i] for i in rows])
                best = s.argmax(axis=1)
                score[rows] = np.clip((s[np.arange(len(rows)), best] + 1) / 2, 0, 1)
                for i, b in zip(rows, best.tolist()):
                    pred[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_b"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", doc_id)


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score): learnt from the rows outside the held-out fold of crc32(id)."""
    fold = crc_mod(doc_id, folds)
    model = fit(labelled_sample(docs.where(fold != held_out), lang, text, PER_LANGUAGE, MAX_LANGUAGES))
    out = identify(docs, model, doc_id, text)
    return out.select(doc_id, (fold == held_out).alias("held_out"), "lang_pred", "score")
