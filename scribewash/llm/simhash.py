"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

1. Each text's fingerprint: 64 bit-wise majorities over the XXH64 of its word shingles.
2. Equal fingerprints are one class (their documents are never paired).
3. A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
   two embeddings never exceeds the Hamming distance of the fingerprints. Counts are stored in unary
   (0, 1, 2 as 00, 01, 11), so that the Manhattan distance is one xor and one bit count.
4. Grid range-join: the 32 coordinates form five bands. Within distance 2, at least three bands agree,
   so each embedding goes to ten cells (three bands of five), and only cell mates are compared,
   first by Manhattan distance (the lower bound), then exactly.
5. Cells with more than ``CELL_MAX`` members are not paired up: there, a fingerprint meets others by
   its 64 one-bit flips and itself. Two fingerprints share such a key exactly if they differ in at most
   two bits, and a key has at most 65 holders: exact, and linear in the members.
6. Classes are joined up by large-star/small-star rounds, each written to the shared folder.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer words than
a shingle: the whole sequence is one shingle; null ids are rows that take part but never name a
component (null if it has no other id); repeated rows have one class; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, discard, materialise, utf8

SHINGLE, SEED, RADIUS = 3, 42, 2
CELL_MAX = 48
#: Shingle hashes whose bits are counted at once, bytes of a text whose words are held at once: bounds of a
#: task's memory, not of a text's length.
BLOCK, PART_BYTES = 1 << 17, 1 << 18
BANDS = ((0, 14), (14, 14), (28, 12), (40, 12), (52, 12))


def _hashes(words: list[bytes], n: int) -> list[int]:
    """Of the shingles of a word sequence."""
    if not words:
        return []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - n] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[i:j], SEED) for i, j in zip(starts, ends[n - 1 :].tolist())]


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(b: bytes, n: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text, read part by part."""
    counts, total, carried = np.zeros(64, np.int64), 0, []

    def count(hashes: list[int]) -> None:
        nonlocal total
        total += len(hashes)
        for k in range(0, len(hashes), BLOCK):
            raw = np.array(hashes[k : k + BLOCK], dtype=">u8").view(np.uint8).reshape(-1, 8)
            counts[:] += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)

    for part in byte_parts(b, PART_BYTES):
        carried += part.lower().split()
        if len(carried) >= n:
            count(_hashes(carried, n))
            carried = carried[len(carried) - n + 1 :] if n > 1 else []
    if not total:
        count(_hashes(carried, n))
    return _majority(counts, total) if total else 0


def _fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    starts: list[int] = []
    docs: list[int] = []

    def flush() -> None:
        if docs:
            bits = np.unpackbits(np.array(held, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            sizes = np.diff([*starts, len(held)])
            packed = np.packbits(2 * counts > sizes[:, None], axis=1)
            out[docs] = packed.view(">u8").ravel().astype(np.uint64)
        held.clear(), starts.clear(), docs.clear()

    for k, b in enumerate(texts):
        if len(b) > PART_BYTES:
            out[k] = fingerprint(b, n)
        elif hashes := _hashes(b.lower().split(), n):
            docs.append(k), starts.append(len(held)), held.extend(hashes)
            if len(held) > BLOCK:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                fps = _fingerprints(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_b"))
    return rows.mapInArrow(scan, "doc_id long, fp long").withColumnRenamed("doc_id", doc_id)


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def embedding(fp: Column) -> Column:
    """Bit counts of 32 two-bit segments, in unary, as one long."""
    odd = 0x5555555555555555
    low, high = _and(fp, odd), _and(F.shiftrightunsigned(fp, 1), odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def near_pairs(points: DataFrame) -> DataFrame:
    """(u, v) with u < v: links among distinct fingerprints ``fp`` that connect all that lie within RADIUS.

    Every pair within the radius is linked, directly or (in crowded cells) through a common key.
    """
    from itertools import combinations

    masks = [sum(((1 << n) - 1) << at for at, n in band) for band in combinations(BANDS, 3)]
    cell = [F.xxhash64(F.lit(i), _and(F.col("e"), m)) for i, m in enumerate(masks)]
    celled = points.select("fp", embedding(F.col("fp")).alias("e")).select("fp", "e", F.explode(F.array(*cell)).alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Most cells hold one point; what is left after this join is small.
    mates = materialise(celled.join(sizes, "cell"), "cells")

    small = mates.where(F.col("n") <= CELL_MAX).select("cell", "fp", "e")
    a, b = small.select("cell", F.col("fp").alias("u"), F.col("e").alias("eu")), small.select("cell", F.col("fp").alias("v"), F.col("e").alias("ev"))
    bound = F.bit_count(F.col("eu").bitwiseXOR(F.col("ev"))) <= RADIUS
    exact = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    paired = a.join(b, "cell").where((F.col("u") < F.col("v")) & bound & exact).select("u", "v")

    crowded = mates.where(F.col("n") > CELL_MAX).select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)) for k in range(64)]]
    keyed = crowded.select("fp", F.explode(F.array(*flips)).alias("k"))
    held = keyed.groupBy("k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    met = held.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u < v")
    return paired.unionByName(met).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by large-star and small-star rounds."""
    spark = edges.sparkSession
    now = materialise(edges.select("u", "v"), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Small star: every node links its smaller neighbours, and itself, to the smallest.
        down = large.select(F.col("v").alias("n"), F.col("u").alias("s"))
        least = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(least, "n").where("s <> m").select(F.col("m").alias("u"), F.col("s").alias("v"))
        now, old = materialise(small.unionByName(least.select(F.col("m").alias("u"), F.col("n").alias("v"))).distinct(), "edges"), now
        discard(old)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    prints = materialise(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "classes")
    roots = components(near_pairs(classes))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(of_root, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select(
        doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
