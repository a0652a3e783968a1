"""Exact repeated-passage removal by a distributed difference-cover suffix sort.

A byte goes if a string of ``MIN_LEN`` bytes that covers it also starts in a document with a smaller
id. Equal strings must meet in one place, sorted, without sorting all suffixes of the corpus:

1. Blocks. Documents are packed into blocks of a few MB (compressed, written once); a block is the unit
   that asks and is answered. Its number comes with it in the table, so nothing depends on a rerun.
2. Anchors. Every window of MIN_LEN bytes has an anchor, the least hash of its k-grams. Equal windows
   have equal anchors. Blocks send their distinct anchors, packed and sorted, to buckets of the anchor's
   range; a bucket replies which are held by two documents or more. All other windows are unique: this
   loses nothing and leaves the repeated part of the corpus. A common anchor is sent once by each block.
3. Suffix sort. Runs of windows with one repeated anchor are sent, as short segments, to the anchor's
   bucket, equal segments of a block once. There the segments' suffixes are sorted by difference cover
   (DC3: sort the sampled triples, recurse on their names, sort the rest by one character and a sample
   rank, merge); adjacent suffixes that agree in MIN_LEN bytes form a class, and a class knows its least id.
   Anchors in very many different segments are hot: their windows are sent one by one, dealt by the window's
   own hash, so that no bucket receives a hot anchor whole.
4. Blocks get the least ids of their windows back, mark what is covered, and cut it out.

Defined results: a null text is empty; texts shorter than MIN_LEN lose nothing; a null id counts as
larger than any other; rows with equal ids do not remove each other's bytes; an empty table gives no
rows; other columns are passed through if named in ``keep``, and the result's own names can be given a
``prefix`` where those columns have them. A block holds whole documents: one document must fit a task's memory.

Growth: a block sends one message to each bucket that one of its anchors falls into, so messages grow with
blocks times buckets until a message holds a single anchor; from there on they grow with the anchors, as the
rows of a join on the anchor would. What is done for each message is only to press and unpress it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, release_shuffles, utf8

MIN_LEN = 50
#: Bytes of the k-grams that anchors are taken from.
GRAM = 20
#: Bytes in a block, in a piece that is hashed at once (in a core's cache), of the corpus for each bucket that sorts.
BLOCK_BYTES, PIECE, BUCKET_BYTES = 8 << 20, 1 << 16, 8 << 20
#: Bytes of segments that a block gathers at once.
GATHER_BYTES = 4 << 20
#: Windows in a segment at most; different segments (counted by block) from which an anchor is hot.
MAX_RUN, HOT = 64, 10_000
#: Bytes of segments whose suffixes are sorted at once: bounds the sort's memory.
SORT_BYTES = 1 << 18
NO_ID = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _spread(h: np.ndarray) -> np.ndarray:
    """A permutation of 48-bit numbers: least hashes are small, their buckets must be even."""
    h = h ^ (h >> np.uint64(21))
    return (h * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << 48) - 1)


def gram_hashes(body: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes, by doubling: hash(2m) = hash(m) * p**m + hash(m, m further on)."""
    h, m, parts, at = _mix(body.astype(np.uint64) + np.uint64(77)), 1, [], 0
    p = 0x2545F4914F6CDD1D
    out: np.ndarray | None = None
    while True:
        if k & m:
            n = len(body) - k + 1
            piece = h[at : at + n]
            out = piece.copy() if out is None else out * np.uint64(pow(p, m, 1 << 64)) + piece
            at += m
        if 2 * m > k:
            return _mix(out)
        h = h[: len(h) - m] * np.uint64(pow(p, m, 1 << 64)) + h[m:]
        m *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m = 1
    while 2 * m <= w:
        h = np.minimum(h[: len(h) - m], h[m:])
        m *= 2
    return np.minimum(h[: len(h) - (w - m)], h[w - m :]) if m < w else h


def anchor_runs(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of 48 bits, start, number of windows, hash of both ends) of runs of windows that lie in one document."""
    starts = np.concatenate([[0], ends[:-1]])
    valid_to = ends - MIN_LEN + 1  # first start in each document that has no window
    anchors, begins, sizes, looks = [], [], [], []
    for a in range(0, len(body), PIECE):
        part = body[a : a + PIECE + MIN_LEN - 1]
        if len(part) < MIN_LEN:
            break
        grams = gram_hashes(part, GRAM)
        least = sliding_min(grams >> np.uint64(16), MIN_LEN - GRAM + 1)
        n = len(least)
        ok = np.zeros(n + 1, np.int8)
        i = np.searchsorted(ends, a, side="right")
        j = np.searchsorted(starts, a + n, side="left")
        s, e = np.clip(starts[i:j] - a, 0, n), np.clip(valid_to[i:j] - a, 0, n)
        full = e > s
        np.add.at(ok, s[full], 1), np.add.at(ok, e[full], -1)
        ok = np.cumsum(ok[:n]).astype(bool)
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
        # Documents that touch: a run never goes on over a document's start.
        at = starts[i:j] - a
        new[at[(at >= 0) & (at < n)]] = True
        first = np.flatnonzero(new)
        first = first[ok[first]]
        stop = np.flatnonzero(new | ~ok)
        last = np.append(stop, n)[np.searchsorted(stop, first, side="right")]
        size = last - first
        if (long := size > MAX_RUN).any():
            pieces = -(-size // MAX_RUN)
            of = np.repeat(np.arange(len(first)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(size[of] - nth * MAX_RUN, MAX_RUN)
            first = first[of] + nth * MAX_RUN
        anchors.append(_spread(least[first])), begins.append(first + a), sizes.append(size)
        looks.append(_mix(grams[first] + size.astype(np.uint64)) + grams[first + size + MIN_LEN - GRAM - 1])
    if not anchors:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(anchors), np.concatenate(begins), np.concatenate(sizes), np.concatenate(looks)


def pack48(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _press(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _unpress(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``n`` numbers each, one after the other."""
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def _gather(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(int(n.sum()), np.uint8)
    at = 0
    for a in range(0, len(start), 1 << 14):
        some = raw[_ranges(start[a : a + (1 << 14)], n[a : a + (1 << 14)])]
        out[at : at + len(some)] = some
        at += len(some)
    return out


def _distinct(raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings of ``n`` bytes that stand one after the other: the distinct ones, in the order in which they
    come first, as their bytes and offsets; and for each string, which it is."""
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    return np.frombuffer(data, np.uint8), np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1], coded.indices.to_numpy()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """DC3. ``s``: positive integers under 2**31."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    i1 = np.arange(1, n + (n % 3 == 1), 3)  # with a place after the end, so that R's halves stay apart
    i2 = np.arange(2, n, 3)
    sample = np.concatenate([i1, i2])
    if int(s.max()) < 1 << 21:
        key = (t[sample] << 42) | (t[sample + 1] << 21) | t[np.minimum(sample + 2, n + 2)]
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
    else:
        three = (t[np.minimum(sample + 2, n + 2)], t[sample + 1], t[sample])
        order = np.lexsort(three)
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in three], axis=0)
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    by_rank = sample[order]
    by_rank = by_rank[by_rank < n]
    i0 = np.arange(0, n, 3)
    i0 = i0[np.argsort((t[i0] << 32) | rank[i0 + 1])]
    one, two = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before_one = np.searchsorted((t[one] << 32) | rank[one + 1], (t[i0] << 32) | rank[i0 + 1])
    if int(s.max()) < 1 << 21 and n < 1 << 21:
        full = lambda i: (t[i] << 42) | (t[i + 1] << 21) | rank[i + 2]
    else:  # two characters and a rank do not fit one integer: the pairs of characters get names of their own
        pair = lambda i: (t[i] << 31) | t[i + 1]
        pairs = np.unique(np.concatenate([pair(two), pair(i0)]))
        full = lambda i: (np.searchsorted(pairs, pair(i)) << 32) | rank[i + 2]
    before_two = np.searchsorted(full(two), full(i0))
    out = np.empty(n, np.int64)
    places = np.arange(len(i0)) + before_one + before_two
    rest = np.ones(n, bool)
    rest[places] = False
    out[places] = i0
    out[rest] = by_rank
    return out


def least_ids(raw: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window of each (distinct) segment: the least id of the segments that hold the window.

    ``raw``: the segments, a byte after each; ``ends``: the places of these bytes.
    """
    lens = np.diff(ends, prepend=-1)  # with the byte after
    s = raw.astype(np.int64) + len(ends) + 1
    s[ends] = np.arange(1, len(ends) + 1)
    sa = suffix_array(s)
    seg_of = np.repeat(np.arange(len(ends)), lens)
    starts_window = np.arange(len(s)) + MIN_LEN <= np.repeat(ends, lens)
    sa = sa[starts_window[sa]]
    windows = np.lib.stride_tricks.sliding_window_view(raw, MIN_LEN)
    new = np.ones(len(sa), bool)
    for a in range(1, len(sa), 1 << 18):
        b = min(len(sa), a + (1 << 18))
        new[a:b] = (windows[sa[a:b]] != windows[sa[a - 1 : b - 1]]).any(axis=1)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[seg_of[sa]], heads)
    of = np.full(len(s), NO_ID, np.int64)
    of[sa] = least[np.cumsum(new) - 1]
    return of[starts_window]


def least_ids_in_parts(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``least_ids`` of distinct segments, sorted in parts of about SORT_BYTES.

    Equal windows have one anchor, so segments of different anchors need not meet, and a segment that is
    the only one of its anchor has no window in another segment.
    """
    begin, size = offsets[:-1], np.diff(offsets)
    windows = size - MIN_LEN + 1
    first = np.cumsum(windows) - windows
    out = np.repeat(ids, windows)
    anchor = np.empty(len(ids), np.uint64)
    step = 1 << 14
    for a in range(0, len(ids), step):
        h = gram_hashes(data[begin[a : a + step, None] + np.arange(MIN_LEN)].ravel(), GRAM) >> np.uint64(16)
        h = np.append(h, np.zeros(GRAM - 1, np.uint64)).reshape(-1, MIN_LEN)[:, : MIN_LEN - GRAM + 1]
        anchor[a : a + step] = h.min(axis=1)
    order = np.argsort(anchor)
    sorted_ = anchor[order]
    counts = np.diff(np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])))
    many = counts > 1
    held = order[np.repeat(many, counts)]
    ends = np.cumsum(counts[many])  # of the anchors in ``held``
    total = np.concatenate([[0], np.cumsum(size[held])])
    padded = np.append(data, np.uint8(0))
    a = 0
    while a < len(held):
        b = int(ends[min(np.searchsorted(total[ends], total[a] + SORT_BYTES), len(ends) - 1)])
        part = held[a:b]
        raw = _gather(padded, begin[part], size[part] + 1)
        out[_ranges(first[part], windows[part])] = least_ids(raw, np.cumsum(size[part] + 1) - 1, ids[part])
        a = b
    return out


def _blocks(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), utf8(text).alias("_body"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, size
            t = pa.Table.from_batches(held)
            bodies = t.column("_body").to_pylist()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.select(["_keep"]).schema) as w:
                w.write_table(t.select(["_keep"]))
            ids = np.array([NO_ID if x is None else x for x in t.column("_id").to_pylist()], "<i8")
            out = pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 32) | nth], pa.int64()),
                    "n_bytes": pa.array([sum(map(len, bodies))], pa.int64()),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "lens": pa.array([np.array(list(map(len, bodies)), "<i8").tobytes()], pa.binary()),
                    "body": pa.array([_press(b"".join(bodies))], pa.binary()),
                    "keep": pa.array([_press(sink.getvalue().to_pybytes())], pa.binary()),
                }
            )
            held.clear()
            nth, size = nth + 1, 0
            return out

        for batch in batches:
            lens = [len(x.as_buffer()) for x in batch.column("_body")] if batch.num_rows else []
            a = 0
            for i, n in enumerate(lens):
                size += n
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(a, i + 1 - a))
                    a = i + 1
                    yield flush()
            if a < batch.num_rows:
                held.append(batch.slice(a))
        if held:
            yield flush()

    return rows.mapInArrow(pack, "block long, n_bytes long, ids binary, lens binary, body binary, keep binary")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One at a time: a batch holds many blocks."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _open(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Body, its bytes as an array, ends of the documents, their ids."""
    body = _unpress(row["body"]) if row["n_bytes"] else b""
    return body, np.frombuffer(body, np.uint8), np.cumsum(np.frombuffer(row["lens"], "<i8")), np.frombuffer(row["ids"], "<i8")


def _held(anchors: np.ndarray, begins: np.ndarray, ends: np.ndarray, looks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct anchors, sorted, and of each: 1 if one of its documents holds it, else by how many
    different segments it is held, 2 to 255 (by the hashes of their ends: this decides what is hot only)."""
    order = np.argsort(anchors)
    h = anchors[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    n = np.ones(len(head), np.uint8)
    runs = np.diff(np.append(head, len(h)))
    if len(several := np.flatnonzero(runs > 1)):
        size = runs[several]
        at = order[_ranges(head[several], size)]
        doc = np.searchsorted(ends, begins[at], side="right")
        first = np.cumsum(size) - size
        shared = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        of, look = np.repeat(np.arange(len(several)), size), looks[at]
        by_look = np.lexsort((look, of))
        of, look = of[by_look], look[by_look]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (look[1:] != look[:-1])
        n[several[shared]] = np.clip(np.add.reduceat(new, first, dtype=np.int64), 2, 255)[shared]
    return h[head], n


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cuts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    if not len(buckets):
        return []
    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return list(zip(buckets[at].tolist(), at.tolist(), np.append(at[1:], len(buckets)).tolist()))


def _bucket_counts(total: int) -> tuple[int, int]:
    """Buckets that are asked, and that sort, for so many bytes. A message costs time whatever it holds, and there is
    one for each block and bucket: both are as large as a task's memory allows."""
    return max(16, -(-total // (2 * BUCKET_BYTES))), max(64, -(-total // BUCKET_BYTES))


def _ask(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, body, ends, _ = _open(row)
                anchors, begins, _, looks = anchor_runs(body, ends)
                h, n = _held(anchors, begins, ends, looks)
                cuts = _cuts(_bucket(h, n_buckets))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([c[0] for c in cuts], pa.int64()),
                        "block": pa.array([row["block"]] * len(cuts), pa.int64()),
                        "anchors": pa.array([pack48(h[a:b]) for _, a, b in cuts], pa.binary()),
                        "held": pa.array([_press(n[a:b].tobytes()) for _, a, b in cuts], pa.binary()),
                    }
                )

    return run


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: a mark for every anchor asked for: 0 in one document, 1 in more, 2 in very many segments."""
    asked = [unpack48(x) for x in pdf["anchors"]]
    every = np.concatenate(asked)
    n = np.concatenate([np.frombuffer(_unpress(x), np.uint8) for x in pdf["held"]])
    names, of = np.unique(every, return_inverse=True)
    total = np.bincount(of, weights=n, minlength=len(names))
    marks = ((total > 1).astype(np.uint8) + (total > HOT))[of]
    cut = np.cumsum([len(x) for x in asked])[:-1]
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "marks": [_press(x.tobytes()) for x in np.split(marks, cut)]})


def _candidates(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Body, ends, ids, and of the repeated runs: key, start, windows. Hot runs are single windows."""
    _, raw, ends, ids = _open(row)
    anchors, begins, sizes, _ = anchor_runs(raw, ends)
    told = sorted(row["marks"], key=lambda x: x["bucket"]) if row["marks"] else []
    mark = np.zeros(0, np.uint8)
    if told:
        marks = np.concatenate([np.frombuffer(_unpress(x["marks"]), np.uint8) for x in told])  # of the distinct anchors, sorted
        mark = marks[np.unique(anchors, return_inverse=True)[1]]
    keys, at, size = [anchors[mark == 1]], [begins[mark == 1]], [sizes[mark == 1]]
    if (hot := mark == 2).any():
        single = _ranges(begins[hot], sizes[hot])
        windows = np.lib.stride_tricks.sliding_window_view(raw, MIN_LEN)
        for a in range(0, len(single), 1 << 14):
            some = single[a : a + (1 << 14)]
            keys.append(gram_hashes(windows[some].ravel(), MIN_LEN)[::MIN_LEN] >> np.uint64(16))
            at.append(some), size.append(np.ones(len(some), np.int64))
    return raw, ends, ids, np.concatenate(keys), np.concatenate(at), np.concatenate(size)


def _segments(row: dict, n_buckets: int):
    """Yields, for some buckets at a time: (bucket, from, to) of the distinct segments, their bytes and offsets;
    runs: index of each one's segment, start, id of the document."""
    raw, ends, ids, keys, at, size = _candidates(row)
    buckets = _bucket(keys, n_buckets)
    order = np.argsort(buckets, kind="stable")
    buckets, at, n = buckets[order], at[order], size[order] + MIN_LEN - 1
    bounds = np.array([a for _, a, _ in _cuts(buckets)] + [len(at)])
    total = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(at):
        b = int(bounds[np.searchsorted(total[bounds], min(total[a] + GATHER_BYTES, total[-1]))])
        data, offsets, of = _distinct(_gather(raw, at[a:b], n[a:b]), n[a:b])
        # Equal segments have one key and the rows are in the buckets' order, so the distinct ones are as well.
        bucket = np.empty(len(offsets) - 1, np.int64)
        bucket[of] = buckets[a:b]
        yield _cuts(bucket), data, offsets, of, at[a:b], ids[np.searchsorted(ends, at[a:b], side="right")]
        a = b


def _send(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for row in _rows(batch):
                for cuts, data, offsets, of, _, doc in _segments(row, n_buckets):
                    least = np.full(len(offsets) - 1, NO_ID, np.int64)
                    np.minimum.at(least, of, doc)
                    lens = np.diff(offsets).astype("<i4")
                    out = [[c[0] for c in cuts], [row["block"]] * len(cuts)]
                    out += [[press(x[a:b]) for _, a, b in cuts] for x in (lens, least.astype("<i8"))]
                    out.append([press(data[offsets[a] : offsets[b]]) for _, a, b in cuts])
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["bucket", "block", "lens", "least", "bytes"])

    return run


def _sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for every block, the least ids of all windows of its segments, in their order."""
    press, unpress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    lens = [np.frombuffer(unpress(x), "<i4") for x in pdf["lens"]]
    raw = np.frombuffer(b"".join([unpress(x) for x in pdf["bytes"]]), np.uint8)
    data, offsets, of = _distinct(raw, np.concatenate(lens))
    del raw
    ids = np.full(len(offsets) - 1, NO_ID, np.int64)
    np.minimum.at(ids, of, np.frombuffer(b"".join([unpress(x) for x in pdf["least"]]), "<i8"))
    found = least_ids_in_parts(data, offsets, ids)
    windows = np.diff(offsets) - MIN_LEN + 1
    first = np.cumsum(windows) - windows
    reply, a = [], 0
    for x in lens:
        some = of[a : a + len(x)]
        reply.append(press(found[_ranges(first[some], windows[some])].astype("<i8", copy=False)))
        a += len(x)
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "least": reply})


def _spans(row: dict, n_buckets: int, told: dict[int, bytes]) -> np.ndarray:
    """For each byte of the block: is it removed."""
    unpress = zstandard.ZstdDecompressor().decompress
    gone = np.zeros(row["n_bytes"] + MIN_LEN, np.int32)  # MIN_LEN places further on
    for cuts, _, offsets, of, at, doc in _segments(row, n_buckets):
        least = np.frombuffer(b"".join([unpress(told[bucket]) for bucket, _, _ in cuts]), "<i8")
        n = np.diff(offsets) - MIN_LEN + 1
        windows = n[of]
        later = least[_ranges((np.cumsum(n) - n)[of], windows)] < np.repeat(doc, windows)
        gone[_ranges(at + MIN_LEN, windows)[later]] = 1
    np.cumsum(gone, out=gone)
    return gone[MIN_LEN:] > gone[:-MIN_LEN]


def _cut(n_buckets: int, names: list[str], schema: pa.Schema, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                body, _, ends, _ = _open(row)
                gone = _spans(row, n_buckets, {x["bucket"]: x["least"] for x in row["least"] or []})
                raw = np.frombuffer(body, np.uint8)
                starts = [0, *ends[:-1].tolist()]
                n_removed, n_spans, kept = [], [], []
                for a, b in zip(starts, ends.tolist()):
                    g = gone[a:b]
                    k = int(g.sum())
                    n_removed.append(k)
                    n_spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
                    kept.append(body[a:b] if not k else raw[a:b][~g].tobytes())
                cols = pa.ipc.open_stream(_unpress(row["keep"])).read_all().column("_keep").combine_chunks()
                cols = cols.chunk(0) if isinstance(cols, pa.ChunkedArray) else cols
                arrays = [cols.field(i) for i in range(len(names))]
                arrays += [pa.array(np.diff([0, *ends]), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())]
                arrays.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)

    return run


def suffix_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, as_text: bool = False, prefix: str = ""
) -> DataFrame:
    """The columns ``keep`` (the id alone by default) and n_bytes, n_removed, n_spans, kept, these after ``prefix``.

    ``kept`` holds the remaining bytes; with ``as_text`` a string, without the rests of characters that a cut went through.
    """
    keep = keep or [doc_id]
    counts = [f"{prefix}{c}" for c in ("n_bytes", "n_removed", "n_spans")]
    if clash := {*counts, f"{prefix}kept"} & {*keep}:
        raise ValueError(f"keep has columns of the result ({', '.join(sorted(clash))}): name a prefix")
    spark = docs.sparkSession
    blocks = materialise(_blocks(docs, doc_id, text, keep), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets, n_sorts = _bucket_counts(total)
    asked = blocks.select("block", "n_bytes", "ids", "lens", "body").mapInArrow(_ask(n_buckets), "bucket long, block long, anchors binary, held binary")
    marks = materialise(asked.groupBy("bucket").applyInPandas(_mark, "block long, bucket long, marks binary"), "marks")
    release_shuffles(spark)

    of_block = marks.groupBy("block").agg(F.collect_list(F.struct("bucket", "marks")).alias("marks"))  # a block's own
    marked = blocks.join(of_block, "block", "left")
    sent = marked.drop("keep").mapInArrow(_send(n_sorts), "bucket long, block long, lens binary, least binary, bytes binary")
    replies = materialise(sent.groupBy("bucket").applyInPandas(_sort_bucket, "block long, bucket long, least binary"), "least")
    release_shuffles(spark)

    answer = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "least")).alias("least"))
    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(f"{prefix}kept", T.StringType() if as_text else T.BinaryType())]
    schema = T.StructType(fields)
    return marked.join(answer, "block", "left").mapInArrow(_cut(n_sorts, keep, to_arrow_schema(schema), as_text), schema)
