"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds the model's pieces. It reads a chunk once; at each position the output links give
every piece that ends there, longest first, and each relaxes the best score of that position. The best
segmentation maximises the sum of the pieces' scores; of equals, the one whose last piece is longer wins.

Scores are log-probabilities. A unigram model brings its own. The models of /opt/tokenizers are merge-rank
models, whose scores only order the merges: their pieces get the probabilities of Zipf's law over that
order, the piece of rank r (from 1, by id) 1 / (r * H), H being the sum of all 1 / r. So one frequent long
piece beats many short ones, as in a unigram model. Scores are integers (units of 1 / SCALE): sums are
exact, and a result does not depend on where a text was cut for memory.

No piece holds a word mark after another character, so every segmentation cuts before a run of blanks:
chunks (blanks and what follows them) are solved on their own, and a bounded memory solves a frequent
chunk once. A long chunk is solved in windows: the best paths to the last positions of a window meet
somewhere, and what comes before is settled. Texts of any length take memory of about their own size.

Characters without a piece become their UTF-8 byte pieces. A word mark that stands in a text itself
has no piece here and becomes bytes, so ``decode(encode(text)) == text`` for every text.

Defined results: null encodes as null and decodes as null; an empty text has no pieces; repeated rows
and null ids are ordinary rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Vocabularies are sent to every task: larger ones are refused.
MAX_PIECES = 1_000_000
#: Bytes of the chunks that a task remembers, with what one entry takes besides, and the longest chunk that it remembers.
CACHE_BYTES, ENTRY_BYTES, CACHE_CHARS = 64 << 20, 200, 48
#: Characters of a text, and of one chunk, that are solved at once; ids in a batch that leaves a task.
PART_CHARS, WINDOW_CHARS, BATCH_IDS = 1 << 16, 1 << 14, 1 << 18
#: Integer units of a score; log odds of an unknown character against the rarest piece.
SCALE, UNKNOWN_MARGIN = 1 << 20, 10.0

_CHUNK = re.compile(" *[^ ]+| +")


def merge_ranks(scores: list[float]) -> bool:
    """Whether scores are ranks of merges: their probabilities would sum to nothing like one."""
    return bool(scores) and abs(math.log(max(math.fsum(map(math.exp, scores)), 1e-300))) > 1


def zipf_scores(n: int) -> list[float]:
    """Log-probabilities of n pieces by Zipf's law."""
    total = math.log(math.fsum(1 / r for r in range(1, n + 1))) if n else 0.0
    return [-math.log(r) - total for r in range(1, n + 1)]


class Vocabulary:
    """Plain data: (piece, score in units, id) of matched pieces, ids of bytes, bytes of every id."""

    def __init__(self, pieces: list[tuple[str, int, int]], byte_ids: list[int], size: int):
        if size > MAX_PIECES:
            raise ValueError(f"{size} pieces; {MAX_PIECES} at most")
        self.pieces, self.byte_ids, self.size = pieces, byte_ids, size

    @classmethod
    def load(cls, model: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if sp.unk_id() in byte_ids:
            raise ValueError("the model has no byte pieces")
        ids = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        own = [float(sp.get_score(i)) for i in ids]
        scores = zipf_scores(len(ids)) if merge_ranks(own) else own
        pieces = [(sp.id_to_piece(i).replace(MARK, " "), round(x * SCALE), i) for i, x in zip(ids, scores)]
        return cls(pieces, byte_ids, n)

    def bytes_of(self) -> list[bytes]:
        out = [b""] * self.size
        for piece, _, i in self.pieces:
            out[i] = piece.encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score, i in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.byte_ids = vocabulary.byte_ids
        self.longest = max((len(p) for p, _, _ in vocabulary.pieces), default=1)
        self.unknown = min((s for _, s, _ in vocabulary.pieces), default=0) - round(UNKNOWN_MARGIN * SCALE)
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _relax(self, text: str) -> tuple[list[int], list[int]]:
        """For each end of a segmentation: length and id of its last piece (-1: a character without a piece)."""
        n = len(text)
        best = [0] + [-(1 << 60)] * n
        size, piece = [0] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(text):
            for end, (k, score, i) in self.automaton.iter(text):
                end += 1
                total = best[end - k] + score
                if total > best[end]:
                    best[end], size[end], piece[end] = total, k, i
            return size, piece
        settled = 0  # up to here, characters without a piece have been considered
        for end, (k, score, i) in self.automaton.iter(text):
            while settled < end:
                self._fall_back(text, settled, best, size, piece)
                settled += 1
            end += 1
            total = best[end - k] + score
            if total > best[end]:
                best[end], size[end], piece[end] = total, k, i
        while settled < n:
            self._fall_back(text, settled, best, size, piece)
            settled += 1
        return size, piece

    def _fall_back(self, text: str, at: int, best: list, size: list, piece: list) -> None:
        if text[at] not in self.single and best[at] + self.unknown > best[at + 1]:
            best[at + 1], size[at + 1], piece[at + 1] = best[at] + self.unknown, 1, -1

    def _trace(self, text: str, at: int, size: list[int], piece: list[int]) -> list[int]:
        out: list[int] = []
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            at -= size[at]
        out.reverse()
        return out

    def chunk(self, text: str) -> array:
        """The best ids of one chunk; a long one window by window."""
        out, done, width = array("i"), 0, WINDOW_CHARS
        while len(text) - done > width:
            part = text[done : done + width]
            size, piece = self._relax(part)
            # The best segmentation ends a piece at one of the last positions: where their paths meet is settled.
            ends = set(range(max(0, width - self.longest + 1), width + 1))
            while len(ends) > 1:
                last = max(ends)
                ends.remove(last)
                ends.add(last - size[last])
            if met := ends.pop():
                out.extend(self._trace(part, met, size, piece))
                done, width = done + met, WINDOW_CHARS
            else:
                width *= 2
        part = text[done:]
        out.extend(self._trace(part, len(part), *self._relax(part)))
        return out

    def _solved(self, chunk: str) -> bytes:
        ids = self.chunk(chunk).tobytes()
        if len(chunk) <= CACHE_CHARS:
            self.cached += len(chunk) + len(ids) + ENTRY_BYTES
            if self.cached > CACHE_BYTES:
                self.cache.clear()
                self.cached = 0
            self.cache[chunk] = ids
        return ids

    def parts(self, text: str) -> Iterator[tuple[str, bytes]]:
        """(characters, ids as native 32-bit integers) of the text, part by part, a mark before the first, as the models expect."""
        if not text:
            return
        cache, solve = self.cache.get, self._solved
        at, n, mark = 0, len(text), " "
        while at < n:
            end = at + PART_CHARS
            if end < n:  # cut before a run of blanks
                end = text.find(" ", end)
                while end > 0 and text[end - 1] == " ":
                    end -= 1
                end = end if end > at else n
            part = mark + text[at:end]
            yield part, b"".join([cache(c) or solve(c) for c in _CHUNK.findall(part)])
            at, mark = end, ""

    def encode(self, text: str) -> bytes:
        return b"".join([ids for _, ids in self.parts(text)])


def decode_ids(ids: list[int], table: list[bytes], marked: bool = True) -> bytes:
    """The bytes that ids stand for, without the mark that was set before the text (``marked``)."""
    return b"".join([table[i] for i in ids])[1 if marked else 0 :]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, ids array<int>)."""
    vocabulary = Vocabulary.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            first, held, size = 0, [], 0
            for row, x in enumerate(batch.column(1), 1):
                x = x.as_py()
                held.append(None if x is None else np.frombuffer(encoder.encode(x), np.int32))
                size += 0 if x is None else len(held[-1])
                if size >= BATCH_IDS or row == batch.num_rows:
                    ids = pa.array(held, pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, row - first), ids], names=["doc_id", "ids"])
                    first, held, size = row, [], 0

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>").withColumnRenamed("doc_id", doc_id)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, text)."""
    table = Vocabulary.load(model).bytes_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, table).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string").withColumnRenamed("doc_id", doc_id)


def encode_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, n_pieces, ids_sha256 of the ids as little-endian 32-bit integers, round_trip): encoded, decoded, compared."""
    vocabulary = Vocabulary.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder(vocabulary), vocabulary.bytes_of()
        for batch in batches:
            n: list[int | None] = []
            digest: list[str | None] = []
            same: list[bool | None] = []
            for x in batch.column(1):
                x = x.as_py()
                if x is None:
                    n.append(None), digest.append(None), same.append(None)
                    continue
                total, told, equal, at = 0, hashlib.sha256(), True, 0
                for part, raw in encoder.parts(x):
                    ids = np.frombuffer(raw, np.int32)
                    total += len(ids)
                    told.update(ids.astype("<i4").tobytes())
                    upto = at + len(part) - (at == 0)
                    equal &= decode_ids(ids.tolist(), table, at == 0) == x[at:upto].encode()
                    at = upto
                n.append(total), digest.append(told.hexdigest()), same.append(equal and at == len(x))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")
    return out.withColumnRenamed("doc_id", doc_id)
