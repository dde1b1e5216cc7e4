"""SentencePiece encoding and decoding by forward scores over a trie of marked words.

A batch's distinct marked words are sorted, which lays them out as a trie in depth-first order; the forward state of each
prefix is computed once and reused by every word below it. For a unigram vocabulary the state is the best score and its
last piece. A merge vocabulary (BPE) has no sum of scores to maximise: there the state is the one last piece of the
prefix's own encoding, and a piece extends it if merging the two together would keep them apart.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

MARK = "▁"
#: Piece types and model types of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, MERGES = 1, 2


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            value = buf[at : at + n]
            at += n
        yield key >> 3, value


class Vocabulary:
    """A SentencePiece model file: its pieces and how it encodes. The last batch's words are remembered up to a bound."""

    def __init__(self, model: bytes, most: int = 600_000):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        for f, v in _fields(model):
            if f == 1:
                m = dict(_fields(v))
                self.pieces.append((m.get(1, b"").decode(), struct.unpack("<f", m[2])[0] if 2 in m else 0.0, m.get(3, NORMAL)))
            elif f == 2:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                m = dict(_fields(v))
                self.prefix, self.squeeze, charsmap = bool(m.get(3, 1)), bool(m.get(4, 1)), m.get(2, b"")
        if self.kind not in (UNIGRAM, MERGES) or any(k == USER for _, _, k in self.pieces):
            raise ValueError("only unigram and merge models without user-defined symbols are read")
        self.own = None
        if charsmap or self.squeeze:  # texts are then normalised by the library's own rules
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.score = [s for _, s, _ in self.pieces]
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.low = min((self.score[i] for i in self.ids.values()), default=0.0) - 10
        # text is cut before each run of marks, and around line feeds if no longer piece holds one
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        feeds = any("\n" in p and len(p) > 1 for p in self.ids)
        self.unit = re.compile(r"(?s).+" if crossing else rf"{MARK}*[^{MARK}]+|{MARK}+" if feeds else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.as_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        self.most, self.known, self.apart = most, {}, {}

    def units(self, text: str) -> list[str]:
        if self.own is not None:
            marked = self.own.normalize(text)
        else:
            marked = (MARK if self.prefix and text else "") + text.replace(" ", MARK)
        return self.unit.findall(marked)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        docs = [self.units(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        new = {u for d in docs for u in d}.difference(self.known)
        for u, ids in self._forward(sorted(new)):
            self.known[u] = np.array(ids, dtype="<i4").tobytes()
        return [b"".join(map(self.known.__getitem__, d)) for d in docs]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters. Unknown ids raise."""
        out = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out

    def _forward(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each of the sorted words. A state is (start, piece id or -1 for an unknown character, score)."""
        before, states = "", [(0, -2, 0.0)]
        for w in words:
            same = 0
            for a, b in zip(before, w):
                if a != b:
                    break
                same += 1
            del states[same + 1 :]
            for end in range(same + 1, len(w) + 1):
                states.append(self._last(w, end, states))
            out: list[int] = []
            at = len(w)
            while at:
                start, piece, _ = states[at]
                if piece >= 0:
                    out.append(piece)
                else:
                    out.extend(reversed([self.bytes[b] for b in w[start:at].encode()] if self.bytes else [self.unknown]))
                at = start
            yield w, out[::-1]
            before = w

    def _last(self, w: str, end: int, states: list[tuple[int, int, float]]) -> tuple[int, int, float]:
        if self.kind == UNIGRAM:
            best = (end - 1, -1, states[end - 1][2] + self.low)
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(w[start:end])
                if i is not None and (v := states[start][2] + self.score[i]) > best[2]:
                    best = (start, i, v)
            return best
        for start in range(max(0, end - self.longest), end):
            i = self.ids.get(w[start:end])
            if i is not None and self._keeps(states[start][1], i):
                return start, i, 0.0
        return end - 1, -1, 0.0

    def _keeps(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b gives just these; a < 0: b alone."""
        key = a * len(self.pieces) + b if a >= 0 else -1 - b
        if (v := self.apart.get(key)) is None:
            if len(self.apart) > 1_000_000:
                self.apart = {}
            p = self.pieces[b][0]
            v = self.apart[key] = self._merged(p if a < 0 else self.pieces[a][0] + p) == ([p] if a < 0 else [self.pieces[a][0], p])
        return v

    def _merged(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.score[i] > best:
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encode(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row; null and empty texts have no ids, repeated rows are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            at = 0
            for texts in chunks(t.as_py() or "" for t in b.column(1)):
                got = v.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), ids], names=["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, *, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else v.decode(x) for x in (x.as_py() for x in b.column(1))], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), ids, same (whether decoding gives the text) of every row.

    A null text counts as empty. Texts that hold U+2581 decode to blanks there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            at = 0
            for texts in chunks(t.as_py() or "" for t in b.column(1)):
                got = v.encode(texts)
                arrays = [np.frombuffer(x, "<i4") for x in got]
                offsets = np.concatenate([[0], np.cumsum(list(map(len, arrays)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)), pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(x) for x in got], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<i4"))), pa.array([v.decode(a.tolist()) == t for a, t in zip(arrays, texts)]),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "ids", "same"],
                )
                at += len(texts)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, ids array<int>, same boolean")
