"""Language identification: script ranges narrow a word's candidates, then Viterbi over per-word scores with a penalty for
each switch labels the spans of a text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freed, release
from .words import chunks, trigrams

WORD = re.compile(r"[^\W\d_]+")
#: First and last code point of the letters of scripts, from the Unicode block list.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = sorted({s for s, _, _ in SCRIPTS})
#: Least log posterior of a language that a word can be of, and what stands for one that lacks the word's script: less than
#: any path loses by two switches.
FLOOR, BARRED = -8.0, -100.0


def scripts_of(words: list[str]) -> np.ndarray:
    """The script number of each word's first letter, -1 if none of SCRIPTS."""
    c = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    out = np.full(len(words), -1)
    for name, a, b in SCRIPTS:
        out[(c >= a) & (c <= b)] = NAMES.index(name)
    return out


@dataclass
class Model:
    """Log probabilities of hashed trigrams by language, and the scripts that each language is written in."""

    langs: list[str]
    logs: np.ndarray
    written: np.ndarray
    switch: float = 12.0
    rows: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"rows": {}, "scores": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log posterior of each language for each word, at least FLOOR, among those written in the word's script; BARRED for the
        others. A word whose script no language has can be of any."""
        low = [w.lower() for w in words]
        n, at = trigrams(low, self.logs.shape[0])
        first = np.concatenate([[0], np.flatnonzero(np.diff(n)) + 1])
        e = np.add.reduceat(self.logs[at], first, axis=0)
        s = scripts_of(low)
        can = np.where((s >= 0)[:, None], self.written[s], True)
        can = can | ~can.any(axis=1, keepdims=True)
        e = np.where(can, e, -np.inf)
        top = e.max(axis=1, keepdims=True)
        e = e - top - np.log(np.exp(e - top).sum(axis=1, keepdims=True))
        return np.where(can, np.maximum(e, FLOOR), BARRED).astype(np.float32)

    def forget(self) -> None:
        """Drops what is remembered of words: the model itself stays with a worker after its task."""
        self.rows, self.scores = {}, None

    def rows_of(self, words: list[str], most: int = 1_200_000) -> np.ndarray:
        """Rows of self.scores for the words; what is remembered of earlier words is bounded to ``most`` scores."""
        if len(self.rows) * len(self.langs) > most:
            self.rows, self.scores = {}, None
        new = [w for w in set(words) if w not in self.rows]
        if new:
            e = np.concatenate([self.word_scores(new[k : k + 50_000]) for k in range(0, len(new), 50_000)])
            start = len(self.rows)
            self.scores = e if self.scores is None or not start else np.concatenate([self.scores[:start], e])
            self.rows.update(zip(new, range(start, start + len(new))))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def label(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The language number of every word of every document, by Viterbi; ties go to the earlier language."""
        out = [np.zeros(len(d), np.int64) for d in docs]
        full = [i for i, d in enumerate(docs) if d]
        if not full:
            return out
        at = self.rows_of([w for i in full for w in docs[i]])
        e = self.scores[at].astype(np.float64)
        sizes = np.array([len(docs[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        main = np.add.reduceat(e, starts, axis=0).argmax(axis=1)
        # No path beats one language throughout if no stretch of words gains more than a switch costs in any other, and the
        # first and the last stretch together do not: a path of s switches has s - 1 stretches between these two. Sums
        # over stretches are differences of running sums.
        gain = e - np.take_along_axis(e, np.repeat(main, sizes)[:, None], axis=1)
        run = np.cumsum(gain, axis=0) - np.repeat(np.arange(len(full)) * (2 * -BARRED * (sizes.max() + 1)), sizes)[:, None]
        best = np.maximum.reduceat(run - np.minimum.accumulate(run - gain, axis=0), starts, axis=0)
        before, after = (run - gain)[starts], run[starts + sizes - 1]
        head = (np.maximum.reduceat(run, starts, axis=0) - before).max(axis=1)
        tail = (after - np.minimum.reduceat(run - gain, starts, axis=0)).max(axis=1)
        sure = (best <= self.switch).all(axis=1) & (np.maximum(head, 0) + np.maximum(tail, 0) <= self.switch)
        for k, i in enumerate(full):
            out[i][:] = main[k] if sure[k] else self._viterbi(e[starts[k] : starts[k] + sizes[k]])
        return out

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        n, k = e.shape
        back = np.empty((n, k), np.int32)
        own = np.arange(k)
        d = e[0].copy()
        for t in range(1, n):
            b = int(d.argmax())
            jump = d[b] - self.switch
            back[t] = np.where(d >= jump, own, b)
            d = np.maximum(d, jump) + e[t]
        path = np.empty(n, np.int64)
        path[-1] = d.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", dims: int = 1 << 15, smooth: float = 0.05, least_share: float = 0.01, max_langs: int = 1000) -> Model:
    """Counts the trigrams and scripts of all rows whose text and lang are not null.

    What reaches the driver, and is sent to the tasks, is one number for each language and bucket (dims of them); more than
    ``max_langs`` different languages are an error. Without such rows the model knows no language, and every text is ``und``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(dims + len(NAMES) + 1, np.int64))

        def flush() -> pa.RecordBatch:
            rows = [(k, np.flatnonzero(v), v) for k, v in sums.items()]
            out = pa.RecordBatch.from_arrays([pa.array([k for k, at, _ in rows for _ in at], pa.string()), pa.array(np.concatenate([at for _, at, _ in rows]).astype(np.int32)), pa.array(np.concatenate([v[at] for _, at, v in rows]))], names=["lang", "bucket", "n"])
            sums.clear()
            return out

        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for t, k in zip(b.column(0), b.column(1).to_pylist()):
                seen[k].update(WORD.findall(t.as_py()))
            for k, words in seen.items():
                if not words:
                    continue
                low = [w.lower() for w in words]
                times = np.fromiter(words.values(), np.int64, len(words))
                n, at = trigrams(low, dims)
                sums[k][:dims] += np.bincount(at, weights=times[n], minlength=dims).astype(np.int64)
                sums[k][dims:] += np.bincount(scripts_of(low) % (len(NAMES) + 1), weights=times, minlength=len(NAMES) + 1).astype(np.int64)
            if len(sums) > 32:
                yield flush()
        if sums:
            yield flush()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sums_ = cut(rows.mapInArrow(freed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    if (n := sums_.select("lang").distinct().count()) > max_langs:
        raise ValueError(f"{n} languages; at most {max_langs} can be told apart")
    got = sums_.toArrow().to_pandas()
    release(sums_)
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), dims + len(NAMES) + 1))
    if langs:
        counts[got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    grams, used = counts[:, :dims], counts[:, dims:-1]
    logs = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * dims))
    return Model(langs, np.ascontiguousarray(logs.T.astype(np.float32)), (used >= least_share * np.maximum(used.sum(axis=1, keepdims=True), 1)).T & (used > 0).T)


def identify(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans of every row.

    ``spans`` has start, end (code points) and lang of each run of words of one language; lang_pred is the language of most
    words (a tie: the first by name) and score the share of words in it. A null text, or one without a letter, is
    ``und`` with score 0 and no spans. Repeated rows are repeated in the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by dims and the number of languages
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            pred, score, spans = [], [], []
            for texts in chunks((t.as_py() or "" for t in b.column(1)), 500_000):
                docs = [[w for w in WORD.findall(t) if w[0].isalpha() or any(map(str.isalpha, w))] for t in texts] if m.langs else [[] for _ in texts]
                for t, words, path in zip(texts, docs, m.label(docs)):
                    if not words:
                        pred.append("und"), score.append(0.0), spans.append([])
                        continue
                    n = np.bincount(path, minlength=len(m.langs))
                    pred.append(m.langs[int(n.argmax())]), score.append(float(n.max() / n.sum()))
                    cuts = np.flatnonzero(np.diff(path)) + 1
                    spans.append(list(_spans(t, words, cuts, path, m.langs)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, spans_type)], names=["doc_id", "lang_pred", "score", "spans"])
        m.forget()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep(docs: DataFrame, model: Model, *, text: str = "text", least_share: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, that have a letter and whose main language has at least ``least_share`` of their words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            mask: list[bool] = []
            for texts in chunks((t.as_py() or "" for t in b.column(at)), 500_000):
                docs = [[w for w in WORD.findall(t) if w[0].isalpha() or any(map(str.isalpha, w))] for t in texts]
                mask.extend(bool(words) and (not m.langs or np.bincount(path).max() >= least_share * len(words)) for words, path in zip(docs, m.label(docs) if m.langs else docs))
            yield b.filter(pa.array(mask, pa.bool_()))
        m.forget()

    return docs.mapInArrow(freed(run), docs.schema)


def _spans(text: str, words: list[str], cuts: np.ndarray, path: np.ndarray, langs: list[str]) -> Iterator[dict]:
    if not len(cuts):
        yield {"start": text.find(words[0]), "end": text.rfind(words[-1]) + len(words[-1]), "lang": langs[path[0]]}
        return
    at = [m.span() for m in WORD.finditer(text) if m[0][0].isalpha() or any(map(str.isalpha, m[0]))]
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
        yield {"start": at[a][0], "end": at[z - 1][1], "lang": langs[path[a]]}


def held_out(id: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves fold on division by folds."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds)) == fold
