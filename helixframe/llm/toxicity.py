"""Toxicity: noisy-channel deobfuscation, then a classifier on the restored words.

A token that may be disguised (leetspeak, inserted marks, letters set apart, doubled or stretched letters) becomes a lattice of
characters; Viterbi under a character language model of the corpus picks what was meant. Tokens of plain letters have one
path and stay, as they do beside what was restored where a letter is only doubled. The language model counts every trigram
of all documents; the classifier is a logistic regression on character n-grams of the restored words, fitted on a bounded
sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freed, release
from .words import START, STOP, chunks, distinct, ngrams

#: What a mark can stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "#": "h", "(": "c", "€": "e", "£": "l", "¢": "c", "§": "s", "*": "abcdefghijklmnopqrstuvwxyz"}
EDGE = ".,;:?!\"'()[]{}<>…“”‘’«»-_*"
REPEATED = re.compile(r"(.)\1")
#: Trigrams up to which each is counted by itself: 16 bytes each, so 128 MB. Beyond, as many hashed buckets share them.
MOST_TRIGRAMS = 1 << 23
BITS = 21  # of a code point
SUBSTITUTED, DROPPED, JOINED, SPLIT = -1.5, -0.5, -0.2, -3.0


def _fold(key: np.ndarray) -> np.ndarray:
    """A bucket below MOST_TRIGRAMS for a packed trigram or pair."""
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) & (MOST_TRIGRAMS - 1)


@dataclass
class Letters:
    """Character language model: log probability of a character after the two before it, from counts of the corpus.

    ``keys`` are sorted trigrams, three code points packed, or their buckets if ``folded``; pairs likewise.
    """

    keys: np.ndarray
    counts: np.ndarray
    pair_keys: np.ndarray
    pair_counts: np.ndarray
    folded: bool = False
    smooth: float = 0.1
    seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def _count(self, keys: np.ndarray, counts: np.ndarray, key: int) -> int:
        if self.folded:
            key = int(_fold(np.array([key]))[0])
        at = int(np.searchsorted(keys, key))
        return int(counts[at]) if at < len(keys) and keys[at] == key else 0

    def log(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        if (v := self.seen.get(key)) is None:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            pair = ord(a) << BITS | ord(b)
            n, m = self._count(self.keys, self.counts, pair << BITS | ord(c)), self._count(self.pair_keys, self.pair_counts, pair)
            v = self.seen[key] = math.log((n + self.smooth) / (m + self.smooth * 40))
        return v


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_letters(docs: DataFrame, *, text: str = "text", most: int = MOST_TRIGRAMS) -> Letters:
    """Trigram counts over the words of plain letters of all rows, each word with a mark before and behind it.

    The table that reaches the driver grows with the corpus up to ``most`` trigrams; a corpus of more is counted once again in
    that many buckets.
    """

    def counting(folded: bool):
        def trigrams_of(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
            marked = START + (STOP + START).join(words) + STOP
            c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            inside = (c[:-2] != ord(STOP)) & (c[1:-1] != ord(STOP))
            key = (c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])[inside]
            times = np.fromiter(words.values(), np.int64, len(words))
            return key, np.repeat(times, np.fromiter(map(len, words), np.int64, len(words)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(keys: np.ndarray, counts: np.ndarray, kind: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], names=["kind", "key", "n"])

            held = [_summed(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
            for b in batches:
                seen: Counter = Counter()
                for t in b.column(0):
                    seen.update((t.as_py() or "").lower().split())
                plain: Counter = Counter()
                for w, n in seen.items():
                    w = w.strip(EDGE)
                    if w.isalpha():
                        plain[w] += n
                if not plain:
                    continue
                key, n = trigrams_of(plain)
                for kind, k in enumerate((key, key >> BITS)):
                    held[kind] = _summed(np.concatenate([held[kind][0], _fold(k) if folded else k]), np.concatenate([held[kind][1], n]))
                    if len(held[kind][0]) > 500_000:
                        yield out(*held[kind], kind)
                        held[kind] = _summed(np.zeros(0, np.int64), np.zeros(0, np.int64))
            for kind in (0, 1):
                yield out(*held[kind], kind)

        return docs.select(F.col(text).alias("text")).mapInArrow(freed(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))

    table, folded = cut(counting(False)), False
    if table.count() > 2 * most:
        table, folded = cut(counting(True)), True
    got = table.toArrow()  # two tables of ``most`` rows at most
    kind, key, n = (got[c].to_numpy() for c in ("kind", "key", "n"))
    release(table)
    return Letters(*_summed(key[kind == 0], n[kind == 0]), *_summed(key[kind == 1], n[kind == 1]), folded)


def lattice(token: str, apart: bool) -> list[tuple[list[tuple[str, float]], bool]]:
    """Steps of a token: the strings each run of equal characters can stand for with their channel costs, and whether a
    word may end before it. ``apart``: the token's characters stood apart in the text."""
    out = []
    k = 0
    while k < len(token):
        c = token[k]
        n = 1
        while k + n < len(token) and token[k + n] == c:
            n += 1
        if c.isalpha():
            options = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, JOINED)] if n == 2 else [(c, JOINED), (c * 2, JOINED)]
        else:
            options = [(o * m, SUBSTITUTED) for o in LEET.get(c, "") for m in range(1, min(n, 2) + 1)]
            options.append(("", DROPPED if c not in LEET else 3 * SUBSTITUTED if c in "*!|+(" else 10 * SUBSTITUTED))
        out.append((options, apart and k > 0))
        k += n
    return out


def restore(token: str, letters: Letters, apart: bool = False) -> list[str]:
    """The words of the most probable path through the token's lattice. What a path's end can be is two characters, so each
    step keeps one path for each pair that its options allow; ties go to the path whose text comes first."""
    best: dict[tuple[str, str], tuple[float, tuple]] = {(START, START): (0.0, ())}  # what is done is linked, from the end

    def add(a: str, b: str, s: str) -> tuple[float, str, str]:
        v = 0.0
        for c in s:
            v += letters.log(a if b != START else START, b, c) if b != START else _first(c)
            a, b = b, c
        return v, a, b

    def _first(c: str) -> float:
        # the first character's trigram starts at the mark: its share shows with the second
        return -2.5 if c != STOP else -20.0

    for options, may_end in lattice(token, apart):
        now: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (v, done) in best.items():
            starts = [(a, b, v, done)]
            if may_end and b != START:
                starts.append((START, START, v + letters.log(a, b, STOP) + SPLIT, (done, " ")))
            for a2, b2, v2, d2 in starts:
                for s, cost in options:
                    w, x, y = add(a2, b2, s)
                    new = v2 + w + cost
                    if (x, y) not in now or new > now[x, y][0]:  # options come in a fixed order
                        now[x, y] = (new, (d2, s) if s else d2)
        best = now
    ends = [(v + (letters.log(a, b, STOP) if b != START else -20.0), done) for (a, b), (v, done) in best.items()]
    top = max(v for v, _ in ends)
    return max(_text(done) for v, done in ends if v == top).split()


def undoubled(word: str, letters: Letters) -> list[str]:
    """restore of a word of plain letters of which some are doubled: each pair is one letter or stays, whichever is likelier.

    A pair has a share in three trigrams only, so where no letter is repeated more than once and pairs lie apart these
    decide, which takes a twentieth of the time of the lattice; other words go through that.
    """
    m = START + word + STOP
    pairs = [r.start() for r in REPEATED.finditer(m)]
    if any(b - a < 4 for a, b in zip(pairs, pairs[1:])) or any(m[k + 2] == m[k] for k in pairs):
        return restore(word, letters)
    log, last = letters.log, len(m) - 1
    for k in reversed(pairs):
        a, c, d = m[k - 1], m[k], m[k + 2]
        two, one = log(a, c, c) + log(c, c, d), log(a, c, d) + JOINED
        if k + 3 <= last:
            two, one = two + log(c, d, m[k + 3]), one + log(c, d, m[k + 3])
        if one > two:
            m = m[:k] + m[k + 1 :]
            last -= 1
    return [m[1:-1]]


def _text(done: tuple) -> str:
    out = []
    while done:
        done, s = done
        out.append(s)
    return "".join(reversed(out))


def parts(token: str) -> list[str]:
    """What lies between the marks of a token that stand for no letter."""
    return "".join(c if c.isalnum() or c in LEET or unicodedata.category(c)[0] == "M" else " " for c in token).split()


class Reader:
    """Counts, for each text, the words with each hashed n-gram once restored. Remembers a bounded number of tokens.

    With ``only`` the buckets that are marked there alone are counted. A token of over ``long`` characters is read whole and
    by its parts between marks. Tokens without letters are read if a digit or mark of them can stand for one.
    """

    long = 60

    def __init__(self, letters: Letters, dims: int, only: np.ndarray | None = None, sizes: tuple[int, ...] = (4, 5, 6, 7), most: int = 500_000):
        self.letters, self.dims, self.only, self.sizes, self.most = letters, dims, only, sizes, most
        self.known: set[str] = set()
        self.found: dict[str, np.ndarray] = {}  # of the known tokens those with features

    def restored(self, token: str) -> tuple[str, ...]:
        core = token.strip(EDGE)
        if core.isalpha():
            if not REPEATED.search(core):
                return (core,)
            return tuple(dict.fromkeys([core, *undoubled(core, self.letters)]))
        marked = token.rstrip(".,;:?!\"')]}>").lstrip("\"'([{<")
        if not any(c.isalpha() or c in LEET for c in marked):
            return ()
        out = dict.fromkeys(w for t in {core: 0, marked: 0} if t for w in restore(t, self.letters))
        # many words without blanks between them, as a rule: each of them too
        if len(marked) > self.long and len(cut_ := parts(marked)) > 1:
            out |= dict.fromkeys(w for t in dict.fromkeys(cut_) for w in self.restored(t))
        return tuple(out)

    def _features(self, groups: list[tuple[str, ...]]) -> dict[int, np.ndarray]:
        """Buckets of each group of words that has any."""
        of: dict[str, list[int]] = {}
        for k, g in enumerate(groups):
            for w in g:
                of.setdefault(w, []).append(k)
        words = list(of)
        n, at = ngrams(words, self.sizes, self.dims, self.only)
        out: dict[int, np.ndarray] = {}
        for f, first in zip(np.split(at, np.flatnonzero(np.diff(n)) + 1), n[np.concatenate([[True], np.diff(n) > 0])].tolist() if len(n) else []):
            for k in of[words[first]]:
                out[k] = f if k not in out else distinct(np.concatenate([out[k], f]))
        return out

    def read(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The buckets of each text and how many of its words have them."""
        for part in chunks(texts):
            docs = [t.lower().split() for t in part]
            if len(self.known) > self.most:
                self.known, self.found = set(), {}
            new = list(set(chain.from_iterable(docs)) - self.known)
            for k, f in self._features([self.restored(t) for t in new]).items():
                self.found[new[k]] = f
            self.known.update(new)
            found = self.found
            for tokens in docs:
                hits = [found[t] for t in tokens if t in found]
                hits.extend(self._apart(tokens))
                if hits:
                    yield np.unique(np.concatenate(hits), return_counts=True)
                else:
                    yield np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _apart(self, tokens: list[str], least: int = 3) -> Iterator[np.ndarray]:
        """Features of the words that runs of single characters spell."""
        sizes = bytes(map(min, map(len, tokens), repeat(255)))  # the token lengths, to find such runs
        k = sizes.find(b"\1" * least)
        while k >= 0:
            to = k
            while to < len(sizes) and sizes[to] == 1:
                to += 1
            if len(set(tokens[k:to])) > 1:
                words = restore("".join(tokens[k:to]), self.letters, apart=True)
                yield from self._features([(w,) for w in words]).values()
            k = sizes.find(b"\1" * least, to)


@dataclass
class Model:
    letters: Letters
    dims: int
    weights: dict[int, float]
    bias: float


def _marked(buckets: Iterable[int], dims: int) -> np.ndarray:
    out = np.zeros(dims, bool)
    out[list(buckets)] = True
    return out


def newton(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, t: np.ndarray, n_columns: int, *, rounds: int = 12, steps: int = 60, l2: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on a sparse matrix (row, column and value of each entry): Newton steps, each by
    conjugate gradients, so that no matrix of columns by columns is made."""
    n = len(t)
    times = lambda w: np.bincount(rows, weights=values * w[columns], minlength=n)
    back = lambda v: np.bincount(columns, weights=values * v[rows], minlength=n_columns)
    w, bias = np.zeros(n_columns), math.log((t.sum() + 0.5) / (n - t.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w) + bias, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g, gb = back(t - p) - l2 * w, float((t - p).sum())
        if max(np.abs(g).max(initial=0.0), abs(gb)) < 1e-6:
            break
        x, xb = np.zeros(n_columns), 0.0
        r, rb = g.copy(), gb
        d, db = r.copy(), rb
        size = r @ r + rb * rb
        for _ in range(steps):
            xd = times(d) + db
            hd, hb = back(v * xd) + l2 * d, float((v * xd).sum())
            a = size / (d @ hd + db * hb)
            x, xb, r, rb = x + a * d, xb + a * db, r - a * hd, rb - a * hb
            new = r @ r + rb * rb
            if new < 1e-16 * (g @ g + gb * gb):
                break
            d, db, size = r + new / size * d, rb + new / size * db, new
        w, bias = w + x, bias + xb
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, letters: Letters, *, id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 12_000, dims: int = 1 << 18, least_z: float = 4.0, l2: float = 1.0) -> Model:
    """Logistic regression on the logarithm of one plus the count of words with an n-gram, for the n-grams that tell.

    Uses the at most ``max_labelled`` labelled rows of least hashed id (two labels for one id: the larger; null labels and
    ids: left out; of the documents of one id the one of least hashed text), and all hashed n-grams whose mean exceeds that
    among other documents by ``least_z`` of the standard errors that it would have if labels told nothing (score test). Two numbers a label for each of dims buckets, and the chosen
    features of the sample, reach the driver. Without labels of both kinds there are no weights and the bias follows the labels.
    """
    y = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rows = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("text")).join(F.broadcast(y), "__id")  # max_labelled rows
    rows = cut(rows.groupBy("__id").agg(F.min_by(F.struct("text", F.col("y").cast("int").alias("y")), F.xxhash64("text")).alias("r")).select("r.text", "r.y"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    bias = math.log((ones + 0.5) / (n - ones + 0.5))
    if ones in (0, n):
        return Model(letters, dims, {}, bias)
    shared = docs.sparkSession.sparkContext.broadcast(letters)  # bounded by its number of trigrams

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(shared.value, dims)
        s = np.zeros((2, 2, dims))
        for b in batches:
            for (at, n_), v in zip(r.read(t.as_py() or "" for t in b.column(0)), b.column(1).to_pylist()):
                x = np.log1p(n_)
                s[int(v > 0), 0, at] += x
                s[int(v > 0), 1, at] += x * x
        at = np.flatnonzero(s.sum(axis=(0, 1))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(s[i, j, at]) for i in (0, 1) for j in (0, 1)]], names=["f", "s0", "q0", "s1", "q1"])

    per = rows.mapInArrow(freed(sums), "f int, s0 double, q0 double, s1 double, q1 double").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("s0", "q0", "s1", "q1")])
    m0, m1, m = F.col("s0") / (n - ones), F.col("s1") / ones, (F.col("s0") + F.col("s1")) / n
    var = ((F.col("q0") + F.col("q1")) / n - m * m) * (1 / ones + 1 / (n - ones))  # as if both kinds were one
    z = F.round((m1 - m0) / F.sqrt(var), 6)
    top = np.array(sorted(r["f"] for r in per.filter(z > least_z).select("f").collect()), np.int64)  # dims numbers at most

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(shared.value, dims, _marked(top, dims))
        for b in batches:
            found = list(r.read(t.as_py() or "" for t in b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64())), b.column(1)], names=["f", "c", "y"])

    got = rows.mapInArrow(freed(chosen), "f array<long>, c array<long>, y int").collect()  # max_labelled rows at most
    got.sort(key=lambda r: (r["y"], r["f"], r["c"]))  # the sums below do not hang on the order of tasks
    at = np.repeat(np.arange(len(got)), [len(r["f"]) for r in got])
    columns = np.searchsorted(top, np.array([f for r in got for f in r["f"]], np.int64))
    values = np.log1p(np.array([c for r in got for c in r["c"]], np.float64))
    w, bias = newton(at, columns, values, np.array([float(r["y"] > 0) for r in got]), len(top), l2=l2)
    release(rows)
    return Model(letters, dims, dict(zip(top.tolist(), w.tolist())), bias)


def score(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is at least threshold) of every row.

    Null and empty texts, and texts without a known n-gram, score by the bias alone. Repeated rows are repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's number of buckets and features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        r = Reader(m.letters, m.dims, _marked(m.weights, m.dims))
        for b in batches:
            s = []
            for f, c in r.read(t.as_py() or "" for t in b.column(1)):
                v = m.bias + sum(m.weights[k] * math.log1p(j) for k, j in zip(f.tolist(), c.tolist()))
                s.append(1 / (1 + math.exp(-max(-30.0, min(30.0, v)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, score double, predicted int")
