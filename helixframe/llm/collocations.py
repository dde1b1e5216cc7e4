"""Phrase collocations by suffix-sigma: the suffixes of every piece of text, cut after max_n words, are shuffled by language and
first word, sorted in reverse order, and all their prefixes counted with one stack; the parts of phrases are joined afterwards.

A suffix is one key of bytes, ``language\\0word\\0word\\0``, so that prefixes of words are prefixes of bytes, the order is that of
languages, first words and the words behind them, and the prefix of the language alone counts its words. Equal suffixes
of a chunk of texts are counted before the shuffle. Tasks take ranges of the order instead of hashes of the first word, so that
a word with very many suffixes is shared by several tasks; the few prefixes that lie across a boundary are summed afterwards.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, freed, release

#: Bytes of text whose equal suffixes are counted together, and documents at least from which the ranges are taken.
CHUNK, SAMPLE = 5_000_000, 4096
MARK = 0xFF  # no byte of UTF-8: stands between pieces


def _table() -> bytes:
    """Bytes of a text: A-Z to a-z, ends of pieces to MARK, tab to blank, and 0-8 one up, so that 0 is below all of a word."""
    out = bytearray(range(256))
    for c in range(9):
        out[c] = c + 1
    for c in range(ord("A"), ord("Z") + 1):
        out[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = MARK
    out[9] = 32
    return bytes(out)


TABLE = _table()
BACK = bytes([32, *range(9), *range(10, 256)])


def _escape(lang: bytes) -> bytes:
    return lang.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def _unescape(lang: bytes) -> bytes:
    return lang.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1")


def _suffixes(lang: bytes, texts: list[bytes], max_n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The distinct suffixes of the texts as keys in falling order, and their counts."""
    buf = np.frombuffer(bytes([MARK]).join(texts).translate(TABLE), np.uint8)
    mark = buf == MARK
    inside = ~(mark | (buf == 32))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    n = len(starts)
    if not n:
        return
    piece = np.cumsum(mark, dtype=np.int32)[starts]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(buf[inside])])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    distinct = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    # numbers of runs of words, in their order, by doubling; 0 stands for nothing more in the piece
    ranks, made, w = {1: rank[coded.indices.to_numpy()]}, {}, 1
    sizes = {1: len(order) + 1}
    del buf, mark, inside, edge, starts, size, words, coded
    while w < max_n:
        s = max(x for x in ranks if x <= max_n - w)
        more = np.zeros(n, np.int64)
        same = piece[w:] == piece[: n - min(w, n)]
        more[: len(same)][same] = ranks[s][w:][same]
        key = ranks[w] * sizes[s] + more
        if w + s == max_n:
            distinct_keys, counts = np.unique(key, return_counts=True)
            made[w + s] = distinct_keys, w, s
        else:
            distinct_keys, at = np.unique(key, return_inverse=True)
            made[w + s], ranks[w + s], sizes[w + s] = (distinct_keys, w, s), at + 1, len(distinct_keys) + 1
        w += s
    if max_n == 1:
        codes, counts = np.unique(ranks[1], return_counts=True)
    else:
        codes = np.arange(1, len(counts) + 1)
    codes, counts = codes[::-1], counts[::-1]

    def columns(width: int, codes: np.ndarray) -> list[np.ndarray]:
        if width == 1:
            return [codes]
        keys, w, s = made[width]
        x = np.where(codes > 0, keys[np.maximum(codes, 1) - 1], 0)
        return columns(w, x // sizes[s]) + columns(s, x % sizes[s])

    of, empty, zero = (pa.scalar(x, pa.large_binary()) for x in (_escape(lang), b"", b"\0"))
    for at in range(0, len(codes), 100_000):
        parts = [distinct.take(pa.array(c - 1, mask=c == 0)) for c in columns(max_n, codes[at : at + 100_000])]
        yield pc.binary_join_element_wise(of, *parts, empty, zero, null_handling="skip").cast(pa.binary()), counts[at : at + 100_000]


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """Languages and texts, of about ``most`` bytes together."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).cast(pa.binary()), b.column(1).cast(pa.binary())):
            held.setdefault(lang.as_py(), []).append(t := text.as_py())
            size += len(t)
            if size >= most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _dealt(keys: pa.Array, bounds: list[bytes]) -> np.ndarray:
    """The number of bounds that are at most each of the keys, which fall."""
    n = len(keys)
    lo, hi = bisect.bisect_right(bounds, keys[n - 1].as_py()), bisect.bisect_right(bounds, keys[0].as_py())
    out = np.full(n, lo, np.int32)
    for b in bounds[lo:hi]:  # keys at least b come first
        out[: bisect.bisect_right(range(n), 0, key=lambda i: int(keys[i].as_py() < b))] += 1
    return out


def _shared(flat: np.ndarray, offsets: np.ndarray, most: int = 64) -> np.ndarray:
    """How many leading bytes each key but the first has in common with the one before it."""
    a, b = offsets[:-2], offsets[1:-1]
    least = np.minimum(offsets[1:-1] - a, offsets[2:] - b)
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for j in range(most):
        open_ = open_[least[open_] > j]
        open_ = open_[flat[a[open_] + j] == flat[b[open_] + j]]
        if not len(open_):
            break
        out[open_] = j + 1
    for i in open_[least[open_] > most]:  # long words
        x, y = flat[a[i] : a[i] + least[i]], flat[b[i] : b[i] + least[i]]
        differ = x != y
        out[i] = int(differ.argmax()) if differ.any() else least[i]
    return out


class Prefixes:
    """Counts the prefixes of sorted keys; the stack has, for each number of words, the prefix that is open and its count."""

    def __init__(self, max_n: int, least: int) -> None:
        self.levels, self.least = range(1, max_n + 2), least  # the language is the first word
        self.stack: list[list | None] = [None] * (max_n + 1)
        self.last: bytes | None = None
        self.out: list[tuple[bytes, int, int, bool]] = []

    def _close(self, k: int, edge: bool = False) -> None:
        if (top := self.stack[k - 1]) is not None:
            prefix, n, first = top
            if k == 1 or n >= self.least or first or edge:
                self.out.append((prefix, k - 1, n, first or edge))
            self.stack[k - 1] = None

    def add(self, keys: pa.Array, counts: np.ndarray) -> None:
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        flat = np.frombuffer(keys.buffers()[2], np.uint8)[: offsets[-1]]
        zeros = np.concatenate([[0], np.cumsum(flat == 0)])
        words = zeros[offsets[1:]] - zeros[offsets[:-1]]
        head = keys[0].as_py()
        common = 0
        if self.last is not None:
            common = next((i for i, (x, y) in enumerate(zip(self.last, head)) if x != y), min(len(self.last), len(head)))
        common = np.concatenate([[head[:common].count(0)], zeros[offsets[1:-1] + _shared(flat, offsets)] - zeros[offsets[1:-1]]])
        sums = np.concatenate([[0], np.cumsum(counts)])
        for k in self.levels:
            new = np.flatnonzero(common < k)
            if self.stack[k - 1] is not None:
                self.stack[k - 1][1] += int(sums[new[0] if len(new) else len(keys)])
            if not len(new):
                continue
            self._close(k)
            n = sums[np.append(new[1:], len(keys))] - sums[new]
            full = words[new] >= k
            first = self.last is None
            told = full & ((n >= self.least) | (k == 1) | (first & (np.arange(len(new)) == 0)))
            for i in np.flatnonzero(told[:-1]).tolist():
                self.out.append((self._prefix(keys, new[i], k), k - 1, int(n[i]), first and i == 0))
            if full[-1]:
                self.stack[k - 1] = [self._prefix(keys, new[-1], k), int(n[-1]), first and len(new) == 1]
        self.last = keys[len(keys) - 1].as_py()

    @staticmethod
    def _prefix(keys: pa.Array, i: int, k: int) -> bytes:
        return b"\0".join(keys[int(i)].as_py().split(b"\0")[:k])

    def end(self) -> None:
        for k in self.levels:
            self._close(k, edge=True)

    def take(self) -> pa.RecordBatch:
        got, self.out = self.out, []
        langs, phrases = [], []
        for prefix, _, _, _ in got:
            lang, _, phrase = prefix.partition(b"\0")
            langs.append(_unescape(lang)), phrases.append(phrase.translate(BACK))
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.binary()), pa.array([g[1] for g in got], pa.int32()), pa.array(phrases, pa.binary()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.bool_())],
            names=["lang", "k", "phrase", "f", "edge"],
        )


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = 4, least: int = 30, chunk: int = CHUNK) -> DataFrame:
    """lang, k, phrase, f: every phrase of k words, 1 to max_n, with at least ``least`` occurrences; k = 0 has all words of lang."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts in _chunks(batches, chunk):
            for keys, _ in _suffixes(name, texts, max_n):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.arange(0, len(keys), 16)))], names=["key"])

    # where ranges begin: from a few documents, so that the table is not read to the end twice; any bounds give the same result
    n, wanted = rows.count(), max(SAMPLE, 8 * parts)
    some = rows if n <= wanted else rows.sample(wanted / n, seed=7)
    seen = [bytes(r[0]) for r in some.mapInArrow(freed(thin), "key binary").distinct().limit(64 * wanted).collect()]
    seen.sort()
    bounds = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []
    sent = spark.sparkContext.broadcast(bounds)  # one key a partition

    def map_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts in _chunks(batches, chunk):
            for keys, counts in _suffixes(name, texts, max_n):
                yield pa.RecordBatch.from_arrays([pa.array(_dealt(keys, sent.value)), keys, pa.array(counts)], names=["part", "key", "n"])

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Prefixes(max_n, least)
        for b in batches:
            if b.num_rows:
                p.add(b.column(0), b.column(1).to_numpy())
                if len(p.out) > 10_000:
                    yield p.take()
        p.end()
        yield p.take()

    dealt = rows.mapInArrow(freed(map_), "part int, key binary, n long").repartitionById(len(bounds) + 1, F.col("part"))
    counted = cut(dealt.select("key", "n").sortWithinPartitions(F.desc("key")).mapInArrow(freed(reduce_), "lang binary, k int, phrase binary, f long, edge boolean"))
    across = counted.filter("edge").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("k") == 0) | (F.col("f") >= least))
    whole = counted.filter("not edge").select("lang", "k", "phrase", "f").unionByName(across)
    got = cut(whole.select(F.col("lang").cast("string").alias("lang"), "k", F.col("phrase").cast("string").alias("phrase"), "f"))
    release(counted)
    return got


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = 4, least: int = 30, covered: int = 80, top: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language, by score, a, and the phrase's bytes.

    Texts (null: empty) are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into
    words. A phrase of 2 to ``max_n`` words with a >= ``least`` occurrences has the score of its cut of least
    2000000 a / (l + r), floored, of several the one nearest its beginning; l and r count the parts. Phrases
    within a longer one that has ``covered`` hundredths of their occurrences or more are dropped. A null lang is ``und``. Texts without a word, and
    languages without a phrase, have no row; repeated rows count as often as they stand. Other columns of docs do not matter.
    """
    all_ = frequent(docs, text=text, lang=lang, max_n=max_n, least=least, chunk=chunk)
    found = all_.filter("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    cuts = found.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    # a common word is part of very many phrases: the join, of both parts at once, is of two shuffles, whose hot partitions are split
    both = F.explode(F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("at")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("at") + 1, F.col("k") - F.col("at")).alias("part")))).alias("e")
    cuts = cuts.select("lang", "phrase", "a", "at", both).select("lang", "phrase", "a", "at", "e.*")
    of = all_.filter("k >= 1").select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(of.hint("merge"), ["lang", "part"]).drop("part").repartition("lang", "phrase")
    of_first = lambda first: F.max(F.when(F.col("first") == first, F.col("f")))
    cuts = cuts.groupBy("lang", "phrase", "a", "at").agg(of_first(True).alias("l"), of_first(False).alias("r"))
    ratio = F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)")
    score = F.call_function("div", ratio, F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "at", "a", "l", "r")).alias("x"))

    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: part(s, m))))
    inner = found.filter("k >= 3").select("lang", "a", F.explode(runs).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hundred = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(3,0)")
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (hundred("longer", 100) < hundred("x.a", covered)))
    # a language's first rows of each part, then of all parts
    w = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("x.a"), "phrase")
    by_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(F.desc("x.score"), F.desc("x.a"), "phrase")
    first = kept.withColumn("nth", F.row_number().over(by_part)).filter(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
    total = all_.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", *[F.col(f"x.{c}").alias(c) for c in ("a", "l", "r")], "n", F.col("x.score").alias("score"))


def oracle(least: int = 30, covered: int = 80, top: int = 2000) -> str:
    """DuckDB SQL for the query."""
    return rf"""
    with d as (
      select row_number() over () id, coalesce(lang, 'und') lang,
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') ps from documents),
    p as (select id, lang, unnest(range(len(ps))) p, unnest(ps) piece from d),
    q as (select lang, id, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') ws from p),
    o as (select lang, m k, array_to_string(ws[i:i + m - 1], ' ') phrase from (select *, unnest(range(1, len(ws) - m + 2)) i from (select lang, ws, unnest([1, 2, 3, 4]) m from q) where len(ws) >= m)),
    t as (select lang, sum(len(ws))::bigint n from q group by 1),
    f as materialized (select lang, k, phrase, string_split(phrase, ' ') ws, count(*) f from o group by all having count(*) >= {least}),
    c as (select * from f where k >= 2),
    h as (select lang, k, phrase, f a, ws, unnest(range(1, k)) cut_at from c),
    g as (select *, array_to_string(ws[1:cut_at], ' ') lp, array_to_string(ws[cut_at + 1:], ' ') rp from h),
    s as (
      select g.lang, g.phrase, g.a, cut_at, l.f l, r.f r, (2000000::hugeint * g.a) // (l.f::hugeint + r.f) score
      from g join f l on l.lang = g.lang and l.phrase = lp and l.k = cut_at join f r on r.lang = g.lang and r.phrase = rp and r.k = g.k - cut_at),
    b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut_at) = 1),
    i as (
      select lang, sub, max(f) longer
      from (select lang, f, array_to_string(ws[i:i + m - 1], ' ') sub from (select *, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from c where k >= 3)))
      group by all)
    select b.lang, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint score
    from b join t on b.lang = t.lang left join i on i.lang = b.lang and i.sub = b.phrase
    where longer is null or 100::hugeint * longer < {covered}::hugeint * a
    qualify rank <= {top}"""
