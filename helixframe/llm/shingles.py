"""Sets of word shingles and the pairs of them that are similar, exact at every size: what SimHash candidates are verified by.

Shingles have one order for all texts: frequent ones last, else by hash. Two sets of Jaccard similarity s or more, of a and b
shingles, have at least need = s / (1 + s) (a + b) in common, so one that has need - 1 - e at most behind it in either set has
at least e common ones before it: among the shingles that have need - e at least from them on, in both sets, at least e + 1 are
common (prefix filter; Xiao et al., 2008). Sets meet in a join on these, and pairs that have so many in common are verified by
their whole texts. A passage that many texts share stands last in their orders, and so brings only such texts together as hold
little else.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, dealt, freed, release, sieve

LOW = -(1 << 63)
#: A shingle in the prefixes of more sets than this is frequent, and so are others that as many of these sets hold; at most so
#: many, the most frequent, are told apart, in at most so many rounds. The order decides only how many pairs are compared, never
#: which are found.
FREQUENT, MOST_FREQUENT, ROUNDS = 500, 1_000_000, 3
#: The e of the filter: more of it joins more rows and verifies fewer pairs.
SPARE = 4


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text of fewer words is one shingle. A-Z are lower-cased; words end at blank,
    tab, line feed, vertical tab, form feed or return."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct shingles of a text as sorted signed hashes."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def _ratio(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(1000)


def _prefix(n: int, s: Fraction) -> int:
    """How many shingles of a set can bring it together with another, the smallest that is similar enough."""
    return n * (s.denominator - s.numerator) // s.denominator + 1 + SPARE


def prefixes(docs: DataFrame, similarity: float, print_of: Callable[[np.ndarray], int], *, id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, h (a hash of id and text), fp (128 bits of digest of the set), n (its size), bits (print_of all its shingles), p
    (its prefix by hash)."""
    s = _ratio(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            fp, n, bits, p = [], [], [], []
            for t in b.column(1):
                every = shingle_hashes(t.as_py(), shingle)
                one = np.unique(every.view(np.int64))
                fp.append(xxhash.xxh3_128_digest(one.tobytes()))
                n.append(len(one))
                bits.append(print_of(every))
                p.append(one[: _prefix(len(one), s)])
            made = [pa.array(fp, pa.binary()), pa.array(n, pa.int32()), pa.array(bits, pa.int64()), pa.array(p, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], names=["doc_id", "h", "fp", "n", "bits", "p"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(id, text).alias("h"))
    return rows.mapInArrow(freed(run), "doc_id long, h long, fp binary, n int, bits long, p array<long>")


def _texts(docs: DataFrame, keys: DataFrame, id: str, text: str) -> DataFrame:
    """node, text of keys (node, k_id, k_h): each from one row of docs."""
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LOW)).alias("k_id"), F.xxhash64(id, text).alias("k_h"), F.col(text).alias("text"))
    return sieve(rows, keys, "k_h").join(keys, ["k_id", "k_h"]).groupBy("node").agg(F.first("text").alias("text"))


def nodes(docs: DataFrame, rows: DataFrame, similarity: float, *, id: str, text: str, shingle: int) -> DataFrame:
    """node (a number), fp, n, bits, k_id, k_h (one row that has the set) and p of each distinct set that is not empty."""
    s = _ratio(similarity)
    k = F.min(F.struct(F.coalesce("doc_id", F.lit(LOW)).alias("k_id"), F.col("h").alias("k_h"))).alias("k")
    out = rows.filter("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), k, F.first("p").alias("p"))
    out = cut(out.select(F.monotonically_increasing_id().alias("node"), "fp", "n", "bits", "k.k_id", "k.k_h", "p"))
    known = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        often = out.select(F.explode("p").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > FREQUENT)
        new = np.setdiff1d(_top(often), known)
        if not len(new) or len(known) + len(new) > MOST_FREQUENT:
            break
        frequent = docs.sparkSession.createDataFrame(pa.table({"t": pa.array(new)}))
        moved = cut(out.select("node", "k_id", "k_h", F.explode("p").alias("t")).join(F.broadcast(frequent), "t").select("node", "k_id", "k_h").distinct())
        texts = cut(_texts(docs, moved, id, text))
        # what else is frequent in these texts would come next in their orders
        beside = texts.mapInArrow(freed(_repeated(shingle)), "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).filter(F.col("c") > FREQUENT)
        known = np.union1d(np.union1d(known, new), _top(beside))[:MOST_FREQUENT]
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = []
                for t in b.column(1):
                    one = hashes(t.as_py(), shingle)
                    at = np.searchsorted(shared.value, one)
                    late = shared.value[np.minimum(at, len(shared.value) - 1)] == one
                    p.append(np.concatenate([one[~late], one[late]])[: _prefix(len(one), s)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.list_(pa.int64()))], names=["node", "q"])

        again = texts.mapInArrow(freed(run), "node long, q array<long>")
        before, out = out, cut(out.join(again, "node", "left").select("node", "fp", "n", "bits", "k_id", "k_h", F.coalesce("q", "p").alias("p")))
        release(before, moved, texts)
    return out


def _top(counts: DataFrame) -> np.ndarray:
    """The shingles (t) of the greatest counts (c), MOST_FREQUENT at most."""
    return np.array([r["t"] for r in counts.orderBy(F.desc("c"), "t").limit(MOST_FREQUENT).collect()], np.int64)


def _repeated(shingle: int):
    """t, c: the shingles that several texts (column 1) of a batch hold, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [hashes(t.as_py(), shingle) for t in b.column(1)]
            t, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(t[c > 1]), pa.array(c[c > 1].astype(np.int64))], names=["t", "c"])

    return run


def _need(x: str, y: str, s: Fraction) -> Column:
    """How many shingles two sets must have in common."""
    return F.ceil((F.col(f"{x}.n") + F.col(f"{y}.n")) * s.numerator / (s.numerator + s.denominator))


def _met(x: str, y: str, s: Fraction) -> Column:
    """Whether a common shingle at these places counts: enough shingles stand from it on, in both sets."""
    return F.least(F.col(f"{x}.n") - F.col(f"{x}.i"), F.col(f"{y}.n") - F.col(f"{y}.i")) >= _need(x, y, s) - SPARE


def _pairs(met: DataFrame, s: Fraction) -> DataFrame:
    """Of rows (x, y) for each common shingle that counts, the pairs (a, b) that have as many as similar sets must: of those
    that would count at each smaller e, too."""
    after = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) - _need("x", "y", s)
    some = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), _need("x", "y", s).alias("need"), after.alias("after"))
    counts = [F.count_if(F.col("after") >= -e).alias(f"c{e}") for e in range(SPARE + 1)]
    enough = [F.col(f"c{e}") >= F.least(F.col("need"), F.lit(e + 1)) for e in range(SPARE + 1)]
    return some.groupBy("a", "b", "need").agg(*counts).filter(reduce(lambda p, q: p & q, enough)).select("a", "b")


class _Sets:
    """Sets of the texts last seen, of a bounded number of shingles in all."""

    def __init__(self, shingle: int, most: int = 4_000_000):
        self.shingle, self.most, self.size, self.known = shingle, most, 0, OrderedDict()

    def of(self, node: int, text: str) -> np.ndarray:
        if node in self.known:
            self.known.move_to_end(node)
            return self.known[node]
        got = hashes(text, self.shingle)
        self.known[node] = got
        self.size += len(got)
        while self.size > self.most and len(self.known) > 1:
            self.size -= len(self.known.popitem(last=False)[1])
        return got


def _verified(pairs: DataFrame, docs: DataFrame, nodes_: DataFrame, s: Fraction, id: str, text: str, shingle: int) -> DataFrame:
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = cut(nodes_.select("node", "k_id", "k_h").join(need, "node", "left_semi"))
    texts = cut(_texts(docs, keys, id, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(shingle)
        for b in batches:
            ok = []
            for x, y, tx, ty in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                p, q = sets.of(x, tx.as_py()), sets.of(y, ty.as_py())
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common * (s.numerator + s.denominator) >= (len(p) + len(q)) * s.numerator)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    out = cut(both.select("a", "b", "ta", "tb").mapInArrow(freed(run), "a long, b long"))
    release(keys, texts)
    return out


def links(docs: DataFrame, nodes_: DataFrame, more: DataFrame, similarity: float, *, id: str, text: str, shingle: int) -> DataFrame:
    """Pairs (a, b) of nodes of this similarity or more, enough of them to connect what all such pairs would.

    Other candidates (``more``) and, for each shared shingle, its least holder with all others are compared first. What this
    joins is not compared again: only pairs of different components meet in the second join, so a large group of near copies
    is not squared.
    """
    s = _ratio(similarity)
    tokens = nodes_.select("node", "n", F.posexplode("p").alias("i", "t"))
    often = cut(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("t"))
    shared = cut(sieve(tokens, often, "t").join(dealt(often).hint("merge"), "t"))
    release(often)
    least = shared.groupBy("t").agg(F.min(F.struct("node", "n", "i")).alias("x"))
    stars = shared.select("t", F.struct("node", "n", "i").alias("y")).join(dealt(least).hint("merge"), "t").filter("x.node <> y.node").filter(_met("x", "y", s))
    first = cut(_pairs(stars, s).unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    near = _verified(first, docs, nodes_, s, id, text, shingle)
    found = connected_components(near)
    named = cut(shared.join(found.hint("merge"), "node", "left").select("t", "node", "n", "i", F.coalesce("component", "node").alias("c")))
    release(shared)
    mixed = named.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("t")
    left = cut(named.join(dealt(mixed).hint("merge"), "t"))
    release(named)
    second = left.alias("x").join(left.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & _met("x", "y", s))
    second = cut(_pairs(second, s).join(first, ["a", "b"], "left_anti"))
    release(left, first)
    return near if second.isEmpty() else near.unionByName(_verified(second, docs, nodes_, s, id, text, shingle))
