"""SimHash near-duplicates by anchor points of a covering code.

Two blocks of 23 bits each have the binary Golay code as anchors: every block lies within 3 bits of exactly one codeword. A
fingerprint is at home at its own pair of codewords and is replicated to every pair within covering radius plus
threshold; fingerprints at home at an anchor are compared with those replicated to it. An anchor at home to many
fingerprints instead links them through their neighbours at distance 1: two fingerprints within 2 bits share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import connected_components, cut, dealt, freed, least_of_each
from .shingles import shingle_hashes

#: Fixed value: generator polynomial of the binary Golay code, degree 11.
GOLAY = 0b101011100011
BITS, CHECK, RADIUS = 23, 11, 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, signed; zero without words. Words end at blank, tab, line feed, vertical tab, form feed or return."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (bigint), h (a hash of id and text that tells rows of one id apart); a row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], type=pa.int64()), b.column(2)], names=["doc_id", "fp", "h"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(id, text).alias("h"))
    return rows.mapInArrow(freed(run), "doc_id long, fp long, h long")


@lru_cache(maxsize=2)
def _coset_patterns(excess: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each excess 0..excess, the error patterns that lead from a word to codewords, by the word's syndrome.

    Excess 0 holds the one pattern of at most RADIUS bits, excess k those of RADIUS + k bits: as starts and patterns in
    the order of syndromes.
    """
    bit = []
    for k in range(BITS):
        r = 1 << k
        for j in range(BITS - 1, CHECK - 1, -1):
            if r >> j & 1:
                r ^= GOLAY << (j - CHECK)
        bit.append(r)
    starts, patterns = [], []
    for e in range(excess + 1):
        found: list[list[int]] = [[] for _ in range(1 << CHECK)]
        for w in range(0 if e == 0 else RADIUS + e, RADIUS + e + 1):
            for c in combinations(range(BITS), w):
                s = x = 0
                for k in c:
                    s ^= bit[k]
                    x |= 1 << k
                found[s].append(x)
        starts.append(np.cumsum([0, *map(len, found)]))
        patterns.append(np.array([x for f in found for x in f], dtype=np.int64))
    return starts, patterns


def _syndrome(words: np.ndarray) -> np.ndarray:
    r = words.copy()
    for j in range(BITS - 1, CHECK - 1, -1):
        r ^= np.where(r >> j & 1, GOLAY << (j - CHECK), 0)
    return r


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, anchor and whether the fingerprint is at home there, for every anchor that a fingerprint goes to."""
    starts, patterns = _coset_patterns(threshold)
    mask = (1 << BITS) - 1
    a, b = fps & mask, (fps >> BITS) & mask
    sa, sb = _syndrome(a), _syndrome(b)
    rows, keys, home = [], [], []
    for i in range(threshold + 1):
        for j in range(threshold + 1 - i):
            na, nb = (starts[i][sa + 1] - starts[i][sa]), (starts[j][sb + 1] - starts[j][sb])
            n = na * nb
            r = np.repeat(np.arange(len(fps)), n)
            k = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            ka, kb = np.divmod(k, nb[r]) if len(r) else (k, k)
            ca = (a[r] ^ patterns[i][starts[i][sa[r]] + ka]) >> CHECK
            cb = (b[r] ^ patterns[j][starts[j][sb[r]] + kb]) >> CHECK
            rows.append(r)
            keys.append(ca << (BITS - CHECK) | cb)
            home.append(np.full(len(r), i + j == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def links(fps: DataFrame, threshold: int = 2, *, crowd: int = 64) -> DataFrame:
    """Pairs (a, b) that connect distinct fingerprints (column fp) exactly as all pairs within threshold bits would.

    Pairs of an anchor at home to more than ``crowd`` fingerprints are not compared: its fingerprints are linked by
    the points halfway between them, which needs an even threshold of 2 (others are compared always).
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy()
            for k in range(0, len(x), 4096):
                part = x[k : k + 4096]
                r, key, home = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[r])], names=["anchor", "g"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy()
            r, key, _ = anchors(x, 0)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(x[r])], names=["anchor", "f"])

    nodes = fps.select("fp")
    homes = cut(nodes.mapInArrow(freed(at_home), "anchor int, f long"))
    crowds = homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (crowd if threshold == 2 else 1 << 62)).select("anchor", F.lit(True).alias("crowded"))
    calm = homes.join(crowds, "anchor", "left_anti").select("anchor", "f", F.lit(False).alias("crowded"))
    at = calm.unionByName(crowds.select("anchor", F.lit(None).cast("long").alias("f"), "crowded"))
    near = (F.col("f") < F.col("g")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= threshold)
    met = nodes.mapInArrow(freed(spread), "anchor int, g long").alias("r").join(at.alias("h"), (F.col("r.anchor") == F.col("h.anchor")) & (F.col("crowded") | near)).select("f", "g")
    met = cut(met)
    pairs = met.filter("f is not null").select(F.col("f").alias("a"), F.col("g").alias("b"))
    dense = met.filter("f is null").select("g").distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    points = dense.select("g", F.explode(F.transform(steps, lambda s: F.col("g").bitwiseXOR(s))).alias("point"))
    least = dealt(points.groupBy("point").agg(F.min("g").alias("m"), F.max("g").alias("top")).filter("m < top").select("point", "m"))
    stars = points.join(least, "point").filter("g <> m").select(F.col("m").alias("a"), F.col("g").alias("b")).distinct()
    return pairs.unionByName(stars).distinct()


def classes(rows: DataFrame, threshold: int = 2) -> DataFrame:
    """fp, node, component_id of each distinct fingerprint of rows (doc_id, fp): smallest doc_id reachable by links."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(nodes, threshold))
    named = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("node"))
    least = dealt(named.groupBy("node").agg(F.min("least").alias("component_id")))
    return named.select("fp", "node").join(least, "node")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id; a row for each input row.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Null ids are not chosen as
    component_id unless a component has no other. Repeated rows are repeated in the result.
    """
    rows = cut(fingerprints(docs, id=id, text=text))
    found = classes(rows, threshold)
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(docs: DataFrame, rows: DataFrame, similarity: float, threshold: int, *, id: str, text: str, shingle: int) -> DataFrame:
    """fp, node: the component of each distinct set of shingles by links of at least this Jaccard similarity, exactly.

    Fingerprints within the threshold at a common anchor are candidates. Bits alone cannot tell the rest (at a similarity of
    0.8 some ten of 64 differ): the prefix filter of ``shingles`` has all of them, and each candidate is verified by its whole
    text.
    """
    nodes = shingles.nodes(docs, rows, similarity, id=id, text=text, shingle=shingle)
    prints = cut(nodes.groupBy("bits").agg(F.min("node").alias("least")))
    same = nodes.join(dealt(prints), "bits").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    met = links(prints.select(F.col("bits").alias("fp")), threshold)
    a, b = prints.select(F.col("bits").alias("a"), F.col("least").alias("x")), prints.select(F.col("bits").alias("b"), F.col("least").alias("y"))
    near = cut(same.unionByName(met.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())
    found = connected_components(shingles.links(docs, nodes, near, similarity, id=id, text=text, shingle=shingle))
    by = nodes.select("fp", "node").join(found.select("node", "component"), "node", "left").select("fp", F.coalesce("component", "node").alias("node"))
    wordless = rows.filter("n = 0").select("fp").distinct().select("fp", F.lit(-1).cast("long").alias("node"))  # one set: that of none
    return by.unionByName(wordless)


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 2, similarity: float | None = None) -> DataFrame:
    """The rows of docs that stay when one document of each component is kept: that of the smallest id, all columns as they are.

    Texts are linked by fingerprints within ``threshold`` bits or, with ``similarity``, by sets of shingles of that Jaccard
    similarity and more. Texts without words are alike. Of several rows with one id, the one of the least text hash stays,
    and one of several equal rows. A component whose ids are all null keeps one row of these. Columns of any name pass through.
    """
    if similarity is None:
        rows = cut(fingerprints(docs, id=id, text=text, shingle=shingle))
        return least_of_each(docs, rows, classes(rows, threshold), id=id, text=text)
    rows = cut(shingles.prefixes(docs, similarity, fingerprint_of, id=id, text=text, shingle=shingle))
    found = similar(docs, rows, similarity, threshold, id=id, text=text, shingle=shingle)
    return least_of_each(docs, rows, found, id=id, text=text)
