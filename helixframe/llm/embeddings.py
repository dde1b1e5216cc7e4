"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into low-dimensional blocks. If two are within squared distance T, then in some block
they are within T times the block's share of the dimensions; each block is range-joined on a grid under that
budget, and the union of what meets is verified exactly.

Crowds are taken out first: around each of a bounded sample of leaders, the vectors within half the linking angle are
linked to one another by the triangle inequality, so they are counted without being paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

BLOCK = 8


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dims: int, seed: int = 42) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def _by_dims(v: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of vectors of each length."""
    n = np.diff(v.offsets.to_numpy())
    for d in np.unique(n):
        yield np.flatnonzero(n == d)


def lead(reps: DataFrame, threshold: float, max_leaders: int) -> DataFrame:
    """rep, own, near: the first leader within half the linking angle (or null), and the other leaders within one and a half.

    The leaders are the at most ``max_leaders`` vectors of least hash; only they reach the driver.
    """
    got = reps.orderBy("k1", "k2").limit(max_leaders).select("rep", "label", "v").collect()
    angle = math.acos(threshold)
    tight, loose = math.cos(angle / 2) + 1e-9, math.cos(min(math.pi, angle * 1.5)) - 1e-9
    groups: dict[tuple, list] = {}
    for r in got:
        groups.setdefault((r["label"], len(r["v"])), []).append((r["rep"], r["v"]))
    leaders = {}
    for k, v in groups.items():
        m = _unit(np.array([b for _, b in v], dtype=np.float64))
        close, kept = m @ m.T >= tight, []
        for i in range(len(m)):  # a leader beside an earlier one would only divide its crowd
            if not close[i, kept].any():
                kept.append(i)
        leaders[k] = np.array([v[i][0] for i in kept]), m[kept]
    shared = reps.sparkSession.sparkContext.broadcast(leaders)  # max_leaders vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            own: list = [None] * b.num_rows
            near: list = [[]] * b.num_rows
            labels = b.column(1).to_pylist()
            for rows in _by_dims(b.column(2)):
                x = _unit(_matrix(b.column(2).take(pa.array(rows))))
                by: dict = {}
                for k, r in enumerate(rows.tolist()):
                    by.setdefault(labels[r], []).append((k, r))
                for label, at in by.items():
                    if (label, x.shape[1]) not in known:
                        continue
                    names, m = known[label, x.shape[1]]
                    c = x[[k for k, _ in at]] @ m.T
                    close = c >= tight
                    first = np.where(close.any(axis=1), close.argmax(axis=1), -1)
                    beside = c >= loose
                    beside[np.arange(len(at)), first] &= first < 0
                    for j, (_, r) in enumerate(at):
                        own[r] = int(names[first[j]]) if first[j] >= 0 else None
                        near[r] = names[beside[j]].tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names=["rep", "own", "near"])

    return reps.select("rep", "label", "v").mapInArrow(run, "rep long, own long, near array<long>")


def meet(singles: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of singles (rep, label, v) of one label and length that some block does not keep apart."""
    far = 2 - 2 * threshold
    names = [f"x{k}" for k in range(BLOCK)]
    schema = "rep long, label int, block int, c0 int, c1 int, dims int, " + ", ".join(f"{n} float" for n in names)

    def spread(steps: list[tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows in _by_dims(b.column(2)):
                    take = pa.array(rows)
                    x = _unit(_matrix(b.column(2).take(take)))
                    dims = x.shape[1]
                    x = x @ rotation(dims)
                    rep, label = b.column(0).take(take), b.column(1).take(take)
                    for k, at in enumerate(range(0, dims, BLOCK)):
                        part = np.zeros((len(x), BLOCK))
                        part[:, : min(BLOCK, dims - at)] = x[:, at : at + BLOCK]
                        width = math.sqrt(far * min(BLOCK, dims - at) / dims) + 1e-6
                        cell = np.floor(part[:, :2] / width).astype(np.int32)
                        for i, j in steps:
                            yield pa.RecordBatch.from_arrays([rep, label, pa.array(np.full(len(x), k, np.int32)), pa.array(cell[:, 0] + np.int32(i)), pa.array(cell[:, 1] + np.int32(j)), pa.array(np.full(len(x), dims, np.int32)), *[pa.array(part[:, c].astype(np.float32)) for c in range(BLOCK)]], names=["rep", "label", "block", "c0", "c1", "dims", *names])

        return singles.select("rep", "label", "v").mapInArrow(run, schema)

    home, probe = spread([(0, 0)]).alias("h"), spread([(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]).alias("p")
    same = [F.col(f"h.{c}") == F.col(f"p.{c}") for c in ("label", "block", "c0", "c1", "dims")]
    share = F.least(F.lit(BLOCK), F.col("h.dims") - BLOCK * F.col("h.block")) / F.col("h.dims")
    apart = reduce(lambda a, b: a + b, [(F.col(f"h.{n}") - F.col(f"p.{n}")) * (F.col(f"h.{n}") - F.col(f"p.{n}")) for n in names])
    both = reduce(lambda a, b: a & b, same) & (F.col("h.rep") != F.col("p.rep")) & (apart <= share * far + 1e-5)
    found = home.join(probe, both).select(F.least("h.rep", "p.rep").alias("a"), F.greatest("h.rep", "p.rep").alias("b"))
    return found.distinct()


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is at least threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _by_dims(b.column(2)):
                t = b.take(pa.array(rows))
                x, y = _matrix(t.column(2)), _matrix(t.column(3))
                ok = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= threshold
                yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(ok)), t.column(1).filter(pa.array(ok))], names=["a", "b"])

    v = reps.select("rep", "v")
    both = pairs.join(v.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
    return both.filter(F.size("va") == F.size("vb")).select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, max_leaders: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows are linked if their labels are equal and not null and their cosine is at least ``threshold`` (over 0). Vectors
    that are null, empty, zero or hold null or non-finite components, and vectors of unequal length, are linked with nothing:
    they are their own component. Rows count one by one, so repeated rows are linked with one another; null ids are
    never a component's id unless it has no other. Of equal vectors one represents all in the joins.
    """
    e = F.col("e")
    good = F.coalesce((F.size("e") > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"), F.col(label).cast("int").alias("label")).withColumn("good", good)
    keys = [F.xxhash64("label", "e").alias("k1"), F.xxhash64(F.lit(7), "e", "label").alias("k2")]  # 128 bits that name a vector
    rows = cut(rows.select("vec_id", "label", "e", "good", *keys))
    # equal vectors are one: its number rests on no hash that two could share, and not on ids, which may repeat
    reps = rows.filter("good").groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("rep"), "label", F.col("e").alias("v"), "least", "times", *keys))
    led = cut(lead(reps, threshold, max_leaders))
    sizes = led.filter("own is not null").join(reps.select("rep", "times"), "rep").groupBy("own").agg(F.sum("times").alias("crowd"))
    singles = reps.join(led.filter("own is null").select("rep"), "rep", "left_semi")
    around = led.select(F.col("rep").alias("x"), F.explode("near").alias("own")).join(led.filter("own is not null").select("own", F.col("rep").alias("z")), "own").filter("x <> z")
    pairs = meet(singles, threshold).unionByName(around.select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b")).distinct()).distinct()
    links = cut(verified(pairs, reps, threshold))
    times = reps.select("rep", "times")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = ends.join(times, ends["b"] == times["rep"]).groupBy("a").agg(F.sum("times").alias("outside"))
    graph = links.unionByName(led.filter("own <> rep").select(F.col("own").alias("a"), F.col("rep").alias("b")))
    found = connected_components(graph).select(F.col("node").alias("rep"), "component")
    full = reps.select("rep", "least", "times", "k1", "k2").join(led.select("rep", "own"), "rep").join(sizes, "own", "left").join(outside, F.col("rep") == F.col("a"), "left").join(found, "rep", "left")
    full = full.select("rep", "least", "k1", "k2", (F.coalesce("crowd", "times") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("node"))
    full = cut(full)
    named = full.join(full.groupBy("node").agg(F.min("least").alias("component_id")), "node").select("k1", "k2", "n_links", "component_id")
    out = rows.select("vec_id", "good", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("good"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle() -> str:
    """DuckDB SQL for the query: every two vectors of a label, and what can be reached by links."""
    return """
    with recursive v as materialized (select vec_id, embedding::double[] e, label from embeddings where embedding is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
 r as (select a n, a m from l union select r.n, l.b from r join l on l.a = r.m),
 c as (select n, min(m) m from r group by 1), k as (select a n, count(*) links from l group by 1)
 select vec_id, coalesce(links, 0) n_links, coalesce(m, vec_id) component_id, vec_id = coalesce(m, vec_id) kept from embeddings left join c on c.n = vec_id left join k on k.n = vec_id"""
