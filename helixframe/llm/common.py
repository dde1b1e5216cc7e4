"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset a folder of our own is set on one machine, as in
    tests, while a cluster, whose executors could not read it, is an error. The shuffle files that made df go with the job: from
    here on only the checkpoint is read.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "helixframe-checkpoints"))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under this setting
    finally:
        spark.conf.set(CLEANUP, before)


def release(*frames: DataFrame) -> None:
    """Removes the files of results of ``cut`` that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that no given column has, whatever its case: the wanted ones, with marks in front as needed."""
    taken = {c.lower() for c in columns}
    mark = "__"
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


#: Bits for each key of a sieve, and the keys up to which it is made: beyond, rows are matched by a shuffle.
SIEVE_BITS, SIEVE_KEYS = 4, 1 << 26


def sieve(rows: DataFrame, keys: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """The rows whose hash ``column`` is among the distinct hashes ``key`` of keys, and others by chance, of which few.

    A bitmap of SIEVE_BITS bits and more for each key, as a table of words that is broadcast: an eighth of a byte a bit, so
    SIEVE_KEYS keys at most, 64 MB. With more keys the rows that match are found by a join instead.
    """
    key = key or column
    n = keys.count()
    if n > SIEVE_KEYS:
        found = keys.select(F.col(key).alias("__sieve")).distinct()
        return rows.join(found, F.col(column) == F.col("__sieve"), "left_semi")
    size = max(1 << 10, 1 << (SIEVE_BITS * n).bit_length())
    bit = lambda c: F.pmod(F.col(c), F.lit(size))
    word = lambda c: F.floor(bit(c) / 64).cast("int")
    place = lambda c: F.pmod(F.col(c), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place(key))
    words = keys.groupBy(word(key).alias("__word")).agg(F.bit_or(one).alias("__bits"))
    hit = F.call_function("shiftright", F.col("__bits"), place(column)).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(words), word(column) == F.col("__word")).filter(hit).drop("__word", "__bits")


def dealt(df: DataFrame) -> DataFrame:
    """df dealt evenly, so that a join on the key it was grouped by shuffles both its sides.

    Adaptive execution splits a hot key only in a join of two shuffles; a side that stands grouped by the key has none.
    """
    return df.hint("rebalance")  # as many tasks as its size asks for


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with Arrow's spare memory given back at the end of a task: a worker would hold it while it waits for another."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns ``node``, ``component``.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) as joins and grouped minima, so that no neighbour
    list is ever gathered: a node with very many neighbours is a hot join key, which adaptive execution splits, and its
    minimum is combined before the shuffle. Each round is checkpointed, and the one before it removed. Edges with a null end and loops are ignored; an
    empty input gives an empty result.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
        .distinct()
    )
    e = cut(e)
    seen = None
    for _ in range(max_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = dealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.filter("lo <> hi").distinct()
        # small-star: every node points to the least of its smaller neighbours
        least = dealt(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").select(F.col("m").alias("x"), F.col("lo"), F.col("hi"))
        small = small.select("x", F.explode(F.array("lo", "hi")).alias("hi")).filter("x <> hi").select(F.col("x").alias("lo"), "hi").distinct()
        new = cut(small)
        release(e)
        e = new
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("lo", "hi").cast("long")), F.max(F.xxhash64("lo", "hi"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def least_of_each(docs: DataFrame, rows: DataFrame, found: DataFrame, *, id: str, text: str) -> DataFrame:
    """The rows of docs that stay when each class keeps one: that of the smallest id, all columns as they are.

    ``rows`` has doc_id, h (a hash of id and text) and fp of each row of docs, ``found`` the class (node) of each fp. Of several
    rows with the id, the one of the least hash stays, and one of several equal rows; null ids come last. Both steps towards
    the least are combined before their shuffles.
    """
    low = F.lit(-(1 << 63))
    i, h, k_i, k_h, nth = spare(docs.columns, "id", "h", "k_id", "k_h", "nth")
    by_print = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    kept = by_print.join(found, "fp").groupBy("node").agg(F.min("k").alias("k")).select(F.coalesce("k.doc_id", low).alias(k_i), F.col("k.h").alias(k_h))
    keyed = docs.withColumn(i, F.coalesce(F.col(id).cast("long"), low)).withColumn(h, F.xxhash64(id, text))
    got = keyed.join(cut(kept), (F.col(i) == F.col(k_i)) & (F.col(h) == F.col(k_h)))
    once = got.withColumn(nth, F.row_number().over(Window.partitionBy(i, h).orderBy(F.lit(1)))).filter(F.col(nth) == 1)
    return once.select(*docs.columns)
