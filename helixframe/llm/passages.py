"""Passages of 50 words or more that stand in an earlier text, wherever they begin and end, word by word.

Every window of 50 words is named by the least hash among its runs of 25 words, so equal windows have equal names: only windows
whose name stands more than once are hashed whole and compared, and no repeat is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import cut, dealt, freed, release, sieve, spare

#: A word holds no white space and no punctuation; in scripts without blanks each character is one.
MARKS = r"!-/:-@\[-`{-~\u00a1\u00ab\u00bb\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20"
ALONE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
WORD = re.compile(rf"[{ALONE}]|[^\s{MARKS}{ALONE}]+")
#: What goes with a removed passage: the marks behind it and blanks.
TAIL = re.compile(rf"[{MARKS}]*[ \t]*")
LOW = -(1 << 63)
ODD = 0x9E3779B97F4A7C15


def _words(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places and 64-bit hashes of the lower-cased words."""
    import xxhash

    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    digest = xxhash.xxh64_intdigest
    return found, np.fromiter((digest(text[a:b].lower().encode("utf-8", "surrogatepass"), 42) for a, b in found), np.uint64, len(found))


def _runs(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of so many words: polynomial, so a column at a time, then mixed."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(ODD)
        out ^= out >> np.uint64(29)
    return out


def _names(h: np.ndarray, width: int) -> np.ndarray:
    """The name of each window of ``width`` words."""
    part = width // 2
    runs = _runs(h, part, 1)
    if len(h) < width:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(runs, width - part + 1).min(axis=1).view(np.int64)


def _mapped(rows: DataFrame, schema: str, each) -> DataFrame:
    """Rows (a, b, and more) by ``each``, which gives arrays of one length for the columns after a and b."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                got = [each(*(c[k].as_py() for c in b.columns[2:])) for k in range(b.num_rows)]
                of = pa.array(np.repeat(np.arange(b.num_rows), [len(g[0]) for g in got]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *(pa.array(np.concatenate(g)) for g in zip(*got))], names=names)

    return rows.mapInArrow(freed(run), schema)


def repeats(keyed: DataFrame, width: int = 50) -> DataFrame:
    """a, b, first, last: ranges of words (last not included) of each row (a, b, text) that are windows of a row of smaller (a, b),
    or before in the same one. What overlaps its own first occurrence begins behind that."""

    def name_rows(text):
        h = _words(text)[1]
        names, windows = _names(h, width), _runs(h, width, 3)
        distinct, first, times = np.unique(windows, return_index=True, return_counts=True)
        unique = np.unique(names)
        return unique, np.isin(unique, names[first[times > 1]])

    def window_rows(text, names):
        h = _words(text)[1]
        at = np.flatnonzero(np.isin(_names(h, width), np.array(names, np.int64))).astype(np.int32)
        return at, _runs(h, width, 3)[at].view(np.int64), _runs(h, width, 5)[at].view(np.int64)

    # windows of one text share names mostly by lying next to each other: only equal ones count as repeats (again)
    names = cut(_mapped(keyed, "a long, b long, name long, again boolean", name_rows))
    shared = cut(names.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("name"))
    mine = cut(sieve(names, shared, "name").join(dealt(shared).hint("merge"), "name").groupBy("a", "b").agg(F.collect_list("name").alias("names")))
    release(names, shared)
    texts = sieve(keyed, mine, "b").join(mine, ["a", "b"]).select("a", "b", "text", "names")
    windows = cut(_mapped(texts, "a long, b long, at int, d1 long, d2 long", window_rows))
    release(mine)
    me = F.struct("a", "b", "at")
    firsts = windows.groupBy("d1", "d2").agg(F.min(me).alias("f"), F.max(me).alias("l")).filter("f < l").select("d1", "d2", "f")
    found = windows.join(dealt(firsts).hint("merge"), ["d1", "d2"]).filter(me != F.col("f"))
    own = F.when((F.col("f.a") == F.col("a")) & (F.col("f.b") == F.col("b")), F.col("f.at") + width).otherwise(0)
    found = found.select("a", "b", F.greatest("at", own).alias("first"), (F.col("at") + width).alias("last")).filter("first < last")
    # windows side by side are one range: what is left of them is a few rows a text
    w = Window.partitionBy("a", "b").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = found.distinct().withColumn("starts", F.when(F.col("first") <= before, 0).otherwise(1)).withColumn("range", F.sum("starts").over(w))
    out = cut(found.groupBy("a", "b", "range").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("range"))
    release(windows)
    return out


def _ranges_to_spans(text: str, ranges: list[dict]) -> list[dict]:
    """Start and end in code points of what goes with these ranges of words; spans that touch are one."""
    places, out = _words(text)[0], []
    for first, last in sorted((r["first"], r["last"]) for r in ranges):
        start, end = places[first][0], TAIL.match(text, places[last - 1][1]).end()
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 50, out: str = "spans") -> DataFrame:
    """docs without these passages in ``text``, and a column ``out``: array of (start, end) removed, in code points.

    All rows and other columns (but one named as ``out``) stay; rows equal in id and text are treated alike. Null texts stay
    null, and null ids count as the smallest.
    """
    docs = docs.drop(out)
    i, h, held = spare([*docs.columns, out], "id", "h", "ranges")
    keyed = docs.withColumn(i, F.coalesce(F.col(id).cast("long"), F.lit(LOW))).withColumn(h, F.xxhash64(id, text))
    rows = keyed.filter(F.col(text).isNotNull()).select(F.col(i).alias("a"), F.col(h).alias("b"), F.col(text).alias("text"))
    ranges = repeats(rows, width).groupBy("a", "b").agg(F.collect_list(F.struct("first", "last")).alias(held))
    got = keyed.join(ranges.select(F.col("a").alias(i), F.col("b").alias(h), held), [i, h], "left")
    names = [*docs.columns, out]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts, spans = b.column(at).to_pylist(), []
            for k, r in enumerate(b.column(b.num_columns - 1)):
                spans.append(_ranges_to_spans(texts[k], r.as_py()) if r.is_valid else [])
                if spans[-1]:
                    edges = [0, *(x for s in spans[-1] for x in (s["start"], s["end"])), len(texts[k])]
                    texts[k] = "".join(texts[k][i:j] for i, j in zip(edges[::2], edges[1::2]))
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=names)

    schema = StructType([*(StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields), StructField(out, ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))])
    return got.select(*docs.columns, held).mapInArrow(freed(run), schema)
