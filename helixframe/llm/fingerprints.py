"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so the sketch of a union is the union of sketches
and containment between texts of very unequal length can be estimated. Beside these stands the least hash of all: by it alone
texts are compared that are too short to have a hash below the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

SHINGLE = 5
FRACTION = 0.125


def sketch(text: Column, *, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """struct(kept: sorted distinct hashes below the bound, least: the least hash). Null and wordless texts have no hash; a text
    of fewer words than a shingle is one shingle."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bound = int(-(2**63) + fraction * 2**64)

    # the arrays are bound once by outer transforms; Catalyst would otherwise repeat their expressions
    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - shingle, F.lit(0))
        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))).otherwise(F.array().cast("array<bigint>"))

    def both(many: Column) -> Column:
        return F.struct(F.array_sort(F.array_distinct(F.filter(many, lambda x: x < F.lit(bound)))).alias("kept"), F.array_min(many).alias("least"))

    return F.element_at(F.transform(F.transform(F.array(hashes), shingles), both), 1)


def _hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def encode(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, joined by blanks; a tilde and the least hash where none is kept."""
    return F.when(F.size(s["kept"]) > 0, F.array_join(F.transform(s["kept"], _hex), " ")).when(s["least"].isNotNull(), F.concat(F.lit("~"), _hex(s["least"]))).otherwise(F.lit(""))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.struct(F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"), F.least(a["least"], b["least"]).alias("least"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all, 0 to 1; 1 for two texts without words, 0 for one and another.

    Where one of the two keeps no hash, the least hashes tell: they are equal with this share for a chance.
    """
    both, any_ = F.size(F.array_intersect(a["kept"], b["kept"])), F.size(F.array_union(a["kept"], b["kept"]))
    short = (F.size(a["kept"]) == 0) | (F.size(b["kept"]) == 0)
    return F.when(short, F.when(a["least"].eqNullSafe(b["least"]), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(both.cast("double") / any_)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1, whatever the lengths of the two: 1 for a text within another. 1 if a
    has no words, and null (not known) if it has words but no hash below the bound."""
    of = F.size(a["kept"])
    return F.when(a["least"].isNull(), F.lit(1.0)).when(of > 0, F.size(F.array_intersect(a["kept"], b["kept"])).cast("double") / of)


def with_next(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rows_per_block: int = 250, max_blocks: int = 65536) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document beside the next by descending id (after the last: the first).

    Rows with one id follow one another by a hash of the text; null ids come last and null texts count as empty. Rows are cut
    into blocks by ranges of (id, hash), so that no task sees all rows, nor all rows of one id or without one; the first
    document of each block also closes the block before it. The ranges are those that Spark deals the ids out by; only their
    bounds reach the driver: at most ``max_blocks``, so blocks of larger tables hold more rows, which are sorted with spilling.
    """
    d = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    keys = d.select(key.alias("key"))
    blocks = max(1, min(max_blocks, d.count() // rows_per_block))
    tops = []
    if blocks > 1:  # a null id is less than any other
        ranges = keys.repartitionByRange(blocks, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top"))
        tops = sorted(({(r["top"]["i"], r["top"]["h"]) for r in ranges.collect()}), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))[:-1]
    kind = "array<struct<i:bigint,h:bigint>>"
    number = lambda v: "null" if v is None else str(v)
    bounds = F.from_json(F.lit("[" + ",".join(f'{{"i":{number(i)},"h":{h}}}' for i, h in tops) + "]"), kind)
    steps = [1 << k for k in range(max(1, len(tops)).bit_length() - 1, -1, -1)]

    def block(c: Column) -> Column:
        """How many bounds are less than c, by binary search in a constant array."""
        if not tops:
            return F.lit(0)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(tops)) & (F.get(bounds, at + s - 1) < c), at + s).otherwise(at))

    d = d.withColumn("key", key).withColumn("block", block(F.col("key")))
    firsts = {r["block"]: (r["top"]["i"], r["top"]["h"]) for r in keys.groupBy(block(F.col("key")).alias("block")).agg(F.max("key").alias("top")).collect()}
    order = sorted(firsts, reverse=True)  # blocks by descending id
    if order:
        closes = dict(zip(order, order[-1:] + order[:-1]))  # the block that each block's first document closes
        known = [f'{{"i":{number(firsts[k][0])},"h":{firsts[k][1]},"b":{closes[k]}}}' if k in firsts else "null" for k in range(order[0] + 1)]
        heads = F.get(F.from_json(F.lit("[" + ",".join(known) + "]"), "array<struct<i:bigint,h:bigint,b:bigint>>"), F.col("block"))
        first = F.col("doc_id").eqNullSafe(heads["i"]) & (F.col("key.h") == heads["h"])
        tails = d.filter(first).select("doc_id", "text", heads["b"].cast("int").alias("block"), F.lit(1).alias("tail")).distinct()
        d = d.select("doc_id", "text", "block", F.lit(0).alias("tail")).unionByName(tails)
    else:
        d = d.select("doc_id", "text", "block", F.lit(0).alias("tail"))
    d = d.repartition("block").withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("block").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    out = d.select("doc_id", "text", "sketch", "tail", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
    return out.filter("tail = 0").drop("tail")


def edited(text: Column, other: Column) -> Column:
    """The last floor(n/2) code points of text replaced by the first as many (or all) of other."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(other, F.lit(1), F.floor(n / 2).cast("int")))


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; a row for each input row.

    A null text counts as empty. Equal texts have equal fingerprints. A single document is its own next.
    """
    rows = with_next(docs, id=id, text=text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"), encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
