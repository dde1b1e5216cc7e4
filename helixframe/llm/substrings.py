"""Substring dedup: texts are cut into units (lines, paragraphs or sentences), these are normalised and their digests grouped
over all documents; a unit that stands earlier elsewhere is removed, and its original offsets are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dealt, release, sieve, spare

#: A sentence runs through its end mark and line feeds, with the blanks behind.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+"
#: Where units of these kinds begin. Of every kind, the units of a text make up the whole text.
STARTS = {"line": r"(?<=\n)", "paragraph": r"(?<=\n[ \t\r]{0,40}\n)(?![ \t\r]*\n)"}
LOW = -(1 << 63)


def _units(text: Column, unit: str) -> Column:
    if unit == "sentence":
        return F.regexp_extract_all(text, F.lit(SENTENCE), 0)
    return F.split(text, STARTS[unit])


def units(docs: DataFrame, id: str, text: str, unit: str) -> DataFrame:
    """__id, __h (which tell a row), k (place of the unit), n (its code points), words, d1, d2 (128 bits of digest)."""
    u = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LOW)).alias("__id"), F.xxhash64(id, text).alias("__h"), F.posexplode(_units(F.col(text), unit)).alias("k", "u"))
    u = u.withColumn("norm", F.trim(F.regexp_replace(F.lower("u"), r"[ \t\n\r]+", " ")))
    words = F.when(F.col("norm") == "", 0).otherwise(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    return u.select("__id", "__h", "k", F.length("u").alias("n"), words.alias("words"), F.xxhash64("norm").alias("d1"), F.xxhash64(F.lit(7), "norm").alias("d2"))


def repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 1) -> DataFrame:
    """__id, __h, first, last: the runs of units (first to last) to remove from each row.

    A unit is a repeat if the same normalised unit stands earlier: in a document of smaller id (rows of one id: by a hash
    of the text), or before in the same one. Units without a word, and runs of repeats of fewer than ``min_words`` words in
    all, stay. Rows equal in id and text count as one and are treated alike.
    """
    one = docs.select(F.col(id), F.col(text)).filter(F.col(text).isNotNull())
    u = units(one, id, text, unit).filter("words > 0")
    place = F.struct("__id", "__h", "k")
    firsts = cut(u.groupBy("d1", "d2").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f <> l").select("d1", "d2", "f"))
    # a very common unit is a hot key: the join stays one of two shuffles, whose hot partitions are split
    found = sieve(u, firsts, "d1").join(firsts.hint("merge"), ["d1", "d2"]).filter(place != F.col("f"))
    found = found.select("__id", "__h", "k", "words").distinct()  # rows equal in id and text
    w = Window.partitionBy("__id", "__h").orderBy("k")
    found = found.withColumn("island", F.col("k") - F.row_number().over(w))
    runs = found.groupBy("__id", "__h", "island").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.sum("words").alias("words"))
    runs = cut(runs.filter(F.col("words") >= min_words).select("__id", "__h", "first", "last"))
    release(firsts)
    return runs


def _without(text: Column, runs: Column, unit: str) -> Column:
    """struct(text, spans): text without the units of the runs, and the spans these had."""
    all_ = _units(text, unit)

    def cut(us: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            start = s["at"] + _size(F.slice(us, s["next"] + 1, r["first"] - s["next"]))
            end = start + _size(F.slice(us, r["first"] + 1, r["last"] - r["first"] + 1))
            return F.struct((r["last"] + 1).alias("next"), end.alias("at"), F.concat(s["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

        zero = F.struct(F.lit(0).alias("next"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        spans = F.aggregate(F.array_sort(runs), zero, step, lambda s: s["spans"])
        kept = F.array_except(F.sequence(F.lit(0), F.size(us) - 1), F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"]))))
        return F.struct(F.array_join(F.transform(kept, lambda k: F.get(us, k)), "").alias("text"), spans.alias("spans"))

    return F.element_at(F.transform(F.array(all_), cut), 1)


def _size(us: Column) -> Column:
    return F.aggregate(us, F.lit(0), lambda s, u: s + F.length(u))


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 1, out: str = "spans") -> DataFrame:
    """docs with repeated units (``line``, ``paragraph`` or ``sentence``) removed from ``text``, and a column ``out``: array of
    (start, end) removed, in code points of the original text.

    All rows and other columns (but one named as ``out``) stay, whatever their names. Null texts stay null, and null ids count
    as the smallest id.
    """
    if unit not in ("sentence", *STARTS):
        raise ValueError(f"units are lines, paragraphs or sentences, not {unit}")
    i, h, runs, new = spare([*docs.columns, out], "id", "h", "runs", "new")
    gone = repeats(docs, id=id, text=text, unit=unit, min_words=min_words).groupBy(F.col("__id").alias(i), F.col("__h").alias(h)).agg(F.collect_list(F.struct("first", "last")).alias(runs))
    keyed = docs.withColumn(i, F.coalesce(F.col(id).cast("long"), F.lit(LOW))).withColumn(h, F.xxhash64(id, text))
    got = keyed.join(gone, [i, h], "left").withColumn(new, F.when(F.col(runs).isNotNull(), _without(F.col(text), F.col(runs), unit)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = [F.coalesce(F.col(f"{new}.text"), F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns if c != out]
    return got.select(*columns, F.coalesce(F.col(f"{new}.spans"), none).alias(out))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


def oracle(min_words: int = 25) -> str:
    """DuckDB SQL for doc_id, text, spans of the query."""
    return rf"""
    with u as (
      select doc_id, unnest(range(len(us))) k, unnest(us) u
      from (select doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+') us from documents where text is not null)),
    m as (select doc_id, k, length(u) n, u, trim(regexp_replace(lower(u), '[ \t\n\r]+', ' ', 'g')) norm from u),
    p as (select *, coalesce(sum(n) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) pos,
      case when norm = '' then 0 else len(string_split(norm, ' ')) end words,
      row_number() over (partition by norm order by doc_id, k) nth from m),
    r as (select *, k - row_number() over (partition by doc_id order by k) island from p where words > 0 and nth > 1),
    s as (select doc_id, min(k) a, max(k) b, min(pos) s, max(pos + n) e from r group by doc_id, island having sum(words) >= {min_words}),
    t as (select p.doc_id, string_agg(p.u, '' order by p.k) text from p where not exists (select 1 from s where s.doc_id = p.doc_id and p.k between s.a and s.b) group by 1),
    v as (select doc_id, string_agg(s || '-' || e, ',' order by s) spans from s group by 1)
    select d.doc_id, case when d.text is null then null else coalesce(t.text, '') end as text, coalesce(v.spans, '') as spans
    from documents d left join t using (doc_id) left join v using (doc_id)"""
