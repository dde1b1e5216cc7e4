"""Line dedup by a segment-partition edit join. DataFrame functions only.

A line within ``edits`` edits of another shares one of its edits + 1 segments with it unchanged, at most edits places away.
Distinct lines index their own segments by line length; each line probes, for every length that much shorter at most, the
substrings that can still match a segment given what the edits to its left and right may shift. What meets and
has near letter counts is verified by banded bit-parallel edit distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, dealt, release, sieve, spare

#: Letters whose counts are compared before a pair is verified; one edit changes two of the counts by one at most.
LETTERS = "etanhiords"
WIDTH = 6  # bits of a count
#: More letters, whose counts are compared once the texts of a pair are at hand.
MORE_LETTERS = "lcupmfgbwvykqz.,"
#: Bits above the counts: the segment is the line's own; it is of the line's own length; never set.
OWN, EVEN, NEVER = 1 << 60, 1 << 61, 1 << 62
LOW = -(1 << 63)
#: One document in so many is looked at for hot segments.
SAMPLE = 64


def occurrences(docs: DataFrame, id: str, text: str, min_chars: int) -> DataFrame:
    """__id, __h (which tell a row), k (line number), norm of the lines of at least min_chars code points when normalised."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(id).cast("long"), F.lit(LOW)).alias("__id"), F.xxhash64(id, text).alias("__h"), F.posexplode(F.split(text, "\n")).alias("k", "line"))
    return rows.select("__id", "__h", "k", F.lower(F.trim("line")).alias("norm")).filter(F.length("norm") >= min_chars)


def _hashes(norm: Column) -> tuple[Column, Column]:
    return F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(7), norm).alias("h2")


def _letter_counts(rows: DataFrame) -> DataFrame:
    """rows with ``counts`` of the letters in norm. Each letter is taken out of what the ones before have left, a column at a
    time: as one expression the shorter strings would be made again for each that follows."""
    left = "norm"
    for k, c in enumerate(LETTERS):
        rows = rows.withColumn(f"left{k}", F.replace(F.col(left), F.lit(c), F.lit("")))
        left = f"left{k}"
    sizes = [F.octet_length(c) for c in ("norm", *[f"left{k}" for k in range(len(LETTERS))])]
    counts = [F.least(x - y, F.lit((1 << WIDTH) - 1)).cast("long") for x, y in zip(sizes, sizes[1:])]
    packed = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c, WIDTH * k) for k, c in enumerate(counts)])
    return rows.withColumn("counts", packed).drop(*[f"left{k}" for k in range(len(LETTERS))])


def _near_counts(a: Column, b: Column, edits: int) -> Column:
    at = lambda c, k: F.shiftright(c, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))
    return reduce(lambda x, y: x + y, [F.abs(at(a, k) - at(b, k)) for k in range(len(LETTERS))]) <= 2 * edits


def _near_letters(a: Column, b: Column, edits: int) -> Column:
    """Whether the counts of all letters, taken together, are as near as edits can leave them."""
    count = lambda s, c: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(c), F.lit("")))
    return reduce(lambda x, y: x + y, [F.abs(count(a, c) - count(b, c)) for c in LETTERS + MORE_LETTERS]) <= 2 * edits


def _keys(rows: DataFrame, combinations: list[tuple[int, int, int]], parts: int) -> DataFrame:
    """rows once for each (less, i, shift): key is that of segment i of a line shorter by less, read shift places on.

    The combinations are exploded, so that one small expression serves all of them. The last of the parts are longer by one.
    Segments are read from four bytes a character, where a place is found without a walk from the line's beginning.
    """
    rows = rows.withColumn("wide", F.encode("norm", "UTF-32"))
    c = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for d, i, t in combinations])).alias("c")
    rows = rows.select("*", c).withColumn("len", F.col("n") - F.col("c.d"))
    rows = rows.withColumn("more", F.pmod("len", F.lit(parts))).withColumn("base", F.expr(f"(len - more) div {parts}").cast("int"))
    start = (F.col("c.i") - 1) * F.col("base") + F.greatest(F.col("c.i") - 1 - (parts - F.col("more")), F.lit(0)) + 1 + F.col("c.t")
    size = F.col("base") + F.when(F.col("c.i") > parts - F.col("more"), 1).otherwise(0)
    rows = rows.withColumn("start", start).withColumn("size", size).filter("start >= 1 and start + size - 1 <= n")
    return rows.withColumn("key", F.xxhash64("len", "c.i", F.substring("wide", 4 * F.col("start") - 3, 4 * F.col("size")))).drop("wide")


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """(less, i, shift): a line may hold segment i of one shorter by less that many places on: at most i - 1 edits are to the left
    of the segment, and at most edits + 1 - i to its right."""
    out = []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            after = edits + 1 - i
            lo, hi = max(-(i - 1), less - after), min(i - 1, less + after)
            out += [(less, i, shift) for shift in range(lo, hi + 1)]
    return out


def _meet(keyed: DataFrame, edits: int) -> DataFrame:
    """a, b: h1 of two lines with a common key, which is one of a's own segments, and nearly the same letters.

    A line's own segments are among its probes, so one relation stands on both sides and is made and shuffled once; the
    condition names both sides, for a filter on one of them would make the two differ.
    """
    x, y = keyed.alias("x"), keyed.alias("y")
    ca, cb, a, b = F.col("x.counts"), F.col("y.counts"), F.col("x.h"), F.col("y.h")
    owns = ca.bitwiseAND(F.lit(OWN)) > cb.bitwiseAND(F.lit(NEVER))
    once = (cb.bitwiseAND(F.lit(EVEN)) == 0) | (a < b)
    meet = (F.col("x.key") == F.col("y.key")) & (a != b) & owns & once & _near_counts(ca, cb, edits)
    return x.join(y, meet).select(a.alias("a"), b.alias("b"))


def _flagged(own: Column) -> Column:
    """The counts with what a row is: an own segment, one of a line of the same length."""
    flags = F.when(own, F.lit(OWN)).otherwise(F.lit(0)).bitwiseOR(F.when(F.col("c.d") == 0, F.lit(EVEN)).otherwise(F.lit(0)))
    return F.col("counts").bitwiseOR(flags.cast("long")).alias("counts")


def _finer(keyed: DataFrame) -> DataFrame:
    """key, h, counts: rows of two edits and three segments once more for each part of the rest of the line that may be unchanged.

    Where the middle segment is unchanged, of the text before it either the first half or the other half is, at its end of that
    text, or there are two edits in it and the text behind the segment is the same. Where the first or the last segment is, of
    the rest one third is: the first or the last, in its place, or the middle one, moved by the edit before it.
    """
    before, size = F.col("start") - F.col("c.t") - 1, F.col("size")  # how long the rest is in the line that owns the segment
    after = F.col("len") - before - size
    rest, begin = F.when(F.col("c.i") == 1, after).otherwise(before), F.when(F.col("c.i") == 1, F.col("start") + size).otherwise(F.lit(1))
    end = F.when(F.col("c.i") == 1, F.col("n")).otherwise(F.col("start") - 1)  # the rest here
    third, half = F.floor(rest / 3).cast("int"), F.floor(before / 2).cast("int")
    part = lambda k, at, length, moved=0: F.struct(F.lit(k).alias("k"), at.cast("int").alias("at"), length.cast("int").alias("length"), F.lit(moved).alias("moved"))
    middle = [part(1, F.lit(1), half), part(2, F.col("start") - (before - half), before - half), part(3, F.when(F.col("n") - F.col("start") - size + 1 == after, F.col("start") + size).otherwise(F.lit(0)), after)]
    outer = [part(4, begin, third), part(5, end - third + 1, third), *[part(6, begin + third + m, rest - 2 * third, m) for m in (-1, 0, 1)]]
    rows = keyed.withColumn("p", F.explode(F.when(F.col("c.i") == 2, F.array(*middle)).otherwise(F.array(*outer))))
    inside = F.when(F.col("p.k") <= 2, F.col("start") - 1).when(F.col("p.k") == 3, F.col("n")).otherwise(end)  # the part ends here at most
    least = F.when(F.col("p.k") >= 4, begin).otherwise(F.lit(1))
    rows = rows.filter((F.col("p.at") >= least) & (F.col("p.at") + F.col("p.length") - 1 <= inside))
    own = (F.col("c.d") == 0) & (F.col("c.t") == 0) & (F.col("p.moved") == 0)
    return rows.select(F.xxhash64("key", "p.k", F.substring("norm", F.col("p.at"), F.col("p.length"))).alias("key"), F.col("h1").alias("h"), _flagged(own))


def hot_segments(some: DataFrame, edits: int, most: float) -> DataFrame:
    """key of each segment that more than ``most`` of some distinct lines (column norm) own."""
    parts = edits + 1
    rows = some.select("norm").distinct().withColumn("n", F.length("norm"))
    owned = _keys(rows, [(0, i, 0) for i in range(1, parts + 1)], parts)
    return owned.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key")


def candidates(lines: DataFrame, edits: int = 2, hot: DataFrame | None = None) -> DataFrame:
    """a, b: h1 of distinct lines (column norm) that share a segment as lines within ``edits`` edits must, and nearly the same letters.

    A segment that very many lines own would bring all of them together: those in ``hot`` (with two edits) do so only where a
    part of the rest is unchanged as well, as some part must be.
    """
    parts = edits + 1
    rows = _letter_counts(lines.select("norm").distinct()).select("norm", "counts", F.length("norm").alias("n"), _hashes(F.col("norm"))[0])
    keyed = _keys(rows, _probes(edits), parts)
    plain = lambda k: k.select("key", F.col("h1").alias("h"), _flagged((F.col("c.d") == 0) & (F.col("c.t") == 0)))
    n = 0 if hot is None or edits != 2 else hot.count()
    if not n:
        return _meet(plain(keyed), edits).distinct()
    hot = F.broadcast(hot) if n <= 1 << 20 else hot  # 16 MB at most
    much = _meet(_finer(keyed.join(hot, "key", "left_semi")), edits)
    return _meet(plain(keyed.join(hot, "key", "left_anti")), edits).unionByName(much).distinct()


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of a and b, both longer than edits, is at most edits: bit-parallel over a band of
    2 * edits + 1 diagonals, one word for each character of b."""
    top = 2 * edits
    full = (1 << (top + 1)) - 1
    inv = lambda c: F.lit(full) - c  # noqa: E731  of a word of top + 1 bits
    aa, bb = F.split(a, ""), F.split(b, "")

    def run(x: Column) -> Column:
        xa, xb = x["a"], x["b"]
        m, n = F.size(xa), F.size(xb)

        def column(s: Column, j: Column) -> Column:
            c = F.get(xb, j - 1)
            same = reduce(lambda p, q: p + q, [F.when((j - edits + k >= 1) & (F.get(xa, F.greatest(j - edits + k - 1, F.lit(0))) == c), 1 << k).otherwise(0) for k in range(top + 1)])
            vp, vn = s["vp"], s["vn"]
            return _named({"x": same, "vp": vp, "vn": vn, "d": s["d"]}, lambda t: _named({"d0": ((t["x"].bitwiseAND(t["vp"]) + t["vp"]).bitwiseAND(F.lit(full)).bitwiseXOR(t["vp"])).bitwiseOR(t["x"]).bitwiseOR(t["vn"]), "vp": t["vp"], "vn": t["vn"], "d": t["d"]}, lambda t: _named(
                {"d0": t["d0"], "hp": t["vn"].bitwiseOR(inv(t["d0"].bitwiseOR(t["vp"]))), "hn": t["d0"].bitwiseAND(t["vp"]), "d": t["d"]}, lambda t: F.struct(
                    t["hn"].bitwiseOR(inv(F.shiftright(t["d0"], 1).bitwiseOR(t["hp"]))).alias("vp"),
                    F.shiftright(t["d0"], 1).bitwiseAND(t["hp"]).alias("vn"),
                    F.when(j <= m - edits, t["d"] + 1 - F.shiftright(t["d0"], top)).otherwise(t["d"] + _bit(t["hp"], m - j + edits) - _bit(t["hn"], m - j + edits)).alias("d"),
                ))))

        zero = F.struct(F.lit(full - ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
        return F.aggregate(F.sequence(F.lit(1), n), zero, column, lambda s: s["d"] <= edits)

    return (F.abs(F.length(a) - F.length(b)) <= edits) & F.element_at(F.transform(F.array(F.struct(aa.alias("a"), bb.alias("b"))), run), 1)


def _named(values: dict[str, Column], then) -> Column:
    """then(struct of values), with the struct evaluated once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), 1)


def _bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftright", word, F.greatest(at, F.lit(0))).bitwiseAND(F.lit(1))


def places(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """__id, __h, k, h1, h2 of every line of at least min_chars: which row, which line, and the digest of its normal form."""
    return occurrences(docs, id, text, min_chars).select("__id", "__h", "k", *_hashes(F.col("norm")))


def links(docs: DataFrame, at: DataFrame, *, id: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 10, hot: int | None = None) -> DataFrame:
    """a1, a2, b1, b2: digests of every two distinct normalised lines within ``edits`` edits. ``at``: the places of docs;
    ``hot``: as in dedup."""
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.xxhash64(id, text).alias("__h"))
    shared = None
    if hot is not None:  # found in every SAMPLE-th text; that decides only how lines meet, not which
        some = occurrences(rows.filter(F.pmod("__h", F.lit(SAMPLE)) == 0), "i", "t", min_chars)
        shared = cut(hot_segments(some, edits, hot / SAMPLE))
    pairs = cut(candidates(occurrences(docs, id, text, min_chars).select("norm"), edits, shared))
    # the texts of candidates are read again, from one document for each
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())
    least = sieve(at, ends, "h1").groupBy("h1", "h2").agg(F.min("__h").alias("__h"))  # a very common line is one row from here on
    least = cut(least.join(ends, "h1", "left_semi"))
    texts = sieve(occurrences(sieve(rows, least, "__h"), "i", "t", min_chars).select("norm", *_hashes(F.col("norm"))), ends, "h1").distinct()
    a, b = texts.select(F.col("norm").alias("na"), F.col("h1").alias("a"), F.col("h2").alias("a2")), texts.select(F.col("norm").alias("nb"), F.col("h1").alias("b"), F.col("h2").alias("b2"))
    near = pairs.join(a, "a").join(b, "b").filter(_near_letters(F.col("na"), F.col("nb"), edits)).filter(within(F.col("na"), F.col("nb"), edits))
    out = cut(near.select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2"))
    release(pairs, ends, least)
    return out


def repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 10, hot: int | None = None) -> DataFrame:
    """__id, __h, k, first_id, first_line: each line to remove and the line of its class that stays.

    Two lines are of one class if their normalised texts (trimmed, lower case) are equal or joined by links. Of a class the
    earliest stays: by document id (rows of one id: by a hash of the text), then by place. Rows equal in id and text count as
    one and are treated alike.
    """
    at = cut(places(docs, id=id, text=text, min_chars=min_chars))
    near = links(docs, at, id=id, text=text, edits=edits, min_chars=min_chars, hot=hot)
    name = lambda x, y: F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))
    classes = connected_components(near.select(name("a1", "a2").alias("a"), name("b1", "b2").alias("b")))
    low = lambda c, k: F.conv(F.substring(c, k, 16), 16, -10).cast("long")
    classes = classes.select(low("node", 1).alias("h1"), low("node", 17).alias("h2"), low("component", 1).alias("c1"), low("component", 17).alias("c2"))
    classes = cut(classes)
    place = F.struct("__id", "__h", "k")
    keys = cut(at.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1").unionByName(classes.select("h1")).distinct())
    # what is not repeated goes no further than a sieve of what is. A very common line is a hot key of the joins below: they stay
    # joins of two shuffles, whose hot partitions are split
    some = sieve(at, keys, "h1").join(classes.hint("merge"), ["h1", "h2"], "left")
    some = cut(some.select("__id", "__h", "k", F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2")))
    release(at, near, keys)
    firsts = some.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("c1", "c2", "first")
    found = some.join(dealt(firsts).hint("merge"), ["c1", "c2"]).filter(place != F.col("first"))
    return found.select("__id", "__h", "k", F.col("first.__id").alias("first_id"), F.col("first.k").alias("first_line")).distinct()


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 10, hot: int | None = None, out: str = "removed") -> DataFrame:
    """docs without the lines that repeat an earlier one, with a column ``out``: array of (line, first_id, first_line).

    All rows and other columns (but one named as ``out``) stay, whatever their names; a text of which every line goes is empty.
    Null and empty texts stay as they are, and null ids count as the smallest id. Lines shorter than ``min_chars`` when
    normalised stay.

    With ``hot``, lines that share a segment with more than so many others are brought together only where more of them is
    unchanged: the same result, for a scan more of the texts, where templates make very many lines alike in part.
    """
    i, h, gone = spare([*docs.columns, out], "id", "h", "gone")
    got = _keyed(docs, id, text, i, h).join(_gone(docs, id, text, edits, min_chars, hot, i, h, gone), [i, h], "left")

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda r: r["line"]))
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.element_at(F.transform(F.array(F.split(text, "\n")), without), 1))
    columns = [new.alias(text) if c == text else F.col(c) for c in docs.columns if c != out]
    return got.select(*columns, F.coalesce(gone, F.array().cast("array<struct<line:int,first_id:bigint,first_line:int>>")).alias(out))


def removed(docs: DataFrame, *, id: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 10, hot: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, removed of every row: what dedup removes, without the texts."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    rows = _keyed(rows, "doc_id", "text", "i", "h").select("doc_id", "i", "h", n.alias("n_lines"))
    got = rows.join(_gone(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", edits, min_chars, hot, "i", "h", "gone"), ["i", "h"], "left")
    gone = F.coalesce("gone", F.array().cast("array<struct<line:int,first_id:bigint,first_line:int>>"))
    return got.select("doc_id", "n_lines", F.size(gone).alias("n_removed"), gone.alias("removed"))


def _keyed(docs: DataFrame, id: str, text: str, i: str, h: str) -> DataFrame:
    return docs.withColumn(i, F.coalesce(F.col(id).cast("long"), F.lit(LOW))).withColumn(h, F.xxhash64(id, text))


def _gone(docs: DataFrame, id: str, text: str, edits: int, min_chars: int, hot: int | None, i: str, h: str, out: str) -> DataFrame:
    found = repeats(docs, id=id, text=text, edits=edits, min_chars=min_chars, hot=hot)
    lines = F.array_sort(F.collect_list(F.struct(F.col("k").alias("line"), "first_id", "first_line")))  # those of one text
    return found.groupBy(F.col("__id").alias(i), F.col("__h").alias(h)).agg(lines.alias(out))


def removed_text(removed: Column) -> Column:
    return F.array_join(F.transform(removed, lambda r: F.concat(r["line"].cast("string"), F.lit(">"), r["first_id"].cast("string"), F.lit(":"), r["first_line"].cast("string"))), ",")


def oracle() -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed, removed of the query. Its distance counts bytes, so accented letters are
    first put into one byte each."""
    accents = "áéíóúàèìòùâêîôûäëïöüçñß"
    controls = "||".join(f"chr({k})" for k in [*range(1, 9), 11, 12, *range(14, 27)])
    return f"""
    with recursive occ as (select doc_id, k, lower(trim(line, ' ')) norm from (select doc_id, unnest(range(len(ls))) k, unnest(ls) line from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null))
  where length(trim(line, ' ')) >= 10),
 d as materialized (select norm, translate(norm, '{accents}', {controls}) t, length(norm) n,
   length(norm) - length(replace(norm, 'e', '')) ne, length(norm) - length(replace(norm, 'n', '')) nn, length(norm) - length(replace(norm, 't', '')) nt, length(norm) - length(replace(norm, 'a', '')) na, length(norm) - length(replace(norm, 'r', '')) nr from (select distinct norm from occ)),
 l as materialized (select a.norm a, b.norm b from d a join (select *, unnest([n - 2, n - 1, n, n + 1, n + 2]) m from d) b on a.n = b.m and a.norm <> b.norm
   and abs(a.ne - b.ne) + abs(a.nn - b.nn) + abs(a.nt - b.nt) + abs(a.na - b.na) + abs(a.nr - b.nr) <= 4 where levenshtein(a.t, b.t) <= 2),
 r as (select a n, a m from l union select r.n, l.b from r join l on l.a = r.m),
 cls as (select n norm, min(m) c from r group by 1),
 o as (select doc_id, k, coalesce(c, norm) c from occ left join cls using (norm)),
 f as (select c, arg_min((doc_id, k), (doc_id, k)) f, count(*) n from o group by c),
 g as (select o.doc_id, string_agg(o.k || '>' || f.f[1] || ':' || f.f[2], ',' order by o.k) removed, count(*) n from o join f using (c) where (o.doc_id, o.k) <> f.f group by 1)
 select doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end n_lines, coalesce(g.n, 0) n_removed, coalesce(removed, '') removed from documents left join g using (doc_id)"""
