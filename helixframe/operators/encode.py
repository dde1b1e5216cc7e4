"""From alignments to site patterns and pairs of sites, as relations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import MISSING, codon_state, codons, nucleotide_state


def site_states(seqs: DataFrame, *, codon: bool = False, any_case: bool = True, n_sites: int | None = None) -> DataFrame:
    """name, species, gene, site, state of every symbol (or codon) of every sequence; sites from 0, -1 is missing."""
    parts = codons(F.col("seq")) if codon else F.split("seq", "")
    rows = seqs.select("name", "species", "gene", F.posexplode(parts).alias("site", "symbol")).filter("symbol <> ''")
    state = codon_state(F.col("symbol")) if codon else nucleotide_state(F.col("symbol"), any_case=any_case)
    rows = rows.select("name", "species", "gene", "site", state.alias("state"))
    return rows if n_sites is None else rows.filter(F.col("site") < n_sites)


def _ascii_upper(text: str) -> Column:
    """A, C, G and T as capitals; other letters stay as they are, for the capitals of some are two."""
    return F.translate(text, "acgt", "ACGT")


def base_composition(seqs: DataFrame) -> DataFrame:
    """nt, n, freq of A, C, G, T over all sequences; other symbols do not count."""
    sums = seqs.agg(*[F.coalesce(F.sum(F.length("seq") - F.length(F.replace(_ascii_upper("seq"), F.lit(c), F.lit("")))), F.lit(0)).alias(c) for c in "ACGT"])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("nt"), F.col(c).alias("n"), (F.col(c) / total).alias("freq")) for c in "ACGT"])).alias("x")).select("x.*")


def symbol_states(texts: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """The columns ``by``, st, n: how often each state occurs among all symbols of all texts; what is no nucleotide is missing.

    Symbols are counted within each text, so a row leaves a text for each state and not for each symbol.
    """
    left = {c: F.length(text) - F.length(F.replace(_ascii_upper(text), F.lit(c), F.lit(""))) for c in "ACGT"}
    known = texts.filter(F.length(text) > 0).select(*by, F.length(text).alias("all"), *[v.alias(c) for c, v in left.items()])
    counts = [F.struct(F.lit(k).alias("st"), F.col(c).alias("n")) for k, c in enumerate("ACGT")]
    counts.append(F.struct(F.lit(MISSING).alias("st"), (F.col("all") - F.col("A") - F.col("C") - F.col("G") - F.col("T")).alias("n")))
    return known.select(*by, F.explode(F.array(*counts)).alias("c")).groupBy(*by, F.col("c.st").alias("st")).agg(F.sum("c.n").alias("n")).filter("n > 0")


def with_groups(genes: DataFrame, groups: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The genes that a map of groups holds, beside what it says of them; genes without a group are left out."""
    return genes.join(groups, on)


def in_tree(genes: DataFrame, tips: DataFrame, *, species: str = "species", tip: str = "tip") -> DataFrame:
    """The genes of species that are tips; others are left out. Tips may be named more than once."""
    return genes.join(tips.select(F.col(tip).alias("__tip")), F.col(species) == F.col("__tip"), "left_semi")


def at_sites(rows: DataFrame, places: Sequence[int], site: str = "site") -> DataFrame:
    """The rows of a set of sites."""
    return rows.filter(F.col(site).isin(*places))


def interleave(parts: Sequence[DataFrame], site: str = "site") -> DataFrame:
    """Relations of the codon positions 1, 2, ..., each numbered by codon, as one relation numbered by site."""
    out = None
    for k, p in enumerate(parts):
        one = p.withColumn(site, F.col(site) * len(parts) + k)
        out = one if out is None else out.unionByName(one)
    return out


def axes(gene_map: DataFrame, confs: DataFrame, *by: str) -> DataFrame:
    """``by``, axis, name, node, pos: the data of each position of each tip, in order of name, node and position.

    A gene gives one axis for each position its group holds in its species' configuration; positions of lost groups give an
    axis named ``distinct``, which is never observed. Species without a configuration are left out. With columns ``by``, such as
    a family, axes are numbered for each of their values, of any number.
    """
    sp = F.get(F.split("gene", "__"), F.lit(0))
    genes = gene_map.select(*by, F.col("gene").alias("name"), sp.alias("node"), "orlg")
    held = with_groups(genes, confs.filter("alive = 1"), [*by, "node", "orlg"]).select(*by, "name", "node", "pos")
    lost = confs.filter("alive = 0").join(genes.select(*by, "node"), [*by, "node"], "left_semi").select(*by, F.lit("distinct").alias("name"), "node", "pos")
    rows = held.unionByName(lost)
    order = Window.partitionBy(*by).orderBy("name", "node", "pos")  # as many rows as a tree has tips
    return rows.withColumn("axis", F.row_number().over(order) - 1).select(*by, "axis", "name", "node", "pos")


def observations(sites: DataFrame, axes_: DataFrame) -> DataFrame:
    """site, pattern: the states of every axis at each site; -1 where an axis has no sequence."""
    n = axes_.count()
    known = sites.join(F.broadcast(axes_.filter("name <> 'distinct'")), ["name"]).select("site", "axis", "state")  # axes: a row a tip
    filled = known.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("axis", "state"))).alias("m"))
    return filled.select("site", F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda k: F.coalesce(F.element_at("m", k), F.lit(MISSING))).alias("pattern"))


def compress(obs: DataFrame, *by: str, codon_position: bool = True, n: str | None = None) -> DataFrame:
    """codon_position (1 to 3, or 1), pattern, n: how often each pattern occurs, for each value of the columns ``by``. Sites of
    one pattern are alike given the process. A column ``n`` of obs says how many sites a row stands for."""
    position = (F.pmod("site", F.lit(3)) + 1).cast("int") if codon_position else F.lit(1)
    return obs.groupBy(*by, position.alias("codon_position"), "pattern").agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))


def complete_outgroup(sites: DataFrame, single: str, *, first: str, second: str) -> DataFrame:
    """sites with the second copy's states taken from the first where species ``single`` has one copy only."""
    one, two = sites.filter(F.col("gene") == first), sites.filter(F.col("gene") == second).select("species", "site", F.col("state").alias("s2"))
    both = one.join(two, ["species", "site"], "left")
    add = both.filter(F.col("species") == single).select(F.concat("species", F.lit(second)).alias("name"), "species", F.lit(second).alias("gene"), "site", F.coalesce("s2", "state").alias("state"))
    return sites.filter(~((F.col("species") == single) & (F.col("gene") == second))).unionByName(add)


def site_pairs(index: DataFrame, *, spaces: list[int] | None = None, same_codon: bool = True, by: Sequence[str] = (), width: int = 512) -> DataFrame:
    """``by``, i, j, cs_i, cs_j, space of every two sites i < j by nt_index, within each value of the columns ``by``.

    With ``spaces`` the join is an equi-join on the place looked for. Else all pairs are asked for: places are cut into
    ranges of ``width``, each site is sent to the ranges up to its own, and sites meet by range, so that the work of a long
    sequence is spread over its ranges and no join compares all rows with all.
    """
    a = index.select(*by, F.col("site").alias("i"), F.col("nt_index").alias("at"), F.col("codon").alias("ci"), F.col("codon_site").alias("cs_i"))
    b = index.select(*by, F.col("site").alias("j"), F.col("nt_index").alias("to"), F.col("codon").alias("cj"), F.col("codon_site").alias("cs_j"))
    if spaces is None:
        least = index.groupBy(*by).agg(F.floor(F.min("nt_index") / width).alias("low"))
        a = a.withColumn("range", F.floor(F.col("at") / width))
        b = b.join(least, list(by)) if by else b.crossJoin(F.broadcast(least))  # without a key: one row
        b = b.select("*", F.explode(F.sequence("low", F.floor(F.col("to") / width))).alias("range")).drop("low")
        pairs = a.join(b, [*by, "range"]).filter(F.col("at") < F.col("to"))
    else:
        pairs = a.withColumn("space", F.explode(F.array(*map(F.lit, sorted(set(spaces)))))).withColumn("to", F.col("at") + F.col("space")).filter("space > 0").drop("space").join(b, [*by, "to"])
    if not same_codon:
        pairs = pairs.filter("ci <> cj")
    return pairs.select(*by, "i", "j", "cs_i", "cs_j", (F.col("to") - F.col("at")).alias("space"))


def available_pairs(pairs: DataFrame) -> DataFrame:
    """space, codon_pairs, n: the codon-site pairs that each distance occurs with."""
    return pairs.groupBy("space").agg(F.array_sort(F.collect_set(F.struct("cs_i", "cs_j"))).alias("codon_pairs"), F.count(F.lit(1)).alias("n"))


def codon_site_pairs(lengths: DataFrame, *, same_codon: bool = True) -> DataFrame:
    """cs_i, cs_j, space, n: how many pairs of sites of each distance and codon sites sequences of these lengths have (column
    n_sites, from site 0 without jumps), at every distance there is.

    Which sites there are hangs on the length alone, so sequences are counted by length first, and the first sites of the
    pairs at a distance are counted by a division: no pair is made.
    """
    by_length = lengths.groupBy("n_sites").agg(F.count(F.lit(1)).alias("m")).filter("n_sites > 1")
    rows = by_length.select("n_sites", "m", F.explode(F.sequence(F.lit(1), F.col("n_sites").cast("int") - 1)).alias("space"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("c"))
    if not same_codon:
        rows = rows.filter("c + space >= 3")
    first = F.floor((F.col("n_sites") - F.col("space") - F.col("c") + 2) / 3)  # sites c, c + 3, ... below n_sites - space
    rows = rows.select((F.col("c") + 1).alias("cs_i"), ((F.col("c") + F.col("space")) % 3 + 1).alias("cs_j"), "space", (first * F.col("m")).alias("n")).filter("n > 0")
    return rows.groupBy("cs_i", "cs_j", "space").agg(F.sum("n").alias("n"))


def pair_state_counts(seqs: DataFrame, *, seq: str = "seq", symbols: str = "ACGT") -> DataFrame:
    """space, a, b, n: how many pairs of sites of each distance, within one sequence, hold the states a and b. Every distance.

    The counts of a sequence are the correlations of its states' indicators, made by fast Fourier transforms in n log n
    steps; correlations of zeros and ones are whole numbers, so rounding is exact. Sequences are summed within each batch.
    """
    k = len(symbols)
    chunk = 1 << 15

    def of(text: str) -> np.ndarray:
        s = np.frombuffer(text.encode(), np.uint8)
        n = len(s)
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(np.stack([s == ord(c) for c in symbols]).astype(np.float64), size)
        out = np.empty((n, k, k), np.int64)
        for a in range(k):
            out[:, a] = np.rint(np.fft.irfft(np.conj(f[a]) * f, size)[:, :n]).astype(np.int64).T
        return out[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((0, k, k), np.int64)
            for t in batch.column(0):
                if t.is_valid and len(t.as_py()) > 1:
                    got = of(t.as_py())
                    if len(got) > len(total):
                        total, got = got, total
                    total[: len(got)] += got
            for start in range(0, len(total), chunk):
                part = total[start : start + chunk]
                space, a, b = np.nonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array((space + start + 1).astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(part[space, a, b])], names=["space", "a", "b", "n"])

    return seqs.select(seq).mapInArrow(run, "space int, a int, b int, n long").groupBy("space", "a", "b").agg(F.sum("n").alias("n"))


def pair_patterns(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """cs_i, cs_j, space, pattern, n: patterns of pairs of sites; axis k of site i comes at 2k, of site j at 2k + 1."""
    a, b = obs.select(F.col("site").alias("i"), F.col("pattern").alias("p")), obs.select(F.col("site").alias("j"), F.col("pattern").alias("q"))
    both = F.flatten(F.zip_with("p", "q", lambda x, y: F.array(x, y)))
    return pairs.join(a, "i").join(b, "j").select("cs_i", "cs_j", "space", both.alias("pattern")).groupBy("cs_i", "cs_j", "space", "pattern").agg(F.count(F.lit(1)).alias("n"))


def gaps(index: DataFrame, *by: str, site: str = "site", place: str = "nt_index") -> DataFrame:
    """index with ``gap``: how far each site lies from the one before it in its group; null for the first."""
    w = Window.partitionBy(*by).orderBy(site)  # without a key: the index of one gene
    return index.withColumn("gap", F.col(place) - F.lag(place).over(w))


def monotonic(index: DataFrame) -> bool:
    """Whether nt_index never falls along the sites."""
    row = gaps(index).agg(F.min("gap")).first()
    return row[0] is None or row[0] >= 0
