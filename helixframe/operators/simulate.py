"""Simulation of paralogs along a tree (Gillespie, 1977): point mutations and copied tracts, one task a replicate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import NUCLEOTIDES, SENSE_CODONS
from ..sources.newick import Tree
from .histories import Configuration, divide

SEQUENCES = "replicate int, node string, orlg int, seq string"
#: Columns of the two event logs; a mutation leaves those of tracts null.
EVENTS = "replicate int, kind string, edge string, time double, orlg_from int, orlg_to int, tract_length int, start_pos int, stop_pos int, num_diff int, template_seq string, overide_seq string, mut_pos int, old_state string, new_state string"


@dataclass
class Setting:
    """``q`` and ``pi``: rates and frequencies of the symbols (4 nucleotides, or 61 codons). ``index``: where each site
    lies, so that tracts run over gaps. Copies start at a rate of ``init`` a site and have geometric length of parameter p; each
    of these is one number, or one for every (donor, recipient), where those not named make no copies. ``unit`` is the number
    of letters of a symbol, in which the logs count places and lengths."""

    tree: Tree
    confs: dict[str, Configuration]
    lengths: dict[tuple[str, str], float]
    q: np.ndarray
    pi: np.ndarray
    n_sites: int
    init: float | dict[tuple[int, int], float]
    p: float | dict[tuple[int, int], float]
    rates: np.ndarray | None = None  # of each site
    index: list[int] = field(default_factory=list)
    seed: int = 0

    @property
    def unit(self) -> int:
        return len(self.symbols[0])

    def tracts(self, pair: tuple[int, int]) -> tuple[float, float]:
        """Rate at which copies of this (donor, recipient) start at a site, and the parameter of their length."""
        init, p = (v.get(pair, 0.0) if isinstance(v, dict) else v for v in (self.init, self.p))
        return (init, p) if init > 0 and p > 0 else (0.0, 1.0)

    @property
    def symbols(self) -> list[str]:
        return list(NUCLEOTIDES) if len(self.pi) == 4 else SENSE_CODONS


def draw(rng: np.random.Generator, weights: np.ndarray) -> int:
    """A place with chance in proportion to its weight: the first whose running sum passes a uniform draw."""
    c = np.cumsum(weights)
    return int(min(np.searchsorted(c, rng.random() * c[-1], side="right"), len(c) - 1))


def draw_column(u: Column, shares: list[Column]) -> Column:
    """draw by a column: the first state whose running sum of shares passes u, a number from 0 to 1 (not included)."""
    out = F.lit(len(shares) - 1)
    top = None
    tops = [top := x if top is None else top + x for x in shares]
    for k in range(len(shares) - 2, -1, -1):
        out = F.when(u < tops[k], k).otherwise(out)
    return out


def one(setting: Setting, replicate: int) -> tuple[list[tuple], list[tuple]]:
    """Sequences of all nodes and events of all branches of one replicate; its draws hang on the seed and number alone."""
    s = setting
    rng = np.random.default_rng([s.seed, replicate])
    site_rate = np.ones(s.n_sites) if s.rates is None else np.asarray(s.rates, dtype=float)
    index = np.arange(s.n_sites) if not s.index else np.asarray(s.index) - min(s.index)
    span = int(index[-1]) + 1
    exit_rate = s.q.sum(axis=1)
    root = s.tree.root
    seqs = {root: {o: np.searchsorted(np.cumsum(s.pi), rng.random(s.n_sites) * s.pi.sum(), side="right").clip(max=len(s.pi) - 1) for o in divide(s.confs[root])["loc"]}}
    events: list[tuple] = []
    text = lambda x: "".join(s.symbols[k] for k in x)
    for parent, child in sorted(s.tree.edges, key=lambda e: s.tree.nodes.index(e[1])):
        now = {o: x.copy() for o, x in seqs[parent].items()}
        t, edge = 0.0, f"{parent}_{child}"
        names = sorted(now)
        pairs = [(a, b) for a in names for b in names if a != b]
        tract = [s.tracts(pair) for pair in pairs]
        each = np.array([init * (span - 1 + 1 / p) for init, p in tract])
        starts = float(each.sum())
        mutable = {o: exit_rate[x] * site_rate for o, x in now.items()}
        while True:
            mutations = np.array([mutable[o].sum() for o in names])
            total = mutations.sum() + starts
            t += rng.exponential(1 / total) if total > 0 else np.inf
            if t >= s.lengths[parent, child]:
                break
            if rng.random() * total < mutations.sum():
                o = names[draw(rng, mutations)]
                k = draw(rng, mutable[o])
                old = now[o][k]
                new = draw(rng, s.q[old])
                now[o][k] = new
                mutable[o][k] = exit_rate[new] * site_rate[k]
                events.append((replicate, "mutation", edge, t, None, o, None, None, None, None, None, None, int(index[k]) * s.unit, s.symbols[old], s.symbols[new]))
                continue
            k = draw(rng, each)
            (a, b), p = pairs[k], tract[k][1]
            # a tract may have begun before the first site: its weight there is the mean length
            start = 0 if rng.random() < (1 / p) / (span - 1 + 1 / p) else 1 + int(rng.integers(span - 1))
            length = int(rng.geometric(p))
            stop = min(start + length, span) - 1
            at = np.flatnonzero((index >= start) & (index <= stop))
            old = now[b][at].copy()
            now[b][at] = now[a][at]
            mutable[b][at] = exit_rate[now[b][at]] * site_rate[at]
            events.append((replicate, "copy", edge, t, a, b, length * s.unit, start * s.unit, (stop + 1) * s.unit - 1, int((old != now[b][at]).sum()), text(now[a][at]), text(old), None, None, None))
        after = divide(s.confs[child])["loc"]
        gone, born = sorted(set(now) - set(after)), sorted(set(after) - set(now))
        if born:  # a duplication: the group that ends is the one copied
            now = {**{o: x for o, x in now.items() if o in after}, **{o: now[gone[0]].copy() for o in born}}
        else:
            now = {o: x for o, x in now.items() if o in after}
        seqs[child] = now
    return [(replicate, n, o, text(x)) for n, g in seqs.items() for o, x in sorted(g.items())], events


def simulate(spark: SparkSession, setting: Setting, replicates: int) -> tuple[DataFrame, DataFrame]:
    """Sequences of every node, and events, of every replicate.

    Both come from one pass, whose rows are kept for whichever of the two is read first; what is lost is made again, alike.
    """
    rows = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    shared = spark.sparkContext.broadcast(setting)
    names = [[c.split()[0] for c in x.split(", ")] for x in (SEQUENCES, EVENTS)]
    fields = [*SEQUENCES.split(", "), *EVENTS.split(", ")[1:]]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                for rows, columns in zip(one(shared.value, r), names):
                    of = dict(zip(columns, zip(*rows))) if rows else {}
                    if of:
                        made = [pa.array(of.get(n) or [None] * len(rows), kinds[k]) for n, k in (f.split() for f in fields)]
                        yield pa.RecordBatch.from_arrays(made, names=[f.split()[0] for f in fields])

    kept = rows.mapInArrow(run, ", ".join(fields)).persist()
    return kept.filter("kind is null").select(*names[0]), kept.filter("kind is not null").select(*names[1])


def expected_events(setting: Setting, replicates: int) -> dict[tuple[str, str, str], float]:
    """The mean number of events by (parent, child, kind) over all replicates: of ``copy`` exactly, of ``mutation`` where sites
    are at stationarity and their rates have mean one."""
    span = setting.n_sites if not setting.index else max(setting.index) - min(setting.index) + 1
    unit = float(setting.pi @ setting.q.sum(axis=1)) / float(setting.pi.sum())
    out = {}
    for (a, b), t in setting.lengths.items():
        names = divide(setting.confs[a])["loc"]
        tracts = [setting.tracts((x, y)) for x in names for y in names if x != y]
        out[a, b, "copy"] = replicates * t * sum(init * (span - 1 + 1 / p) for init, p in tracts)
        out[a, b, "mutation"] = replicates * t * unit * setting.n_sites * len(names)
    return out


def as_alignment(sequences: DataFrame, genes: DataFrame, tips: list[str]) -> DataFrame:
    """replicate, name, species, gene, seq of the tips' genes. ``genes``: gene, orlg."""
    g = genes.select(F.get(F.split("gene", "__"), F.lit(0)).alias("node"), F.get(F.split("gene", "__"), F.lit(1)).alias("g"), "orlg", F.col("gene").alias("name"))
    return sequences.filter(F.col("node").isin(tips)).join(F.broadcast(g), ["node", "orlg"]).select("replicate", "name", F.col("node").alias("species"), F.col("g").alias("gene"), "seq")  # genes: a row a tip


def fingerprint(sequences: DataFrame) -> int:
    """A checksum of the sequences, whatever their order; added up where they are."""
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in sequences.columns])
    return sequences.agg(F.coalesce(F.sum(F.crc32(row.cast("binary"))), F.lit(0))).first()[0]
