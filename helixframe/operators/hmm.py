"""Tracts by a hidden Markov model along sites (Rabiner, 1989): state 0 sites had no copy since the duplication.

Emissions and transitions are column arithmetic; the forward sum and the best score are folds over each group's ordered sites.
The groups are genes, whose sites fit a row. Paths and posteriors are made for many groups at a time, a site after the other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import log_sum_exp
from .encode import gaps
from .estimate import over_grid

#: Rates of the model: numbers, or columns of the sites.
Rate = float | Column


def _column(x: Rate) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def transition(gap: Column, eta: Rate, p: Rate, length: float) -> dict[str, Column]:
    """Logs of the four transition probabilities over a gap of sites."""
    most = -2 * length * _column(eta) / _column(p)
    etl = F.exp(most)
    eel = F.exp(most * (1 - F.pow(1 - _column(p), gap)))
    p10 = etl * (1 - eel) / (1 - etl)
    return {"p00": F.log(eel), "p01": F.log(1 - eel), "p10": F.log(p10), "p11": F.log(1 - p10)}


def start(eta: Rate, p: Rate, length: float) -> tuple[Column, Column]:
    """Logs of the chances of states 0 and 1 at the first site."""
    ln0 = -2 * _column(eta) / _column(p) * length
    return ln0, F.log1p(-F.exp(ln0))


def emissions(lnl: Column, lnl_no: Column, eta: Rate, p: Rate, length: float) -> tuple[Column, Column]:
    """Logs of the emissions of states 0 and 1 from the likelihoods with and without copies; null where without is the larger."""
    ln0, ln1 = start(eta, p, length)
    return lnl_no - ln0, F.when(lnl_no <= lnl, lnl + F.log1p(-F.exp(lnl_no - lnl)) - ln1)


def tract_sites(with_copies: DataFrame, without: DataFrame, index: DataFrame, *, codon: bool = False) -> DataFrame:
    """site, nt_index, lnl, lnl_no: the two likelihoods of each site beside its place; a codon lies where its first symbol does."""
    at = index.filter("codon_site = 1").select(F.floor(F.col("site") / 3).cast("int").alias("site"), "nt_index") if codon else index.select("site", "nt_index")
    return with_copies.select("site", "lnl").join(without.select("site", F.col("lnl").alias("lnl_no")), "site").join(at, "site")


def impossible(sites: DataFrame) -> DataFrame:
    """The sites whose likelihood without copies is the larger: the model gives them none."""
    return sites.filter("lnl_no > lnl")


def lattice(sites: DataFrame, *, eta: Rate, p: Rate, length: float, group: str | Sequence[str] = "gene", codon: bool = False) -> DataFrame:
    """One row a group: ``first`` (logs of the start) and ``steps`` in order of site, each with emissions and the transition
    from the site before.

    ``sites``: group, site, nt_index, lnl (with copies) and lnl_no (without). Gaps are of nt_index, in codons when so. ``eta``
    and ``p`` may be columns of the sites that are the same throughout a group.
    """
    keys = [group] if isinstance(group, str) else list(group)
    gap = F.floor(F.col("gap") / 3) if codon else F.col("gap")
    rows = gaps(sites, *keys).withColumn("gap", F.coalesce(gap, F.lit(1)).cast("double"))
    e0, e1 = emissions(F.col("lnl"), F.col("lnl_no"), eta, p, length)
    ln0, ln1 = start(eta, p, length)
    step = F.struct("site", e0.alias("e0"), e1.alias("e1"), F.col("lnl"), *[c.alias(n) for n, c in transition(F.col("gap"), eta, p, length).items()])
    return rows.groupBy(*keys).agg(F.first(F.struct(ln0.alias("a"), ln1.alias("b"))).alias("first"), F.array_sort(F.collect_list(step)).alias("steps"))


def _fold(lattice_: DataFrame, join, end) -> Column:
    """A fold over the steps that carries a log for each state; ``join`` makes one of the two that lead to a state."""
    x = F.get("steps", F.lit(0))
    zero = F.struct((x["e0"] + F.col("first.a")).alias("a"), (x["e1"] + F.col("first.b")).alias("b"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((x["e0"] + join(s["a"] + x["p00"], s["b"] + x["p10"])).alias("a"), (x["e1"] + join(s["a"] + x["p01"], s["b"] + x["p11"])).alias("b"))

    return F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), zero, step, end)


def _others(lattice_: DataFrame) -> list[str]:
    return [c for c in lattice_.columns if c not in ("first", "steps")]


def forward(lattice_: DataFrame) -> DataFrame:
    """The columns of the groups and lnl: a fold that carries the two forward logs."""
    both = lambda x, y: log_sum_exp([x, y])
    return lattice_.select(*_others(lattice_), _fold(lattice_, both, lambda s: both(s["a"], s["b"])).alias("lnl"))


def viterbi(lattice_: DataFrame) -> DataFrame:
    """The columns of the groups, score (log) and last_state of the best path; ties go to state 0."""
    got = _fold(lattice_, F.greatest, lambda s: F.struct(F.greatest(s["a"], s["b"]).alias("score"), F.when(s["b"] > s["a"], 1).otherwise(0).alias("last_state")))
    return lattice_.select(*_others(lattice_), got.alias("__best")).select(*_others(lattice_), "__best.score", "__best.last_state")


def _messages(first: np.ndarray, e: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """forward, backward (group, site, state), path and score of groups of n sites each, padded to one length.

    ``e``: emissions (group, site, state); ``t``: transitions into a site (group, site, from, to).
    """
    g, most = e.shape[:2]
    f, b, v = np.zeros((g, most, 2)), np.zeros((g, most, 2)), np.zeros((g, most, 2))
    back = np.zeros((g, most, 2), dtype=np.int8)
    f[:, 0] = v[:, 0] = first + e[:, 0]
    for k in range(1, most):
        f[:, k] = e[:, k] + np.logaddexp(f[:, k - 1, :1] + t[:, k, 0], f[:, k - 1, 1:] + t[:, k, 1])
        c = v[:, k - 1, :, None] + t[:, k]
        back[:, k] = c.argmax(axis=1)
        v[:, k] = e[:, k] + c.max(axis=1)
    path = np.zeros((g, most), dtype=np.int32)
    rows, last = np.arange(g), n - 1
    path[rows, last] = v[rows, last].argmax(axis=1)
    for k in range(most - 2, -1, -1):
        inside = k < last
        x = e[:, k + 1] + b[:, k + 1]
        b[:, k] = np.where(inside[:, None], np.logaddexp(t[:, k + 1, :, 0] + x[:, :1], t[:, k + 1, :, 1] + x[:, 1:]), 0.0)
        path[:, k] = np.where(inside, back[rows, k + 1, path[:, k + 1]], path[:, k])
    return f, b, path, v[rows, last].max(axis=1)


def decode(lattice_: DataFrame, *, most: int = 400_000) -> DataFrame:
    """The columns of the groups, site, state (Viterbi; ties to state 0), score (of the whole path), forward and backward logs
    of the two states, posterior probability of state 1, and the logs of both states less the site's own lnL.

    The groups of a batch are padded to one length and go along their sites together, at most ``most`` sites at a time.
    """
    keys = _others(lattice_)

    def each(rows: pa.RecordBatch, order: np.ndarray) -> pa.RecordBatch:
        rows = rows.take(pa.array(order))
        steps = rows.column(rows.num_columns - 1)
        flat = steps.flatten()
        value = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        n = np.diff(steps.offsets.to_numpy())
        g, long = len(n), int(n.max())
        of, at = np.repeat(np.arange(g), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        e, t = np.zeros((g, long, 2)), np.zeros((g, long, 2, 2))
        for k in (0, 1):
            e[of, at, k] = value(f"e{k}")
            for m in (0, 1):
                t[of, at, k, m] = value(f"p{k}{m}")
        first = rows.column(rows.num_columns - 2)
        f, b, path, score = _messages(np.stack([first.field(c).to_numpy(zero_copy_only=False) for c in "ab"], axis=1), e, t, n)
        f, b = f[of, at], b[of, at]
        total = np.logaddexp(*f[np.cumsum(n) - 1].T)
        own = value("lnl")
        made = {"site": flat.field("site"), "state": path[of, at], "score": score[of], "f0": f[:, 0], "f1": f[:, 1], "b0": b[:, 0], "b1": b[:, 1], "posterior": np.exp(f[:, 1] + b[:, 1] - total[of]), "d0": f[:, 0] + b[:, 0] - own, "d1": f[:, 1] + b[:, 1] - own}
        return pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(of)) for k in range(len(keys))), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], names=[*keys, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = np.diff(rows.column(rows.num_columns - 1).offsets.to_numpy())
            order = np.argsort(n, kind="stable")
            order = order[n[order] > 0]
            while len(order):  # of the longest groups as many as fit
                k = max(1, min(len(order), most // int(n[order[-1]])))
                yield each(rows, order[-k:])
                order = order[:-k]

    kinds = dict(lattice_.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return lattice_.select(*keys, "first", "steps").mapInArrow(run, f"{schema}, site int, state int, score double, f0 double, f1 double, b0 double, b1 double, posterior double, d0 double, d1 double")


def surface(sites: DataFrame, *, tau: float, length: float, log_p: list[float], group: str = "gene", codon: bool = False) -> DataFrame:
    """log_p, group, lnl over a grid of tract parameters at fixed tau (eta = tau * p). The sites are crossed with the grid, so
    that the plan does not grow with it."""
    rows = over_grid(sites, {k: {"log_p": lp, "p": float(np.exp(lp))} for k, lp in enumerate(log_p)})
    got = forward(lattice(rows, eta=tau * F.col("p"), p=F.col("p"), length=length, group=[group, "eval_id", "log_p"], codon=codon))
    return got.select("log_p", group, "lnl")
