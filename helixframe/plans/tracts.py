"""Tracts in two steps: likelihoods of sites apart, with and without copies, then a hidden Markov model of their lattice."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import engine, hmm
from .models import JointModel, no_copy_lnl


def site_likelihoods(obs: DataFrame, patterns: DataFrame, model: JointModel, x: np.ndarray, index: DataFrame) -> DataFrame:
    """gene, site, nt_index, lnl, lnl_no. Without copies is tau = 0, less what it costs that none happened on any branch below
    the duplication."""
    names = model.names
    zero = np.array(x, dtype=float)
    zero[names.index("tau")] = -np.inf
    v = model.named(x)
    post = length_below(model, x)
    lnl = engine.sitewise(obs, patterns, model.scenes(x))
    without = engine.sitewise(obs, patterns, model.scenes(zero))
    sites = hmm.tract_sites(lnl, without.withColumn("lnl", F.col("lnl") + float(no_copy_lnl(0.0, v["tau"], post))), index)
    return sites.withColumn("gene", F.lit("gene"))


def length_below(model: JointModel, x: np.ndarray) -> float:
    return float(sum(t for (a, _), t in zip(model.edges, model.lengths(model.named(x))) if a != model.tree.root))


def fit_tract(sites: DataFrame, tau: float, length: float, *, low: float = math.log(1e-3), rounds: int = 3, points: int = 9) -> tuple[float, float]:
    """ln p and lnL of the best tract parameter at fixed tau, by a grid that closes in; each grid is one job."""
    a, b = low, 0.0
    best = (0.0, -math.inf)
    for _ in range(rounds):
        grid = np.linspace(a, b, points).tolist()
        got = {r["log_p"]: r["lnl"] for r in hmm.surface(sites, tau=tau, length=length, log_p=grid).groupBy("log_p").agg(F.sum("lnl").alias("lnl")).collect()}  # a row a point
        k = max(range(points), key=lambda k: got[grid[k]])
        best = max(best, (grid[k], got[grid[k]]), key=lambda r: r[1])
        a, b = grid[max(k - 1, 0)], grid[min(k + 1, points - 1)]
    return best
