"""Evaluates scenes over pattern relations: every parameter point and every batch of patterns in one job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scenes of one parameter point, by group: the codon position, or (space, cs_i, cs_j) for pairs of sites.
Scenes = dict


@dataclass
class Plan:
    """The scenes of one parameter point as what makes them: a model and its parameters, some hundred numbers. A task makes the
    scenes of its own groups only, so that what is broadcast does not grow with the number of groups."""

    model: object
    x: np.ndarray
    groups: int = 1
    made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def __len__(self) -> int:
        return self.groups

    def scene(self, group):
        """The group's scene; a task remembers the last one, as its rows come by group."""
        if group not in self.made:
            self.made = {group: self.model.scene(self.x, group)}
        return self.made[group]


def _group(r, keys: list[str]):
    v = tuple(int(r[k]) for k in keys)
    return v[0] if len(v) == 1 else v


def _values(scene, x: np.ndarray, want: str, weights: str | None) -> np.ndarray:
    """What is wanted of each pattern and edge; scenes of every kind answer to the same names."""
    if want == "lnl":
        return scene.log_likelihoods(x)[:, None]
    if want == "derivative":
        return scene.edge_derivatives(x)
    if want == "events":
        return scene.expected_events(x, weights)
    if want == "dwell":
        return scene.dwell_fractions(x, weights)
    raise ValueError(f"lnl, derivative, events or dwell can be had, not {want}")


def pattern_values(patterns: DataFrame, evals: dict[int, Scenes | Plan], *, keys: tuple[str, ...] = ("codon_position",), want: str = "lnl", weights: str | None = None) -> DataFrame:
    """eval_id, the keys, pattern, n, edge and value, for every parameter point.

    ``want``: ``lnl`` (one value a pattern, edge -1), ``derivative`` (d lnL / d ln length of each edge), ``events`` or
    ``dwell`` (expected weighted jumps, or share of the edge, by the scene's weights of that name). What is sent to the tasks
    are the scenes or, lighter, ``Plan``s that make a group's scene in the task that needs it. Patterns are dealt out with the points, so that a
    gradient or a grid is one job; where points and groups are many, each goes to a task of its own, which then makes its
    matrices once, and where they are few each is cut into slices by pattern.
    """
    shared = patterns.sparkSession.sparkContext.broadcast(evals)
    keys_ = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            for group, rows in b.groupby(["eval_id", *keys_], sort=False):
                scenes = known[int(group[0])]
                at = _group(rows.iloc[0], keys_)
                scene = scenes.scene(at) if isinstance(scenes, Plan) else scenes.get(at)
                if scene is None:
                    continue
                x = np.stack(rows["pattern"].to_numpy()).astype(np.int64)
                v = _values(scene, x, want, weights)
                edges = np.array([-1]) if want == "lnl" else np.arange(v.shape[1])
                out = rows.loc[rows.index.repeat(len(edges))].copy()
                out["edge"] = np.tile(edges, len(rows))
                out["value"] = v.ravel()
                yield out

    dealt = patterns.select(F.explode(F.array(*[F.lit(int(k)) for k in sorted(evals)])).alias("eval_id"), *keys_, "pattern", "n")
    fields = ", ".join(f"{k} int" for k in keys_)
    dealt = dealt.select("eval_id", *[F.col(k).cast("int").alias(k) for k in keys_], F.col("pattern").cast("array<int>").alias("pattern"), F.col("n").cast("long").alias("n"))
    groups = sum(map(len, evals.values()))
    if groups > 3:  # more than one point: few patterns may lie in one partition
        width = patterns.sparkSession.sparkContext.defaultParallelism
        slices = max(1, width // groups)
        dealt = dealt.repartition(max(width, min(groups * slices, 8 * width)), "eval_id", *keys_, F.pmod(F.xxhash64("pattern"), F.lit(slices)))
    return dealt.mapInPandas(run, f"eval_id int, {fields}, pattern array<int>, n long, edge int, value double")


def totals(values: DataFrame, *by: str) -> DataFrame:
    """Sums of n * value by eval_id, edge and more columns."""
    return values.groupBy("eval_id", "edge", *by).agg(F.sum(F.col("n") * F.col("value")).alias("value"))


def log_likelihood(patterns: DataFrame, evals: dict[int, Scenes], **kw) -> dict[int, float]:
    """lnL of every parameter point."""
    return {r["eval_id"]: r["value"] for r in totals(pattern_values(patterns, evals, **kw)).collect()}  # a row a point


def sitewise(obs: DataFrame, patterns: DataFrame, scenes: Scenes | Plan) -> DataFrame:
    """site, lnl: each pattern's value joined back to its sites."""
    values = pattern_values(patterns, {0: scenes}).select("codon_position", "pattern", F.col("value").alias("lnl"))
    several = len(scenes) > 1
    at = obs.select("site", "pattern", ((F.pmod("site", F.lit(3)) + 1) if several else F.lit(1)).cast("int").alias("codon_position"))
    return at.join(values, ["codon_position", "pattern"]).select("site", "lnl")


def sitewise_edges(obs: DataFrame, patterns: DataFrame, scenes: Scenes, want: str, weights: str | None = None) -> DataFrame:
    """site, edge, value: expected events or dwell of each site and edge."""
    values = pattern_values(patterns, {0: scenes}, want=want, weights=weights).select("codon_position", "pattern", "edge", "value")
    at = obs.select("site", "pattern", ((F.pmod("site", F.lit(3)) + 1) if len(scenes) > 1 else F.lit(1)).cast("int").alias("codon_position"))
    return at.join(values, ["codon_position", "pattern"]).select("site", "edge", "value")


def posterior_matrix(rows: DataFrame, sites: list[int] | None = None) -> DataFrame:
    """A row an edge and a column a site; the long form is the one for many sites."""
    return rows.groupBy("edge").pivot("site", sites).agg(F.first("value"))


def distance_grid(pairs: DataFrame, evals: dict[float, Scenes]) -> DataFrame:
    """log_p, space, lnl: lnL of the pairs of each distance at each point of a grid, in one job."""
    number = dict(enumerate(sorted(evals)))
    values = pattern_values(pairs, {k: evals[p] for k, p in number.items()}, keys=("space", "cs_i", "cs_j"))
    names = F.create_map(*[c for k, p in number.items() for c in (F.lit(k), F.lit(float(p)))])
    return values.groupBy(F.element_at(names, F.col("eval_id")).alias("log_p"), "space").agg(F.sum(F.col("n") * F.col("value")).alias("lnl"))


def per_edge(patterns: DataFrame, scenes: Scenes | Plan, want: str, weights: str | None = None, *, keys: tuple[str, ...] = ("codon_position",)) -> dict[int, float]:
    return {r["edge"]: r["value"] for r in totals(pattern_values(patterns, {0: scenes}, keys=keys, want=want, weights=weights)).collect()}  # a row an edge


def branch_tau(events: dict[int, float], dwell: dict[int, float], lengths: np.ndarray) -> dict[int, float]:
    """Copies an edge over its length times the dwell; 0 where nothing can be copied."""
    return {k: (events[k] / (lengths[k] * dwell[k]) if dwell[k] * lengths[k] > 0 else 0.0) for k in events}
