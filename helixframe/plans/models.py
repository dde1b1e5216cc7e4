"""Models: parameter vectors on a log scale, their names and bounds, and the scenes that they stand for."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import rates
from ..operators.histories import Configuration, accessible_pairs, configurations, processes
from ..operators.engine import Plan
from ..operators.kernel import CodonPairScene, Scene
from ..sources.newick import Tree, post_duplication_edges
from ..sources.newick import report as tree_report


@dataclass
class Model:
    """``x`` is named by ``names``: frequencies, kappa (and omega), rates by codon position, copy rates, then lengths.

    ``force`` holds parameters at real values by their place in x. ``axes`` are those of the patterns.
    """

    tree: Tree
    axes: list[tuple[str, int]]
    rate_variation: bool = False
    force: dict[int, float] = field(default_factory=dict)
    transformation: str = "log"

    @property
    def edges(self) -> list[tuple[str, str]]:
        return self.tree.sorted_edges()

    def process_names(self) -> list[str]:
        return ["%AG", "%A", "%C", "kappa", *(["r2", "r3"] if self.rate_variation else [])]

    def length_names(self) -> list[str]:
        return [f"{a}__{b}" for a, b in self.edges]

    @property
    def names(self) -> list[str]:
        return self.process_names() + self.length_names()

    def _plain(self) -> int:
        """How many parameters at the front stay as they are: under Exp_Neg the shares."""
        return 3 if self.transformation == "Exp_Neg" else 0

    def real(self, x: np.ndarray) -> np.ndarray:
        """x on its real scale, with what is forced."""
        x = np.asarray(x, dtype=float)
        if len(x) != len(self.names):
            raise ValueError(f"{len(x)} parameters for {len(self.names)} names")
        v = np.exp(x) if self.transformation == "log" else -np.log(x) if self.transformation == "Exp_Neg" else x.copy()
        v[: self._plain()] = x[: self._plain()]
        for k, f in self.force.items():
            if not 0 <= k < len(v):
                raise ValueError(f"no parameter {k} to force")
            v[k] = f
        if not (np.all((v[:3] > 0) & (v[:3] < 1)) and np.all(v[3:] >= 0)):
            raise ValueError("shares lie between 0 and 1, and all else is not negative")
        return v

    def scaled(self, v: np.ndarray) -> np.ndarray:
        """The x of real values: what real undoes."""
        v = np.asarray(v, dtype=float)
        with np.errstate(divide="ignore"):
            x = np.log(v) if self.transformation == "log" else np.exp(-v) if self.transformation == "Exp_Neg" else v.copy()
        x[: self._plain()] = v[: self._plain()]
        return x

    def slopes(self, x: np.ndarray) -> np.ndarray:
        """Derivatives of the logarithms of the real values by x."""
        x = np.asarray(x, dtype=float)
        if self.transformation == "log":
            return np.ones_like(x)
        v = self.real(x)
        out = 1 / v if self.transformation != "Exp_Neg" else -1 / (x * v)
        out[: self._plain()] = 1 / v[: self._plain()]
        return out

    def named(self, x: np.ndarray) -> dict[str, float]:
        return dict(zip(self.names, self.real(x).tolist()))

    def free(self) -> list[int]:
        return [k for k in range(len(self.names)) if k not in self.force]

    def limits(self) -> list[tuple[float, float]]:
        """Least and greatest real values: shares below 1, lengths and rates within what can be told from data, tract
        parameters up to 1."""
        return [(1e-3, 0.999) if n.startswith("%") else (1e-9, 20.0) if "__" in n else (1e-9, 1.0) if n == "tract_p" else (1e-6, 1e4) for n in self.names]

    def bounds(self) -> list[tuple[float, float]]:
        """The limits on the scale of x. Where they fall as values rise, they change places."""
        lo, hi = (self.scaled(np.array(v)) for v in zip(*self.limits()))
        return [(float(min(a, b)), float(max(a, b))) for a, b in zip(lo, hi)]

    def at_bounds(self, x: np.ndarray, within: float = 1e-6) -> list[str]:
        """The parameters that stand at one of their bounds: an optimum there is no stationary point."""
        return [n for k, (n, v, (lo, hi)) in enumerate(zip(self.names, x, self.bounds())) if k not in self.force and (v <= lo + within or v >= hi - within)]

    def start(self, frequencies: np.ndarray | None = None, length: float = 0.01) -> np.ndarray:
        """Frequencies from data if given, ratios near one, short lengths."""
        pi = np.full(4, 0.25) if frequencies is None else np.asarray(frequencies)
        first = {"%AG": pi[0] + pi[2], "%A": pi[0] / (pi[0] + pi[2]), "%C": pi[1] / (pi[1] + pi[3]), "kappa": 1.1, "omega": 0.9}
        return self.scaled(np.array([first.get(n, length if "__" in n else 1.4 if n.startswith("tau") else 0.5 if n == "tract_p" else 1.0) for n in self.names]))

    #: The columns that tell the groups of patterns apart.
    keys = ("codon_position",)

    def positions(self) -> dict[int, float]:
        return {1: 1.0, 2: 1.0, 3: 1.0} if self.rate_variation else {1: 1.0}

    def position_rates(self, v: dict[str, float]) -> dict[int, float]:
        return {1: 1.0, 2: v["r2"], 3: v["r3"]} if self.rate_variation else {1: 1.0}

    def group_names(self) -> list:
        """The groups of patterns, each with a scene of its own."""
        return list(self.positions())

    def scene(self, x: np.ndarray, group):
        """The scene of one group of patterns; none for a group that the model lacks."""
        raise NotImplementedError

    def scenes(self, x: np.ndarray) -> dict:
        return {g: self.scene(x, g) for g in self.group_names()}

    def plan(self, x: np.ndarray) -> Plan:
        """The scenes as what makes them."""
        x = np.asarray(x, dtype=float)
        self.real(x)  # what is wrong with x shows here and not in a task
        return Plan(self, x, len(self.group_names()))

    def edge_parameter(self) -> dict[int, int]:
        """For each edge the place in x of its length."""
        names = self.names
        return {k: names.index(f"{a}__{b}") if f"{a}__{b}" in names else names.index("root__both") for k, (a, b) in enumerate(self.edges)}

    def edge_share(self) -> dict[int, float]:
        """For each edge its part of the parameter that stands for it: the edges at the root may have one together."""
        names = self.names
        return {k: 1.0 if f"{a}__{b}" in names else 0.1 if b.startswith("D") else 0.9 for k, (a, b) in enumerate(self.edges)}

    def run_name(self, family: str = "") -> str:
        """What results of this model are filed under: the model, the family and the switches that are not as usual."""
        parts = [type(self).__name__.removesuffix("Model").lower(), family, "rv" if self.rate_variation else "", "" if self.transformation == "log" else self.transformation.lower()]
        parts += [f"{self.names[k]}={v:g}" for k, v in sorted(self.force.items())]
        return "_".join(p for p in [*parts, *self.switches()] if p)

    def switches(self) -> list[str]:
        return []

    def report(self, x: np.ndarray) -> str:
        """The model, its tree and its parameters as text."""
        lines = [self.run_name(), tree_report(self.tree, getattr(self, "confs", None))]
        return "\n".join([*lines, *(f"{n}\t{v:.6g}" + (" (forced)" if k in self.force else "") for k, (n, v) in enumerate(self.named(x).items()))])


@dataclass
class JointModel(Model):
    """Any number of paralogs under HKY with copies: one rate, one a pair, or one a direction (``copies``)."""

    event_group: dict[str, int] = field(default_factory=dict)
    copies: str = "one"
    root_split: bool = True  # the two lengths at the root are one parameter, a tenth before the duplication
    confs: dict[str, Configuration] = field(default_factory=dict)

    def __post_init__(self):
        if not self.confs:
            self.confs = configurations(self.tree, self.event_group)
        self.pairs = accessible_pairs(list(self.confs.values()))
        self.kinds, self.of = processes(self.tree, self.confs)

    def copy_names(self) -> list[str]:
        both = [*self.pairs, *[p[::-1] for p in self.pairs]]
        return {"one": ["tau"], "symmetric": [f"tau_{a}_{b}" for a, b in self.pairs], "general": [f"tau_{a}_{b}" for a, b in both]}[self.copies]

    def process_names(self) -> list[str]:
        return super().process_names() + self.copy_names()

    def _root_edges(self) -> list[tuple[str, str]]:
        r = self.tree.root
        found = [e for e in self.edges if e[0] == r]
        return found if self.root_split and len(found) == 2 and any(c.startswith("D") for _, c in found) else []

    def length_names(self) -> list[str]:
        at = self._root_edges()
        return (["root__both"] if at else []) + [f"{a}__{b}" for a, b in self.edges if (a, b) not in at]

    def lengths(self, v: dict[str, float]) -> np.ndarray:
        at = self._root_edges()
        out = []
        for e in self.edges:
            out.append(v["root__both"] * (0.1 if e[1].startswith("D") else 0.9) if e in at else v[f"{e[0]}__{e[1]}"])
        return np.array(out)

    def switches(self) -> list[str]:
        return [] if self.copies == "one" else [self.copies]

    def scene(self, x: np.ndarray, group) -> Scene | None:
        v = self.named(x)
        rate = self.position_rates(v).get(group)
        if rate is None:
            return None
        pi = rates.base_frequencies(v["%AG"], v["%A"], v["%C"])
        q = rates.hky(pi, v["kappa"])
        tau = rates.copy_rates(self.copies, self.pairs, np.array([v[n] for n in self.copy_names()]))
        ps = [rates.joint(c, q * rate, tau) for c in self.kinds]
        shape = (4,) * len(self.kinds[0])
        rewards = {"copies": [p.copy_share() for p in ps], "mutations": [p.mutation_share() for p in ps]}
        rewards |= {f"copies_{a}_{b}": [p.copy_share([(a, b)]) for p in ps] for a, b in tau}
        same = (rates.states(len(shape)) == rates.states(len(shape))[:, :1]).all(axis=1).astype(float)
        dwell = {"unlike": [2 * (1 - same)] * len(ps), "alike": [2 * same] * len(ps)}
        prior = rates.root_prior(self.confs[self.tree.root], pi)
        return Scene(self.edges, self.lengths(v), [self.of[e] for e in self.edges], [p.q for p in ps], prior, shape, self.axes, rewards, dwell)


@dataclass
class CodonModel(Model):
    """Two paralogs of codons under Muse-Gaut with copies; both are there on edges into or below ``duplicated``.

    ``selection``: how a copy that changes the amino acid counts: ``none`` tau, ``omega`` omega * tau, ``own`` by a
    parameter of its own, ``joint`` one parameter for the product, ``homo`` by the parameter that also selects the
    mutations towards the other copy's amino acid.
    """

    duplicated: str = "N1"
    selection: str = "none"
    edge_order: list[tuple[str, str]] = field(default_factory=list)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return self.edge_order or self.tree.sorted_edges()

    def process_names(self) -> list[str]:
        return ["%AG", "%A", "%C", "kappa", "omega", *{"own": ["omega_copy"], "joint": ["tau_omega"], "homo": ["omega_homo"]}.get(self.selection, []), "tau"]

    def switches(self) -> list[str]:
        return [] if self.selection == "none" else [self.selection]

    def scene(self, x: np.ndarray, group) -> CodonPairScene | None:
        if group != 1:
            return None
        v = self.named(x)
        pi = rates.base_frequencies(v["%AG"], v["%A"], v["%C"])
        other = {"none": v["tau"], "omega": v["omega"] * v["tau"], "own": v.get("omega_copy", 1.0) * v["tau"], "joint": v.get("tau_omega"), "homo": v.get("omega_homo", 1.0) * v["tau"]}[self.selection]
        q, t = rates.codon_pair(rates.mg94(pi, v["kappa"], v["omega"]), v["tau"], other)
        if self.selection == "homo":
            q = rates.homogenising(pi, v["kappa"], v["omega"], v["omega_homo"])
        post = post_duplication_edges(self.tree, self.duplicated)
        lengths = np.array([v[f"{a}__{b}"] for a, b in self.edges])
        return CodonPairScene(self.edges, lengths, [e in post for e in self.edges], q, t, rates.codon_frequencies(pi), self.axes)

    def positions(self) -> dict[int, float]:
        return {1: 1.0}  # a codon is one site


@dataclass
class PairSiteModel(Model):
    """Two paralogs at two positions n apart: copied tracts of geometric length may cover both. Groups are (space, cs_i, cs_j)."""

    root_split: bool = True
    groups: list[tuple[int, int, int]] = field(default_factory=list)

    def process_names(self) -> list[str]:
        return super().process_names() + ["init_rate", "tract_p"]

    def _root_edges(self) -> list[tuple[str, str]]:
        return [e for e in self.edges if e[0] == self.tree.root] if self.root_split else []

    def length_names(self) -> list[str]:
        at = self._root_edges()
        return (["root__both"] if at else []) + [f"{a}__{b}" for a, b in self.edges if (a, b) not in at]

    keys = ("space", "cs_i", "cs_j")

    def group_names(self) -> list:
        return list(self.groups)

    def scene(self, x: np.ndarray, group) -> Scene | None:
        if self.groups and group not in self._known():
            return None
        space, a, b = group
        v = self.named(x)
        pi = rates.base_frequencies(v["%AG"], v["%A"], v["%C"])
        q = rates.hky(pi, v["kappa"])
        r = self.position_rates(v) if self.rate_variation else {}
        at = self._root_edges()
        lengths = np.array([v["root__both"] * (0.1 if e[1].startswith("D") else 0.9) if e in at else v[f"{e[0]}__{e[1]}"] for e in self.edges])
        below = post_duplication_edges(self.tree, next(c for _, c in self.tree.edges if c.startswith("D")))
        dup = next(e for e in self.edges if e[1].startswith("D"))
        qa, qb = q * r.get(a, 1.0), q * r.get(b, 1.0)
        paired = rates.pair_site(qa, qb, space, v["init_rate"], v["tract_p"])
        single = rates.pair_site_single(qa, qb)
        same = rates.states(4)
        prior = np.where((same[:, 0] == same[:, 2]) & (same[:, 1] == same[:, 3]), pi[same[:, 0]] * pi[same[:, 1]], 0.0)
        use = [int(e in below and e != dup) for e in self.edges]
        rewards = {"copies": [np.zeros_like(single), paired.copy_share()], "mutations": [np.ones_like(single), paired.mutation_share()]}
        rewards |= {f"copies_{c}_{d}": [np.zeros_like(single), paired.copy_share([(c, d)])] for c, d in paired.copies}
        return Scene(self.edges, lengths, use, [rates.generator(single), paired.q], prior, (4,) * 4, self.axes, rewards)

    def _known(self) -> set:
        return set(self.groups)


def three_epoch_model(tree: Tree, axes: list[tuple[str, int]], **kw) -> JointModel:
    """Three paralogs under HKY with a rate for every direction, below a tree made by ``three_epochs``: one gene above N1, two
    from the first duplication on, three from the second. The second duplicates the second of the two copies.

    The two copies before the second duplication have two directed rates of their own beside the six among the three.
    """
    from ..sources.newick import splice, three_epochs

    whole = splice(three_epochs(tree), [("N0_N1", ["D1"]), ("N1_N2", ["D2"])])
    return JointModel(whole, axes, event_group={"D1": 0, "D2": 1}, copies="general", root_split=False, **kw)


def logit_tract(x: np.ndarray) -> np.ndarray:
    """ln init_rate and ln tract_p from (ln tau, logit tract_p)."""
    s = math.log1p(math.exp(x[1]))
    return np.array([x[0] + x[1] - s, x[1] - s])


def lengths_from_clock(tree: Tree, spine: list[str], height: float, ratios: list[float]) -> dict[tuple[str, str], float]:
    """Lengths under a clock: node k of the spine lies at height times the product of the first k ratios over the tips."""
    at = {spine[0]: height}
    for k, n in enumerate(spine[1:]):
        at[n] = at[spine[k]] * ratios[k]
    return {(a, b): at[a] - at.get(b, 0.0) for a, b in tree.edges}


def clock_heights(rows: DataFrame, by: str, *order: str, ratio: Column) -> DataFrame:
    """rows with ``log_height``: the logarithm of the product of the ratios so far, in the given order within each group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("log_height", F.sum(F.log(ratio)).over(w))


def clock_gradient(by_length: dict[tuple[str, str], float], tree: Tree, spine: list[str], height: float, ratios: list[float]) -> np.ndarray:
    """Derivatives by ln(height) and by the logs of the ratios, from those by the logs of the lengths."""
    at = [height]
    for r in ratios:
        at.append(at[-1] * r)
    place = dict(zip(spine, at))
    length = lengths_from_clock(tree, spine, height, ratios)
    out = np.zeros(1 + len(ratios))
    for (a, b), g in by_length.items():
        slope = g / length[a, b]  # by the length itself
        for k in range(len(out)):
            ka, kb = spine.index(a), spine.index(b) if b in place else -1
            out[k] += slope * ((place[a] if k <= ka else 0.0) - (place[b] if 0 <= kb and k <= kb else 0.0))
    return out


def no_copy_lnl(lnl_without: float | np.ndarray, tau: float, length: float):
    """lnL that no copy happens in ``length`` after the duplication: that at tau = 0, less 2 tau length."""
    return lnl_without - 2 * tau * length
