"""Estimation: gradients, bounded optimisers, information matrices. Every gradient, Hessian or population is one job."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import Model, clock_gradient, lengths_from_clock
from . import engine

#: Values of an objective at several points.
Batch = Callable[[dict[int, np.ndarray]], dict[int, float]]


def objective(patterns: DataFrame, model: Model, **kw) -> Batch:
    """lnL of parameter vectors by number, in one job."""

    def values(points: dict[int, np.ndarray]) -> dict[int, float]:
        return engine.log_likelihood(patterns, {k: model.plan(x) for k, x in points.items()}, **({"keys": model.keys} | kw))

    return values


def gradient(values: Batch, x: np.ndarray, free: Sequence[int], step: float = 1e-6) -> tuple[float, np.ndarray]:
    """Value and central differences at x; 0 for what is not free."""
    points = {0: x}
    for k in free:
        for s in (0, 1):
            y = x.copy()
            y[k] += step * (1 - 2 * s)
            points[1 + 2 * k + s] = y
    f = values(points)
    g = np.zeros(len(x))
    for k in free:
        g[k] = (f[1 + 2 * k] - f[2 + 2 * k]) / (2 * step)
    return f[0], g


def gradient_with_lengths(patterns: DataFrame, model: Model, x: np.ndarray, step: float = 1e-6) -> tuple[float, np.ndarray]:
    """As gradient, with the derivatives by the lengths from the messages. Where one parameter stands for several edges their
    derivatives add up; those by ln(length) are carried over to the scale of x."""
    x = np.asarray(x, dtype=float)
    of = model.edge_parameter()
    lengths = set(of.values())
    f, g = gradient(objective(patterns, model), x, [k for k in model.free() if k not in lengths], step)
    slopes = model.slopes(x)
    for edge, v in engine.per_edge(patterns, model.plan(x), "derivative", keys=model.keys).items():
        if of[edge] not in model.force:
            g[of[edge]] += v * slopes[of[edge]]
    return f, g


def minimise(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, bounds: Sequence[tuple[float, float]], *, rounds: int = 200, memory: int = 10, tolerance: float = 1e-7, log: Callable[[int, float, np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, float]:
    """Bounded minimum by limited-memory quasi-Newton steps, projected on the bounds (after Byrd, Lu, Nocedal and Zhu, 1995)."""
    lo, hi = np.array(bounds, dtype=float).T
    x = np.clip(np.asarray(x, dtype=float), lo, hi)
    f, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(rounds):
        if log:
            log(k, f, x, g)
        stuck = ((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0))
        if np.abs(np.where(stuck, 0, g)).max() < 1e-5:
            break
        d = np.where(stuck, 0.0, g)
        alphas = []
        for s, y in reversed(pairs):
            a = (s @ d) / (y @ s)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - (y @ d) / (y @ s))
        d = np.where(stuck, 0.0, -d)
        if d @ g >= 0:
            pairs, d = [], np.where(stuck, 0.0, -g)
        step = 1.0 if pairs else min(1.0, 0.5 / max(np.abs(d).max(), 1e-12))
        for _ in range(25):
            new = np.clip(x + step * d, lo, hi)
            fn, gn = fun(new)
            if np.isfinite(fn) and fn <= f + 1e-4 * (g @ (new - x)):
                break
            step /= 3
        else:
            if not pairs:
                break
            pairs = []  # try once more, straight down
            continue
        s, y = new - x, gn - g
        pairs = [*pairs[-memory + 1 :], (s, y)] if s @ y > 1e-12 else []  # no curvature to learn from: start over
        done = f - fn <= tolerance * max(1.0, abs(f))
        x, f, g = new, fn, gn
        if done:
            break
    return x, f


def fit(patterns: DataFrame, model: Model, x: np.ndarray | None = None, *, save: str | None = None, every: int = 2, history: str | None = None, **kw) -> tuple[np.ndarray, float]:
    """Maximum likelihood: x and lnL. With ``save`` x is written every so many rounds, and a run that was cut short goes on
    there; ``history`` is a text file that each round adds its lnL, x and gradient to."""
    from ..sources.tables import load_x, save_x

    held = load_x(save) if save else None
    x = held if held is not None else model.start() if x is None else np.asarray(x, dtype=float)

    def fun(v: np.ndarray) -> tuple[float, np.ndarray]:
        f, g = gradient_with_lengths(patterns, model, v)
        return -f, -g

    def log(k: int, f: float, v: np.ndarray, g: np.ndarray) -> None:
        if save and k % every == 0:
            save_x(v, save)
        if history:
            with open(history, "a") as h:
                h.write("\t".join(f"{n:.12g}" for n in (-f, *v, *-g)) + "\n")

    bounds = [(v, v) if k in model.force else b for (k, b), v in zip(enumerate(model.bounds()), x)]
    x, f = minimise(fun, x, bounds, log=log, **kw)
    if save:
        save_x(x, save)
    return x, -f


def basin_hopping(run: Callable[[np.ndarray], tuple[np.ndarray, float]], x: np.ndarray, bounds, *, hops: int = 20, size: float = 0.5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Best of minima from starts shaken about the best one so far."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array(bounds, dtype=float).T
    best = run(x)
    for _ in range(hops):
        got = run(np.clip(best[0] + rng.uniform(-size, size, len(x)), lo, hi))
        best = min(best, got, key=lambda r: r[1])
    return best


def differential_evolution(values: Batch, bounds: Sequence[tuple[float, float]], *, size: int = 20, rounds: int = 50, seed: int = 0, weight: float = 0.7, cross: float = 0.8) -> tuple[np.ndarray, float]:
    """Maximum by differential evolution; a generation is one job."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array(bounds, dtype=float).T
    pop = rng.uniform(lo, hi, (size, len(lo)))
    f = values(dict(enumerate(pop)))
    score = np.array([f[k] for k in range(size)])
    for _ in range(rounds):
        a, b, c = (pop[rng.permutation(size)] for _ in range(3))
        trial = np.clip(np.where(rng.random(pop.shape) < cross, a + weight * (b - c), pop), lo, hi)
        f = values(dict(enumerate(trial)))
        new = np.array([f[k] for k in range(size)])
        better = new > score
        pop[better], score[better] = trial[better], new[better]
    k = int(score.argmax())
    return pop[k], float(score[k])


def length_em(patterns: DataFrame, model: Model, x: np.ndarray, *, rounds: int = 5) -> np.ndarray:
    """x with lengths improved by expectation and maximisation: expected jumps of an edge over its expected exit rate."""
    x = np.array(x, dtype=float)
    of, share = model.edge_parameter(), model.edge_share()
    for _ in range(rounds):
        plan = model.plan(x)
        jumps = engine.per_edge(patterns, plan, "events", "all", keys=model.keys)
        exits = engine.per_edge(patterns, plan, "dwell", "exit", keys=model.keys)
        v = model.real(x)
        for k in set(of.values()) - set(model.force):  # edges of one parameter are summed, by their shares of it
            most = sum(exits[e] * share[e] for e in of if of[e] == k)
            if most > 0:
                v[k] = max(sum(jumps[e] for e in of if of[e] == k) / most, 1e-12)
        x = np.where([k in model.force for k in range(len(x))], x, model.scaled(v))
    return x


def over_grid(rows: DataFrame, points: dict[int, dict[str, float]]) -> DataFrame:
    """rows once for each point of a grid, with eval_id and the point's parameters as columns. The grid is part of the plan:
    a point a row that it is crossed with, and no shuffle."""
    names = sorted({n for p in points.values() for n in p})
    grid = F.array(*[F.struct(F.lit(k).alias("eval_id"), *[F.lit(float(p[n])).alias(n) for n in names]) for k, p in points.items()])
    return rows.select("*", F.explode(grid).alias("__point")).select(*rows.columns, "__point.eval_id", *[f"__point.{n}" for n in names])


def moments(rows: DataFrame, *by: str, g: str = "g", k: int, n: str | None = None) -> DataFrame:
    """``by``, i, j, moment: the mean products of the entries of the gradients g (arrays of k), weighted by n."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.get(g, F.lit(i)) * F.get(g, F.lit(j))).alias("v")) for i in range(k) for j in range(k)])
    w = F.lit(1) if n is None else F.col(n)
    out = rows.select(*by, w.alias("__w"), F.explode(cells).alias("c")).groupBy(*by, F.col("c.i").alias("i"), F.col("c.j").alias("j"))
    return out.agg((F.sum(F.col("__w") * F.col("c.v")) / F.sum("__w")).alias("moment"))


def stencil(x: np.ndarray, size: float = 1e-5) -> tuple[dict[int, np.ndarray], Callable[[dict[int, np.ndarray]], tuple[np.ndarray, np.ndarray]]]:
    """Points for gradient and Hessian, and what makes these of the values there: diagonal by five points, the rest by four."""
    k = len(x)
    h = np.where(x == 0, size, np.abs(x) * size)
    points: dict[int, np.ndarray] = {}
    name: dict[tuple, int] = {}

    def at(*moves: tuple[int, float]) -> int:
        key = tuple(sorted(moves))
        if key not in name:
            y = x.copy()
            for i, m in key:
                y[i] += m * h[i]
            name[key] = len(points)
            points[name[key]] = y
        return name[key]

    at()
    for i in range(k):
        for m in (-2, -1, 1, 2):
            at((i, m))
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    at((i, a), (j, b))

    def of(f: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        g = np.stack([(f[at((i, 1))] - f[at((i, -1))]) / (2 * h[i]) for i in range(k)], axis=-1)
        hess = np.zeros((*g.shape, k))
        for i in range(k):
            hess[..., i, i] = (-f[at((i, 2))] + 16 * f[at((i, 1))] - 30 * f[at()] + 16 * f[at((i, -1))] - f[at((i, -2))]) / (12 * h[i] ** 2)
            for j in range(i):
                v = (f[at((i, 1), (j, 1))] - f[at((i, 1), (j, -1))] - f[at((i, -1), (j, 1))] + f[at((i, -1), (j, -1))]) / (4 * h[i] * h[j])
                hess[..., i, j] = hess[..., j, i] = v
        return g, hess

    return points, of


def pattern_moments(patterns: DataFrame, model: Model, x: np.ndarray, chosen: Sequence[int], *, transform: Callable[[np.ndarray], np.ndarray] | None = None, size: float = 1e-5, **kw) -> DataFrame:
    """The patterns with n, g (gradient) and h (Hessian, by rows) of lnL by the chosen parameters."""
    x = np.asarray(x, dtype=float)
    points, of = stencil(x[list(chosen)], size)

    def full(v: np.ndarray) -> np.ndarray:
        y = x.copy()
        y[list(chosen)] = v if transform is None else transform(v)
        return y

    kw = {"keys": model.keys} | kw
    values = engine.pattern_values(patterns, {k: model.plan(full(v)) for k, v in points.items()}, **kw)
    keys = list(kw["keys"])
    wide = values.groupBy(*keys, "pattern", "n").agg(F.map_from_entries(F.collect_list(F.struct("eval_id", "value"))).alias("v"))
    n = len(points)

    def run(batches):
        for b in batches:
            f = {k: np.array([r[k] for r in b["v"]]) for k in range(n)}
            g, h = of(f)
            b = b.drop(columns="v")
            b["g"], b["h"] = list(g), list(h.reshape(len(b), -1))
            yield b

    fields = ", ".join(f"{k} int" for k in keys)
    return wide.mapInPandas(run, f"{fields}, pattern array<int>, n long, g array<double>, h array<double>")


def godambe(rows: DataFrame, k: int) -> np.ndarray:
    """Of pattern_moments: H inverse(J) H with H the mean of minus the Hessians and J that of the gradients' products (Godambe, 1960)."""
    j = np.zeros((k, k))
    for r in moments(rows, k=k, n="n").collect():  # k x k rows
        j[r["i"], r["j"]] = r["moment"]
    r = rows.agg(*[(-F.sum(F.col("n") * F.get("h", F.lit(i))) / F.sum("n")).alias(f"h{i}") for i in range(k * k)]).first()
    h = np.array([r[f"h{i}"] for i in range(k * k)]).reshape(k, k)
    return h @ np.linalg.solve(j, h)


@dataclass
class Families:
    """A joint analysis: families under models of their own that share some parameters. x holds each family's own parameters
    first, then the shared ones. The families' patterns are one relation with a column ``family`` (their place in ``models``),
    so that all families and points are one job, and the plan is the same for two families as for thousands."""

    patterns: DataFrame
    models: dict[str, Model]
    shared: Sequence[str]

    def __post_init__(self):
        self.own = {f: [n for n in m.names if n not in self.shared] for f, m in self.models.items()}
        lacking = {f: sorted(set(self.shared) - set(m.names)) for f, m in self.models.items() if not set(self.shared) <= set(m.names)}
        if lacking:
            raise ValueError(f"families without some shared parameters: {lacking}")
        self.names = [f"{f}:{n}" for f in self.models for n in self.own[f]] + list(self.shared)
        self.place = {n: k for k, n in enumerate(self.names)}

    keys = ("family", "codon_position")

    def places(self, family: str) -> list[int]:
        """Where the parameters of a family's model stand in x."""
        return [self.place[n if n in self.shared else f"{family}:{n}"] for n in self.models[family].names]

    def scene(self, x: np.ndarray, group):
        family = list(self.models)[group[0]]
        return self.models[family].scene(np.asarray(x)[self.places(family)], group[1])

    def __getstate__(self):
        return self.__dict__ | {"patterns": None}  # tasks need the models alone

    def plan(self, x: np.ndarray) -> engine.Plan:
        return engine.Plan(self, np.asarray(x, dtype=float), sum(len(m.group_names()) for m in self.models.values()))

    def values(self, points: dict[int, np.ndarray]) -> dict[int, float]:
        return engine.log_likelihood(self.patterns, {k: self.plan(x) for k, x in points.items()}, keys=self.keys)

    def bounds(self) -> list[tuple[float, float]]:
        """Those of each model; for what is shared the narrowest of all."""
        lo, hi = np.full(len(self.names), -np.inf), np.full(len(self.names), np.inf)
        for f, m in self.models.items():
            a, b = np.array(m.bounds()).T
            at = self.places(f)
            lo[at], hi[at] = np.maximum(lo[at], a), np.minimum(hi[at], b)
        return list(zip(lo.tolist(), hi.tolist()))

    def start(self, length: float = 0.01) -> np.ndarray:
        x = np.zeros(len(self.names))
        for f, m in self.models.items():
            x[self.places(f)] = m.start(length=length)
        return x

    def gradient(self, x: np.ndarray, step: float = 1e-6) -> tuple[float, np.ndarray]:
        """lnL of all families and its derivatives: those by shared parameters are sums over the families.

        A family's own parameter moves that family alone, so the k-th parameters of all families are moved at once and each
        family's difference is read from its own sum: as many points as the largest model has parameters, whatever the number
        of families. Derivatives by lengths come from the messages.
        """
        x = np.asarray(x, dtype=float)
        number = {f: k for k, f in enumerate(self.models)}
        of = {f: m.edge_parameter() for f, m in self.models.items()}
        free = {f: [k for k in m.free() if k not in set(of[f].values())] for f, m in self.models.items()}
        points, moved = {0: self.plan(x)}, {}
        for name in self.shared:
            if any(name == m.names[k] for f, m in self.models.items() for k in free[f]):
                moved[name] = {f: self.place[name] for f in self.models}
        for k in range(max(map(len, self.own.values()), default=0)):
            at = {f: self.place[f"{f}:{self.own[f][k]}"] for f, m in self.models.items() if k < len(self.own[f]) and m.names.index(self.own[f][k]) in free[f]}
            if at:
                moved[k] = at
        for i, at in enumerate(moved.values()):
            for s in (0, 1):
                y = x.copy()
                y[list(set(at.values()))] += step * (1 - 2 * s)
                points[1 + 2 * i + s] = self.plan(y)
        rows = engine.totals(engine.pattern_values(self.patterns, points, keys=self.keys), "family").collect()  # a row a family and point
        f = {(r["eval_id"], r["family"]): r["value"] for r in rows}
        g = np.zeros(len(x))
        for i, at in enumerate(moved.values()):
            for family, place in at.items():
                key = number[family]
                if (0, key) in f:
                    g[place] += (f[1 + 2 * i, key] - f[2 + 2 * i, key]) / (2 * step)
        slopes = {name: m.slopes(x[self.places(name)]) for name, m in self.models.items()}
        names = list(self.models)
        for r in engine.totals(engine.pattern_values(self.patterns, {0: points[0]}, keys=self.keys, want="derivative"), "family").collect():  # a row a family and edge
            name = names[r["family"]]
            k = of[name][r["edge"]]
            if k not in self.models[name].force:
                g[self.places(name)[k]] += r["value"] * slopes[name][k]
        return sum(v for (p, _), v in f.items() if p == 0), g

    def fit(self, x: np.ndarray | None = None, **kw) -> tuple[np.ndarray, float]:
        """Maximum likelihood of all families together: x and lnL."""

        def fun(v: np.ndarray) -> tuple[float, np.ndarray]:
            f, g = self.gradient(v)
            return -f, -g

        x, f = minimise(fun, self.start() if x is None else x, self.bounds(), **kw)
        return x, -f


def families(tables: dict[str, tuple[DataFrame, Model]], shared: Sequence[str]) -> Families:
    """The joint analysis of some families, each with patterns of its own."""
    rows = None
    for k, (p, _) in enumerate(tables.values()):
        one = p.select(F.lit(k).alias("family"), "codon_position", "pattern", "n")
        rows = one if rows is None else rows.unionByName(one)
    return Families(rows, {f: m for f, (_, m) in tables.items()}, shared)


def fit_clock(patterns: DataFrame, model: Model, x: np.ndarray, spine: list[str], height: float, ratios: Sequence[float], **kw) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Maximum likelihood with the lengths under a clock: x, height, ratios and lnL.

    The lengths follow from the height of the root and the ratio of each inner node's height to that of the one above it;
    those are estimated (on log scale, ratios below 1) with the other parameters of the model. Edges that share one parameter
    of the model are not for a clock.
    """
    of = model.edge_parameter()
    if len(set(of.values())) != len(of):
        raise ValueError("a clock needs a length for each edge")
    others = [k for k in range(len(model.names)) if k not in set(of.values())]
    edges = list(model.edges)

    def whole(v: np.ndarray) -> np.ndarray:
        y = np.array(x, dtype=float)
        y[others] = v[: len(others)]
        real = model.real(y)
        lengths = lengths_from_clock(model.tree, spine, float(np.exp(v[len(others)])), np.exp(v[len(others) + 1 :]).tolist())
        for e, k in of.items():
            real[k] = max(lengths[edges[e]], 1e-9)
        out = model.scaled(real)
        out[others] = y[others]
        return out

    def fun(v: np.ndarray) -> tuple[float, np.ndarray]:
        y = whole(v)
        f, g = gradient_with_lengths(patterns, model, y)
        slopes = model.slopes(y)
        by = {edges[e]: g[k] / slopes[k] for e, k in of.items()}
        clock = clock_gradient(by, model.tree, spine, float(np.exp(v[len(others)])), np.exp(v[len(others) + 1 :]).tolist())
        return -f, -np.concatenate([g[others], clock])

    bounds = [(x[k], x[k]) if k in model.force else model.bounds()[k] for k in others] + [(np.log(1e-6), np.log(20.0))] + [(np.log(1e-3), np.log(0.999))] * len(ratios)
    v, f = minimise(fun, np.concatenate([np.asarray(x, dtype=float)[others], [np.log(height)], np.log(list(ratios))]), bounds, **kw)
    return whole(v), float(np.exp(v[len(others)])), np.exp(v[len(others) + 1 :]), -f


def fit_tract_of_pairs(patterns: DataFrame, model: Model, x: np.ndarray, *, dimensions: int = 1, rounds: int = 4, points: int = 9, low: float = math.log(1e-4), span: float = 2.0) -> tuple[np.ndarray, float]:
    """x and lnL with the tract parameter at its best: in one dimension at fixed init_rate / tract_p, the rate at which sites
    are copied; in two with init_rate as well, within ``span`` of its logarithm in x. A grid closes in; each is one job."""
    x = np.array(x, dtype=float)
    i, p = model.names.index("init_rate"), model.names.index("tract_p")
    real = model.real(x)
    values = objective(patterns, model)
    lo, hi = np.array([low, np.log(real[i]) - span]), np.array([0.0, np.log(real[i]) + span])
    best = (-math.inf, x)
    for _ in range(rounds):
        lp = np.linspace(lo[0], hi[0], points)
        li = np.log(real[i] / real[p]) + lp[:, None] if dimensions == 1 else np.broadcast_to(np.linspace(lo[1], hi[1], points), (points, points))
        grid = {}
        for a in range(points):
            for b in range(li.shape[1]):
                v = real.copy()
                v[p], v[i] = np.exp(lp[a]), np.exp(li[a, b])
                grid[a * li.shape[1] + b] = model.scaled(v)
        got = values(grid)
        k = max(grid, key=lambda k: got[k])
        best = max(best, (got[k], grid[k]), key=lambda r: r[0])
        a, b = divmod(k, li.shape[1])
        lo[0], hi[0] = lp[max(a - 1, 0)], lp[min(a + 1, points - 1)]
        if dimensions == 2:
            lo[1], hi[1] = li[a, max(b - 1, 0)], li[a, min(b + 1, points - 1)]
    return best[1], best[0]
