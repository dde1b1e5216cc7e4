"""Likelihoods on a tree (Felsenstein, 1981), their derivatives, and expected events and dwell times, over site patterns.

A scene is all that a likelihood needs but the data. Scenes hold some small matrices and travel to the executors; patterns
are rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

import numpy as np

from ..functions.matrix import expm, generator, integral


def _root(edges: list[tuple[str, str]]) -> str:
    return next(p for p, _ in edges if p not in {c for _, c in edges})


def _order(edges: list[tuple[str, str]]) -> list[str]:
    """Nodes, parents first."""
    out = [_root(edges)]
    for n in out:
        out.extend(c for p, c in edges if p == n)
    return out


def _named(of: dict, which: str):
    if which not in of:
        raise KeyError(f"the scene has no {which}, only {sorted(of)}")
    return of[which]


@dataclass
class Scene:
    """A tree with a process on each edge. ``edges`` are in the order of ``lengths``; a process is a generator matrix."""

    edges: list[tuple[str, str]]
    lengths: np.ndarray
    process: list[int]  # of each edge
    q: list[np.ndarray]
    prior: np.ndarray
    shape: tuple[int, ...]
    axes: list[tuple[str, int]]  # of a pattern: node and position of the joint state
    rewards: dict[str, list[np.ndarray]] = field(default_factory=dict)  # for each process the weights of its jumps
    dwell: dict[str, list[np.ndarray]] = field(default_factory=dict)  # for each process the weights of its states

    @property
    def root(self) -> str:
        return _root(self.edges)

    def order(self) -> list[str]:
        return _order(self.edges)

    def log_likelihoods(self, patterns: np.ndarray) -> np.ndarray:
        return log_likelihoods(self, patterns)

    def edge_derivatives(self, patterns: np.ndarray) -> np.ndarray:
        return edge_derivatives(self, patterns)

    def expected_events(self, patterns: np.ndarray, which: str) -> np.ndarray:
        """Of the jumps that ``rewards`` names; ``all`` needs no name there."""
        return expected_events(self, patterns, [np.ones_like(q) for q in self.q] if which == "all" else _named(self.rewards, which))

    def dwell_fractions(self, patterns: np.ndarray, which: str) -> np.ndarray:
        """Of the weights that ``dwell`` names; ``exit``, the rates of leaving, need no name there."""
        return dwell_fractions(self, patterns, [-np.diag(q) for q in self.q] if which == "exit" else _named(self.dwell, which))

    def transition(self) -> list[np.ndarray]:
        """exp(q t) of each edge; equal ones are made once."""
        made: dict[tuple[int, float], np.ndarray] = {}
        for k, t in zip(self.process, self.lengths):
            if (k, t) not in made:
                made[k, t] = expm(self.q[k] * t)
        return [made[k, t] for k, t in zip(self.process, self.lengths)]


def to_json(scene: Scene | CodonPairScene) -> str:
    """The scene as JSON: matrices as lists of rows, so that a run can be kept and made again without its model."""
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else [plain(x) for x in v] if isinstance(v, list | tuple) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    return json.dumps({"kind": type(scene).__name__} | {f.name: plain(getattr(scene, f.name)) for f in fields(scene)})


def from_json(text: str) -> Scene | CodonPairScene:
    """What to_json wrote."""
    raw = json.loads(text)
    pairs = {k: [tuple(x) for x in raw[k]] for k in ("edges", "axes")}
    if raw.pop("kind") == "Scene":
        sets = {k: {n: [np.array(m) for m in ms] for n, ms in raw[k].items()} for k in ("rewards", "dwell")}
        return Scene(**raw | pairs | sets | {"lengths": np.array(raw["lengths"]), "q": [np.array(m) for m in raw["q"]], "prior": np.array(raw["prior"]), "shape": tuple(raw["shape"])})
    return CodonPairScene(**raw | pairs | {k: np.array(raw[k]) for k in ("lengths", "q", "t", "pi")})


def observed(scene: Scene, patterns: np.ndarray) -> dict[str, np.ndarray]:
    """For each node with data the compatible joint states of each pattern, as ones; -1 leaves a position open."""
    n = len(patterns)
    out: dict[str, np.ndarray] = {}
    for col, (node, pos) in enumerate(scene.axes):
        base = scene.shape[pos]
        seen = patterns[:, col]
        ok = np.where(seen[:, None] < 0, 1.0, np.arange(base)[None, :] == seen[:, None])
        shape = [n, *[base if k == pos else 1 for k in range(len(scene.shape))]]
        full = np.broadcast_to(ok.reshape(shape), (n, *scene.shape)).reshape(n, -1)
        out[node] = out[node] * full if node in out else full.copy()
    return out


@dataclass
class Messages:
    """Up messages below each node and scaled logs; down messages above each edge."""

    lnl: np.ndarray
    below: dict[str, np.ndarray]
    up: list[np.ndarray]
    down: list[np.ndarray]
    transition: list[np.ndarray]


def messages(scene: Scene, patterns: np.ndarray, *, down: bool = False) -> Messages:
    p = scene.transition()
    data = observed(scene, patterns)
    n, s = len(patterns), len(scene.prior)
    scale = np.zeros(n)
    below: dict[str, np.ndarray] = {}
    up: list = [None] * len(scene.edges)
    at: dict[str, list[int]] = {}
    for k, (a, _) in enumerate(scene.edges):
        at.setdefault(a, []).append(k)
    order = scene.order()
    for node in reversed(order):
        m = data.get(node)
        m = np.ones((n, s)) if m is None else m.copy()
        for k in at.get(node, ()):
            up[k] = below[scene.edges[k][1]] @ p[k].T
            m = m * up[k]
        top = m.max(axis=1)
        top[top == 0] = 1.0
        below[node] = m / top[:, None]
        scale += np.log(top)
    with np.errstate(divide="ignore"):
        lnl = np.log(below[scene.root] @ scene.prior) + scale
    above: list = [None] * len(scene.edges)
    if down:
        outer = {scene.root: np.broadcast_to(scene.prior, (n, s))}
        for node in order:
            own = data.get(node)
            for k in at.get(node, ()):
                a = outer[node] if own is None else outer[node] * own
                for j in at[node]:
                    if j != k:
                        a = a * up[j]
                top = a.max(axis=1, keepdims=True)
                top[top == 0] = 1.0
                above[k] = a / top
                outer[scene.edges[k][1]] = above[k] @ p[k]
    return Messages(lnl, below, up, above, p)


def log_likelihoods(scene: Scene, patterns: np.ndarray) -> np.ndarray:
    """Of each pattern."""
    return messages(scene, patterns).lnl


def _expected(m: Messages, k: int, child: str, inner: np.ndarray) -> np.ndarray:
    """Posterior expectation of what ``inner`` measures along edge k, for each pattern."""
    a, b = m.down[k], m.below[child]
    return np.einsum("ns,ns->n", a @ inner, b) / np.einsum("ns,ns->n", a @ m.transition[k], b)


def edge_derivatives(scene: Scene, patterns: np.ndarray) -> np.ndarray:
    """d lnL / d ln(length) of each pattern and edge."""
    m = messages(scene, patterns, down=True)
    return np.stack([t * _expected(m, k, c, scene.q[scene.process[k]] @ m.transition[k]) for k, ((_, c), t) in enumerate(zip(scene.edges, scene.lengths))], axis=1)


def expected_events(scene: Scene, patterns: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Posterior expected weighted number of jumps of each pattern and edge."""
    m = messages(scene, patterns, down=True)
    out = []
    for k, ((_, c), t) in enumerate(zip(scene.edges, scene.lengths)):
        q, w = scene.q[scene.process[k]], weights[scene.process[k]]
        jumps = np.where(np.eye(len(q), dtype=bool), 0.0, q * w)
        out.append(_expected(m, k, c, integral(q, jumps, t)))
    return np.stack(out, axis=1)


def dwell_fractions(scene: Scene, patterns: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Posterior expected weighted share of each edge spent in states, of each pattern and edge."""
    m = messages(scene, patterns, down=True)
    out = []
    for k, ((_, c), t) in enumerate(zip(scene.edges, scene.lengths)):
        q, w = scene.q[scene.process[k]], weights[scene.process[k]]
        out.append(_expected(m, k, c, integral(q, np.diag(w), t) / t if t > 0 else np.diag(w) @ m.transition[k]))
    return np.stack(out, axis=1)


@dataclass
class CodonPairScene:
    """Two codon copies that change by point rates and by copies of each other; edges before the duplication move both.

    Messages are 61 x 61 matrices and the pair generator is applied without being built: its exponential by Taylor steps, its
    integrals by the same steps on a message beside what the jumps or states of interest have gathered of it.
    """

    edges: list[tuple[str, str]]
    lengths: np.ndarray
    paired: list[bool]  # of each edge: whether both copies are there
    q: np.ndarray
    t: np.ndarray
    pi: np.ndarray
    axes: list[tuple[str, int]]

    @property
    def root(self) -> str:
        return _root(self.edges)

    @property
    def single(self) -> np.ndarray:
        """The rates of one copy alone; a selection by the other copy's amino acid does not act on it."""
        return self.q if self.q.ndim == 2 else np.stack([self.q[a, a] for a in range(len(self.q))])

    def _steps(self, k: int, m: np.ndarray, action, inner=None) -> tuple[np.ndarray, np.ndarray | None]:
        """exp of the action over edge k on m, and with ``inner`` the integral of exp(over what is left) inner exp(so far) m."""
        t = float(self.lengths[k])
        rate = 2 * float(self.q.sum(axis=-1).max() + self.t.max())
        steps = max(1, int(np.ceil(t * rate / 2.0)))
        h = t / steps
        got = None if inner is None else np.zeros_like(m)
        for _ in range(steps):
            x, y, out, sums = m, got, m, got
            for j in range(1, 60):
                y = None if inner is None else (action(y) + inner(x)) * (h / j)
                x = action(x) * (h / j)
                out = out + x
                sums = None if inner is None else sums + y
                small = lambda a, b: np.abs(a).max() <= 1e-16 * np.abs(b).max()
                if small(x, out) and (inner is None or small(y, sums)):
                    break
            m, got = out, sums
        return m, got

    def _alone(self, d: np.ndarray) -> np.ndarray:
        """Messages of equal copies as messages of pairs."""
        out = np.zeros((len(d), d.shape[1], d.shape[1]))
        i = np.arange(d.shape[1])
        out[:, i, i] = d
        return out

    def up(self, k: int, m: np.ndarray) -> np.ndarray:
        """exp of edge k's generator applied to messages m[pattern, copy 1, copy 2]."""
        from .rates import codon_pair_action

        if self.paired[k]:
            return self._steps(k, m, lambda x: codon_pair_action(self.q, self.t, x))[0]
        # only equal copies are reached, and these stay equal
        return self._alone(np.diagonal(m, axis1=1, axis2=2) @ expm(generator(self.single) * self.lengths[k]).T)

    def down(self, k: int, v: np.ndarray) -> np.ndarray:
        """Weights of the states above edge k carried to its lower end."""
        from .rates import codon_pair_transposed

        if self.paired[k]:
            return self._steps(k, v, lambda x: codon_pair_transposed(self.q, self.t, x))[0]
        return self._alone(np.diagonal(v, axis1=1, axis2=2) @ expm(generator(self.single) * self.lengths[k]))

    def slope(self, k: int, m: np.ndarray) -> np.ndarray:
        """Edge k's generator applied to m."""
        from .rates import codon_pair_action

        if self.paired[k]:
            return codon_pair_action(self.q, self.t, m)
        return self._alone(np.diagonal(m, axis1=1, axis2=2) @ generator(self.single).T)

    def gathered(self, k: int, m: np.ndarray, *, jumps: str | None = None, weights: str | None = None) -> np.ndarray:
        """What the jumps of a kind, or the time weighted by states, gather along edge k below which the messages are m."""
        from .rates import codon_pair_action, codon_pair_exits, codon_pair_jumps

        if not self.paired[k]:
            q, one = generator(self.single), self.single
            if jumps is not None:
                inner = one if jumps in ("all", "mutations") else np.zeros_like(one)
            else:
                inner = np.diag({"exit": one.sum(axis=1), "unlike": np.zeros(len(q)), "alike": np.full(len(q), 2.0)}[weights])
            return self._alone(np.diagonal(m, axis1=1, axis2=2) @ integral(q, inner, float(self.lengths[k])).T)
        if jumps is not None:
            inner = lambda x: codon_pair_jumps(self.q, self.t, x, jumps)
        else:
            same = np.eye(len(self.pi))
            w = {"exit": lambda: codon_pair_exits(self.q, self.t), "unlike": lambda: 2 * (1 - same), "alike": lambda: 2 * same}[weights]()
            inner = lambda x: w * x
        return self._steps(k, m, lambda x: codon_pair_action(self.q, self.t, x), inner)[1]

    def _messages(self, patterns: np.ndarray, *, down: bool = False) -> Messages:
        n, s = len(patterns), len(self.pi)
        data: dict[str, np.ndarray] = {}
        for col, (name, pos) in enumerate(self.axes):
            seen = patterns[:, col]
            ok = np.where(seen[:, None] < 0, 1.0, np.arange(s)[None, :] == seen[:, None])
            ok = ok[:, :, None] if pos == 0 else ok[:, None, :]
            data[name] = data.get(name, np.ones((n, s, s))) * ok
        at: dict[str, list[int]] = {}
        for k, (a, _) in enumerate(self.edges):
            at.setdefault(a, []).append(k)
        scale, below, up = np.zeros(n), {}, [None] * len(self.edges)
        order = _order(self.edges)
        for node in reversed(order):
            m = data.get(node, np.ones((n, s, s)))
            for k in at.get(node, ()):
                up[k] = self.up(k, below[self.edges[k][1]])
                m = m * up[k]
            top = m.max(axis=(1, 2))
            top[top == 0] = 1.0
            below[node] = m / top[:, None, None]
            scale += np.log(top)
        with np.errstate(divide="ignore"):
            lnl = np.log(np.diagonal(below[self.root], axis1=1, axis2=2) @ self.pi) + scale
        above: list = [None] * len(self.edges)
        if down:
            outer = {self.root: np.broadcast_to(np.diag(self.pi), (n, s, s))}
            for node in order:
                for k in at.get(node, ()):
                    a = outer[node] * data[node] if node in data else outer[node]
                    for j in at[node]:
                        if j != k:
                            a = a * up[j]
                    top = a.max(axis=(1, 2), keepdims=True)
                    top[top == 0] = 1.0
                    above[k] = a / top
                    outer[self.edges[k][1]] = self.down(k, above[k])
        return Messages(lnl, below, up, above, [])

    def _by_edge(self, patterns: np.ndarray, inner, most: int = 64) -> np.ndarray:
        """For each pattern and edge the posterior mean of inner(edge, message below, message above its lower end)."""
        parts = []
        for start in range(0, max(len(patterns), 1), most):  # messages of some patterns at a time
            m = self._messages(patterns[start : start + most], down=True)
            cols = []
            for k, (_, c) in enumerate(self.edges):
                cols.append(np.einsum("nab,nab->n", m.down[k], inner(k, m.below[c], m.up[k])) / np.einsum("nab,nab->n", m.down[k], m.up[k]))
            parts.append(np.stack(cols, axis=1))
        return np.concatenate(parts)

    def edge_derivatives(self, patterns: np.ndarray) -> np.ndarray:
        """d lnL / d ln(length) of each pattern and edge."""
        return self._by_edge(patterns, lambda k, below, up: self.lengths[k] * self.slope(k, up))

    def expected_events(self, patterns: np.ndarray, which: str) -> np.ndarray:
        """Posterior expected number of events of each pattern and edge: ``all``, ``mutations``, ``copies``, ``copies_2_1`` (into
        copy 1) or ``copies_1_2``. Before the duplication a mutation of both copies is one."""
        return self._by_edge(patterns, lambda k, below, up: self.gathered(k, below, jumps=which))

    def dwell_fractions(self, patterns: np.ndarray, which: str) -> np.ndarray:
        """Posterior expected weighted share of each edge: ``unlike`` or ``alike`` copies (weight 2), or ``exit``, the rates of
        leaving."""
        if which not in ("unlike", "alike", "exit"):
            raise KeyError(f"no weights of states are named {which}")
        return self._by_edge(patterns, lambda k, below, up: self.gathered(k, below, weights=which) / max(float(self.lengths[k]), 1e-300))

    def log_likelihoods(self, patterns: np.ndarray, most: int = 256) -> np.ndarray:
        return np.concatenate([self._messages(patterns[k : k + most]).lnl for k in range(0, max(len(patterns), 1), most)])
