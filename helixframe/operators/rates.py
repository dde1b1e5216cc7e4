"""Rate matrices of substitution and gene conversion, and the shares of their rates that events are counted by.

Hasegawa, Kishino and Yano (1985) for nucleotides, Muse and Gaut (1994) for codons; copies among paralogs add to the rates of
single changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

from ..functions.alphabet import AMINO_ACID, NUCLEOTIDES, SENSE_CODONS, is_transition
from ..functions.matrix import generator
from .histories import Configuration, divide

CODON_LIST = SENSE_CODONS


def base_frequencies(ag: float, a_in_ag: float, c_in_ct: float) -> np.ndarray:
    """pi of A, C, G, T from the share of A and G, of A among these, and of C among C and T."""
    return np.array([ag * a_in_ag, (1 - ag) * c_in_ct, ag * (1 - a_in_ag), (1 - ag) * (1 - c_in_ct)])


def hky(pi: np.ndarray, kappa: float) -> np.ndarray:
    """4 x 4 rates (no diagonal) with one substitution expected in a unit of time."""
    q = np.array([[0.0 if a == b else pi[j] * (kappa if is_transition(a, b) else 1.0) for j, b in enumerate(NUCLEOTIDES)] for a in NUCLEOTIDES])
    return q / (pi @ q.sum(axis=1))


def codon_frequencies(pi: np.ndarray) -> np.ndarray:
    p = np.array([np.prod([pi[NUCLEOTIDES.index(n)] for n in c]) for c in SENSE_CODONS])
    return p / p.sum()


def mg94(pi: np.ndarray, kappa: float, omega: float, *, normal: bool = True) -> np.ndarray:
    """61 x 61 rates (no diagonal) of single-nucleotide changes among sense codons."""
    n = len(SENSE_CODONS)
    q = np.zeros((n, n))
    for i, j in product(range(n), repeat=2):
        a, b = SENSE_CODONS[i], SENSE_CODONS[j]
        at = [k for k in range(3) if a[k] != b[k]]
        if len(at) == 1:
            x, y = a[at[0]], b[at[0]]
            q[i, j] = pi[NUCLEOTIDES.index(y)] * (kappa if is_transition(x, y) else 1.0) * (omega if AMINO_ACID[a] != AMINO_ACID[b] else 1.0)
    return q / (codon_frequencies(pi) @ q.sum(axis=1)) if normal else q


def copy_rates(kind: str, pairs: list[tuple[int, int]], x: np.ndarray) -> dict[tuple[int, int], float]:
    """tau of each (donor, recipient): ``one`` rate; ``symmetric`` one a pair; ``general`` first all a < b, then all b < a."""
    if kind == "one":
        return {(a, b): float(x[0]) for p in pairs for a, b in (p, p[::-1])}
    if kind == "symmetric":
        return {(a, b): float(v) for p, v in zip(pairs, x, strict=True) for a, b in (p, p[::-1])}
    if kind == "general":
        both = [*pairs, *[p[::-1] for p in pairs]]
        return {p: float(v) for p, v in zip(both, x, strict=True)}
    raise ValueError(f"no such kind of copy rates: {kind}")


@dataclass
class Process:
    """Rates among joint states, and of each rate the part that copies make, by (donor, recipient)."""

    rates: np.ndarray
    copies: dict[tuple[int, int], np.ndarray]

    @property
    def q(self) -> np.ndarray:
        return generator(self.rates)

    def copy_share(self, which: list[tuple[int, int]] | None = None) -> np.ndarray:
        """The share of each rate that is due to copies (of these pairs); 0 where there is no rate."""
        got = [m for k, m in self.copies.items() if which is None or k in which]
        return _share(sum(got, np.zeros_like(self.rates)), self.rates)

    def mutation_share(self) -> np.ndarray:
        return np.where(self.rates > 0, 1 - self.copy_share(), 0.0)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros_like(whole), where=whole > 0)


def states(n_js: int, base: int = 4) -> np.ndarray:
    """All joint states, one a row, in row-major order."""
    return np.array(list(product(range(base), repeat=n_js)))


def is_state(state: np.ndarray, conf: Configuration) -> bool:
    """Whether the positions of each group alive agree."""
    return all(len({state[p] for p in ps}) == 1 for ps in divide(conf)["extent"].values())


def is_configuration(conf: Configuration) -> bool:
    """Whether each position has a group and is alive (1) or lost (0), and no group is both."""
    ok = len(conf) > 0 and all(len(x) == 2 and x[1] in (0, 1) for x in conf)
    return ok and all(len({a for o, a in conf if o == orlg}) == 1 for orlg in {o for o, _ in conf})


def is_state_of(state: np.ndarray, conf: Configuration, base: int = 4) -> bool:
    """Whether a joint state can stand in this configuration: a symbol at each position, the same throughout a group."""
    return len(state) == len(conf) and all(0 <= x < base for x in state) and is_state(state, conf)


def is_transition_of(a: np.ndarray, b: np.ndarray, conf: Configuration) -> bool:
    """Whether one change leads from joint state a to b: of one group alive, at all its positions. Lost groups are frozen."""
    if not (is_state_of(a, conf) and is_state_of(b, conf)):
        return False
    parts = divide(conf)
    moved = [o for o, ps in parts["extent"].items() if any(a[p] != b[p] for p in ps)]
    return len(moved) == 1 and all(a[p] == b[p] for p in parts["distinct"])


def is_pair_transition(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one change leads from state a to b of two copies at two positions: of one position, or of both positions of a
    copy to what the other copy holds there."""
    at = [k for k in range(4) if a[k] != b[k]]
    return len(at) == 1 or (at in ([0, 1], [2, 3]) and all(b[k] == a[(k + 2) % 4] for k in at))


def is_single_transition(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one change leads from state a to b before the duplication: both copies alike, one position of both changes."""
    alike = all(x[0] == x[2] and x[1] == x[3] for x in (a, b))
    return alike and sum(a[k] != b[k] for k in (0, 1)) == 1


def joint(conf: Configuration, q: np.ndarray, tau: dict[tuple[int, int], float]) -> Process:
    """The process below a node of this configuration: one group alive changes at a time, all its positions together.

    Group o goes from x to y at q[x, y] plus tau[d, o] of every other group d alive that holds y. Lost groups are frozen.
    """
    base, n_js = len(q), len(conf)
    n = base**n_js
    extent = divide(conf)["extent"]
    all_ = states(n_js, base)
    weight = base ** np.arange(n_js - 1, -1, -1)
    rates = np.zeros((n, n))
    copies = {p: np.zeros((n, n)) for p in tau if p[0] in extent and p[1] in extent}
    for s, state in enumerate(all_):
        if not is_state(state, conf):
            continue
        for o, places in extent.items():
            x = state[places[0]]
            for y in range(base):
                if y == x:
                    continue
                to = state.copy()
                to[places] = y
                k = int(to @ weight)
                rates[s, k] = q[x, y]
                for d, ps in extent.items():
                    if d != o and state[ps[0]] == y and (d, o) in copies:
                        copies[d, o][s, k] = tau[d, o]
                        rates[s, k] += tau[d, o]
    return Process(rates, copies)


def joint_brute(conf: Configuration, q: np.ndarray, tau: dict[tuple[int, int], float]) -> np.ndarray:
    """The rates of ``joint`` by trying every two states; for tests."""
    base, extent = len(q), divide(conf)["extent"]
    all_ = states(len(conf), base)
    out = np.zeros((len(all_), len(all_)))
    for (i, a), (j, b) in product(enumerate(all_), repeat=2):
        if not is_transition_of(a, b, conf):
            continue
        o = next(o for o, ps in extent.items() if any(a[p] != b[p] for p in ps))
        y = b[extent[o][0]]
        out[i, j] = q[a[extent[o][0]], y] + sum(tau.get((d, o), 0.0) for d, ps in extent.items() if d != o and a[ps[0]] == y)
    return out


def root_prior(conf: Configuration, pi: np.ndarray) -> np.ndarray:
    """pi on the states whose positions all agree."""
    all_ = states(len(conf), len(pi))
    same = (all_ == all_[:, :1]).all(axis=1)
    return np.where(same, pi[all_[:, 0]], 0.0)


def no_copy_absorbing(q: np.ndarray, tau: float) -> np.ndarray:
    """Rates among the pairs of two copies and a last, absorbing state that every pair enters at 2 tau."""
    n = len(q) ** 2
    eye = np.eye(len(q))
    out = np.zeros((n + 1, n + 1))
    out[:n, :n] = np.kron(q, eye) + np.kron(eye, q)
    out[:n, n] = 2 * tau
    return out


def pair_site(q_a: np.ndarray, q_b: np.ndarray, n: int, init: float, p: float) -> Process:
    """Two paralogs i, j at two positions a, b that are n apart: 256 states (i_a, i_b, j_a, j_b).

    Copied tracts start anywhere at rate init / p in all and have geometric length: A of them cover one of the positions only,
    B both. A change of one position to the other copy's symbol is made by A, and by B if the copies agree at the other
    position; a change of both positions to the other copy's is made by B.
    """
    one, both = init / p * (1 - (1 - p) ** n), init / p * (1 - p) ** n
    all_ = states(4)
    weight = np.array([64, 16, 4, 1])
    rates, copies = np.zeros((256, 256)), {(1, 2): np.zeros((256, 256)), (2, 1): np.zeros((256, 256))}
    for s, state in enumerate(all_):
        for own, other, key in ((0, 2, (2, 1)), (2, 0, (1, 2))):  # positions of the changing copy and of the donor
            for k, q in ((0, q_a), (1, q_b)):
                x = state[own + k]
                for y in range(4):
                    if y == x:
                        continue
                    to = state.copy()
                    to[own + k] = y
                    t = int(to @ weight)
                    c = 0.0
                    if state[other + k] == y:
                        c = one + (both if state[own + 1 - k] == state[other + 1 - k] else 0.0)
                    rates[s, t] = q[x, y] + c
                    copies[key][s, t] = c
            if state[own] != state[other] and state[own + 1] != state[other + 1]:
                to = state.copy()
                to[own : own + 2] = state[other : other + 2]
                t = int(to @ weight)
                rates[s, t] = copies[key][s, t] = both
    return Process(rates, copies)


def pair_site_single(q_a: np.ndarray, q_b: np.ndarray) -> np.ndarray:
    """The rates before the duplication: both copies change together, one position at a time."""
    out = np.zeros((256, 256))
    weight = np.array([64, 16, 4, 1])
    for a, b in product(range(4), repeat=2):
        s = int(np.array([a, b, a, b]) @ weight)
        for y in range(4):
            if y != a:
                out[s, int(np.array([y, b, y, b]) @ weight)] = q_a[a, y]
            if y != b:
                out[s, int(np.array([a, y, a, y]) @ weight)] = q_b[b, y]
    return out


def pair_site_brute(q_a: np.ndarray, q_b: np.ndarray, n: int, init: float, p: float) -> np.ndarray:
    """The rates of ``pair_site`` by trying every two states; for tests."""
    one, both = init / p * (1 - (1 - p) ** n), init / p * (1 - p) ** n
    all_ = states(4)
    out = np.zeros((256, 256))
    for (i, a), (j, b) in product(enumerate(all_), repeat=2):
        at = np.flatnonzero(a != b)
        if not is_pair_transition(a, b):
            continue
        if len(at) == 1:
            k = int(at[0])
            q = (q_a, q_b)[k % 2]
            out[i, j] = q[a[k], b[k]]
            if a[(k + 2) % 4] == b[k]:
                out[i, j] += one + (both if a[k ^ 1] == a[((k ^ 1) + 2) % 4] else 0.0)
        else:
            out[i, j] = both
    return out


def relation(process: Process) -> list[tuple[int, int, float, float]]:
    """from, to, rate and share of copies of every rate that is not zero: the sparse form."""
    share = process.copy_share()
    return [(int(i), int(j), float(process.rates[i, j]), float(share[i, j])) for i, j in zip(*np.nonzero(process.rates))]


def codon_pair(q: np.ndarray, tau_synonymous: float, tau_other: float) -> tuple[np.ndarray, np.ndarray]:
    """Point rates of 61 codons, and T[a, b]: the rate at which a copy holding a takes on b of the other copy."""
    aa = np.array([AMINO_ACID[c] for c in SENSE_CODONS])
    t = np.where(aa[:, None] == aa[None, :], tau_synonymous, tau_other)
    np.fill_diagonal(t, 0.0)
    return q, t


def _pair_points(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jumps by point changes of either copy, applied to messages m[..., copy 1, copy 2]."""
    if q.ndim == 2:
        return q @ m + m @ q.T
    return np.einsum("bac,...cb->...ab", q, m) + np.einsum("abc,...ac->...ab", q, m)


def codon_pair_jumps(q: np.ndarray, t: np.ndarray, m: np.ndarray, which: str) -> np.ndarray:
    """The jumps of one kind of two codon copies applied to messages m[..., copy 1, copy 2]: ``all``, ``mutations``, ``copies``,
    ``copies_2_1`` (into copy 1) or ``copies_1_2``."""
    d = np.diagonal(m, axis1=-2, axis2=-1)
    if which == "all":
        return _pair_points(q, m) + t * d[..., None, :] + t.T * d[..., :, None]
    if which == "mutations":
        return _pair_points(q, m)
    if which == "copies":
        return t * d[..., None, :] + t.T * d[..., :, None]
    if which == "copies_2_1":
        return t * d[..., None, :]  # copy 1 takes on what copy 2 holds
    if which == "copies_1_2":
        return t.T * d[..., :, None]
    raise KeyError(f"no jumps are named {which}")


def codon_pair_exits(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The rate at which each pair (copy 1, copy 2) is left."""
    r = q.sum(axis=1)
    own = r[:, None] + r[None, :] if q.ndim == 2 else q.sum(axis=2).T + q.sum(axis=2)
    return own + t + t.T


def codon_pair_action(q: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The generator of two codon copies applied to messages m[..., copy 1, copy 2], without its 3721 x 3721 matrix.

    ``q`` is 61 x 61, or [codon of the other copy, from, to].
    """
    return codon_pair_jumps(q, t, m, "all") - codon_pair_exits(q, t) * m


def codon_pair_transposed(q: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The transpose of codon_pair_action: what carries weights of states down an edge."""
    out = q.T @ v + v @ q if q.ndim == 2 else np.einsum("...ab,bac->...cb", v, q) + np.einsum("...ab,abc->...ac", v, q)
    out -= codon_pair_exits(q, t) * v
    k = np.arange(v.shape[-1])
    out[..., k, k] += (v * t).sum(axis=-2) + (v * t.T).sum(axis=-1)
    return out


def homogenising(pi: np.ndarray, kappa: float, omega: float, homo_omega: float) -> np.ndarray:
    """Point rates of copy 1 given the codon of copy 2, [copy 2, from, to]: a change to the amino acid of the other copy is
    selected by homo_omega instead of omega. In units of one change expected for a copy at stationarity of the pair."""
    aa = np.array([AMINO_ACID[c] for c in SENSE_CODONS])
    plain, neutral = mg94(pi, kappa, omega, normal=False), mg94(pi, kappa, 1.0, normal=False)
    other = (aa[:, None, None] == aa[None, None, :]) & (aa[None, :, None] != aa[None, None, :])
    rates = np.where(other, neutral * homo_omega, plain[None])
    p = np.outer(codon_frequencies(pi), codon_frequencies(pi))
    step = 0.9 / (2 * rates.sum(axis=2).max())
    for _ in range(20_000):  # the stationary distribution of the pair, by the power method
        d = np.zeros_like(p)
        d += np.einsum("ba,bac->cb", p.T, rates) - p * rates.sum(axis=2).T
        d += np.einsum("ab,abc->ac", p, rates) - p * rates.sum(axis=2)
        p = p + step * d
        if np.abs(d).max() < 1e-13:
            break
    return rates / (0.5 * ((p.T * rates.sum(axis=2)).sum() + (p * rates.sum(axis=2)).sum()))
