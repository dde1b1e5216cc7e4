import itertools

import numpy as np
from tests.test_likelihood import odd_scene, relations

from helixframe.operators import lengths
from helixframe.operators import likelihood as lh
from helixframe.operators.kernel import Scene, dwell_fractions, expected_events, log_likelihoods


def observed(spark, scene, patterns, n):
    rates, edges, prior, axes, digits = relations(spark, scene)
    rows = spark.createDataFrame([([int(v) for v in p], int(k)) for p, k in zip(patterns, n)], "pattern array<int>, n long")
    return lh.observations(rows, axes, digits, edges), rows, edges, rates, prior


def by_hand(scene, patterns, n, share=None, parameter=None):
    """One round from the kernel's expectations."""
    with np.errstate(all="ignore"):
        jumps = expected_events(scene, patterns, [np.ones_like(q) for q in scene.q])
        exits = dwell_fractions(scene, patterns, [-np.diag(q) for q in scene.q])
        possible = np.isfinite(log_likelihoods(scene, patterns))
    n = np.asarray(n, dtype=float)[possible]
    j, e = n @ jumps[possible], n @ exits[possible]
    share = np.ones(len(j)) if share is None else np.array(share)
    parameter = list(range(len(j))) if parameter is None else parameter
    out = np.array(scene.lengths, dtype=float)
    for k in range(len(j)):
        if parameter[k] is not None:
            same = [i for i in range(len(j)) if parameter[i] == parameter[k]]
            out[k] = share[k] * j[same].sum() / (e[same] * share[same]).sum()
    return out


def of(edges, scene):
    at = {r["child"]: r["length"] for r in edges.collect()}
    return np.array([at[c] for _, c in scene.edges])


def test_a_round_equals_the_kernel(spark):
    scene = odd_scene()
    rng = np.random.default_rng(3)
    patterns = np.unique(rng.integers(-1, scene.shape[0], (20, len(scene.axes))), axis=0)
    n = rng.integers(1, 9, len(patterns))
    got, _ = lengths.fit(*observed(spark, scene, patterns, n), rounds=1)
    np.testing.assert_allclose(of(got, scene), by_hand(scene, patterns, n), rtol=1e-8)


def test_shared_and_fixed_lengths(spark):
    scene = odd_scene()
    patterns = np.array([[1, 1, 0, 1], [0, 2, 1, 0], [1, -1, 1, 0], [2, 2, 2, 1]])
    n = [5, 2, 3, 4]
    parameter, share = ["u", "v", "u", None, "v", "w"], [1.0, 2.0, 0.5, 1.0, 1.0, 1.0]
    data, rows, edges, rates, prior = observed(spark, scene, patterns, n)
    told = [(a, b, int(p), float(t), k, s) for (a, b), p, t, k, s in zip(scene.edges, scene.process, scene.lengths, parameter, share)]
    edges = spark.createDataFrame(told, "parent string, child string, process int, length double, parameter string, share double")
    got, _ = lengths.fit(data, rows, edges, rates, prior, rounds=1)
    np.testing.assert_allclose(of(got, scene), by_hand(scene, patterns, n, share, parameter), rtol=1e-8)


def test_three_tips_reach_the_closed_form(spark):
    q = np.array([[-1.0, 1.0], [1.0, -1.0]])
    scene = Scene([("R", "a"), ("R", "b"), ("R", "c")], np.array([0.1, 0.1, 0.1]), [0, 0, 0], [q], np.array([0.5, 0.5]), (2,), [("a", 0), ("b", 0), ("c", 0)])
    patterns = np.array(list(itertools.product((0, 1), repeat=3)))
    n = np.array([900, 25, 20, 11, 9, 22, 31, 940])
    got, history = lengths.fit(*observed(spark, scene, patterns, n), rounds=6, tolerance=2e-5)
    apart = lambda i, j: 1 - 2 * n[patterns[:, i] != patterns[:, j]].sum() / n.sum()
    ab, ac, bc = apart(0, 1), apart(0, 2), apart(1, 2)
    want = [-np.log(ab * ac / bc) / 4, -np.log(ab * bc / ac) / 4, -np.log(ac * bc / ab) / 4]
    np.testing.assert_allclose(of(got, scene), want, atol=1e-5)
    rows = history.orderBy("round").collect()
    assert len(rows) > 2 and all(b["lnl"] >= a["lnl"] - 1e-9 for a, b in zip(rows, rows[1:]))


def test_nothing_to_learn_from(spark):
    scene = odd_scene()
    got, history = lengths.fit(*observed(spark, scene, [], []), rounds=3)
    np.testing.assert_array_equal(of(got, scene), scene.lengths)
    assert [tuple(r) for r in history.collect()] == [(0, 0.0, 0.0)]
