import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.matrix import expm
from helixframe.operators import likelihood as lh
from helixframe.operators.kernel import Scene, dwell_fractions, edge_derivatives, expected_events, log_likelihoods
from helixframe.plans.models import JointModel
from helixframe.sources import newick


def relations(spark, scene):
    """A scene's matrices and axes as relations."""
    rates = [(p, i, j, float(m[i, j])) for p, m in enumerate(scene.q) for i, j in zip(*np.nonzero(m)) if i != j]
    edges = [(a, b, int(p), float(t)) for (a, b), p, t in zip(scene.edges, scene.process, scene.lengths)]
    digits = [(s, k, int(v)) for s in range(len(scene.prior)) for k, v in enumerate(np.unravel_index(s, scene.shape))]
    make = spark.createDataFrame
    return (
        make([tuple(map(lambda x: x.item() if hasattr(x, "item") else x, r)) for r in rates], "process int, s int, t int, rate double"),
        make(edges, "parent string, child string, process int, length double"),
        make([(s, float(p)) for s, p in enumerate(scene.prior) if p > 0], "s int, p double"),
        make([(k, n, p) for k, (n, p) in enumerate(scene.axes)], "axis int, node string, pos int"),
        make(digits, "s int, pos int, value int"),
    )


def values(df, patterns, edges):
    at = {(tuple(r["pattern"]), r["child"]): r["value"] for r in df.collect()}
    return np.array([[at.get((tuple(map(int, p)), c), np.nan) for _, c in edges] for p in patterns])


def joint_scene():
    tree = newick.splice(newick.parse("(((a,b)N2,c)N1,d)N0"), [("N0_N1", ["D1"]), ("N2_b", ["L1"])])
    axes = [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1), ("d", 0)]
    model = JointModel(tree, axes, event_group={"D1": 0, "L1": 1})
    return model.scene(model.start(length=0.3), 1)


def odd_scene():
    """Three states that cannot all be reached, a node of three edges and data inside the tree."""
    q = np.array([[-1.0, 1.0, 0.0], [0.0, -0.5, 0.5], [0.0, 0.0, 0.0]])
    r = np.array([[-0.3, 0.2, 0.1], [0.4, -0.9, 0.5], [2.0, 1.0, -3.0]])
    edges = [("R", "x"), ("R", "y"), ("R", "z"), ("x", "u"), ("x", "v"), ("u", "w")]
    return Scene(edges, np.array([0.3, 4.0, 0.7, 0.2, 1.1, 0.05]), [0, 1, 1, 0, 1, 1], [q, r], np.array([0.5, 0.5, 0.0]), (3,), [("w", 0), ("v", 0), ("y", 0), ("x", 0)])


@pytest.mark.parametrize("make", [odd_scene, joint_scene])
def test_equal_to_the_kernel(spark, make):
    scene = make()
    rng = np.random.default_rng(1)
    patterns = np.unique(rng.integers(-1, scene.shape[0], (25, len(scene.axes))), axis=0)
    rates, edges, prior, axes, digits = relations(spark, scene)
    rows = spark.createDataFrame([([int(v) for v in p],) for p in patterns], "pattern array<int>")
    trans = lh.transitions(rates, edges, prior)
    tree = lh.prune(lh.observations(rows, axes, digits, edges), edges, trans, prior)
    lnl = {tuple(r["pattern"]): r["lnl"] for r in tree.lnl.collect()}
    with np.errstate(all="ignore"):
        want = log_likelihoods(scene, patterns)
        possible = np.isfinite(want)
        np.testing.assert_allclose([lnl[tuple(map(int, p))] for p in patterns], want, rtol=1e-9)
        above = lh.outside(tree)
        got = values(lh.expected(tree, above, lh.slopes(rates, edges, trans)), patterns, scene.edges)
        np.testing.assert_allclose(got[possible], edge_derivatives(scene, patterns)[possible], rtol=1e-9, atol=1e-11)
        got = values(lh.expected(tree, above, lh.integrals(rates, edges, prior, lh.jumps(rates, F.when(F.col("t") == 1, 2.0).otherwise(1.0)))), patterns, scene.edges)
        weights = [np.where(np.arange(len(q)) == 1, 2.0, 1.0)[None, :] * np.ones_like(q) for q in scene.q]
        np.testing.assert_allclose(got[possible], expected_events(scene, patterns, weights)[possible], rtol=1e-9, atol=1e-11)
        stay = spark.createDataFrame([(p, 0, 0, 1.0) for p in range(len(scene.q))], "process int, s int, t int, w double")
        got = values(lh.expected(tree, above, lh.integrals(rates, edges, prior, stay)), patterns, scene.edges) / scene.lengths
        np.testing.assert_allclose(got[possible], dwell_fractions(scene, patterns, [np.eye(len(q))[0] for q in scene.q])[possible], rtol=1e-9, atol=1e-11)
    assert possible.sum() > 5
    tree.release()


def test_exponentials(spark):
    rng = np.random.default_rng(4)
    q = [np.where(rng.random((6, 6)) < 0.6, rng.random((6, 6)), 0.0) * s for s in (0.01, 1.0, 60.0)]
    for m in q:
        np.fill_diagonal(m, 0.0)
        np.fill_diagonal(m, -m.sum(axis=1))
    rows = [(k, i, j, float(m[i, j])) for k, m in enumerate(q) for i in range(6) for j in range(6) if m[i, j]]
    a = spark.createDataFrame(rows, "k int, s int, t int, v double")
    states = spark.createDataFrame([(k, s) for k in range(3) for s in range(6)], "k int, s int")
    got = np.zeros((3, 6, 6))
    for r in lh.exponential(a, states).collect():
        got[r["k"], r["s"], r["t"]] = r["v"]
    np.testing.assert_allclose(got, np.stack([expm(m) for m in q]), rtol=1e-9, atol=1e-13)
    assert lh.exponential(a.filter("k > 5"), states.filter("k = 0 and s < 2")).orderBy("s").collect() == [(0, 0, 0, 1.0), (0, 1, 1, 1.0)]


def test_no_patterns(spark):
    rates, edges, prior, axes, digits = relations(spark, odd_scene())
    rows = spark.createDataFrame([], "pattern array<int>")
    tree = lh.prune(lh.observations(rows, axes, digits, edges), edges, lh.transitions(rates, edges, prior), prior)
    assert tree.lnl.collect() == [] and lh.outside(tree).collect() == []
