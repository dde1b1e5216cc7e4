import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.lineage import local
from helixframe.operators import rate_relations, rates, stencils, waits
from helixframe.operators.estimate import stencil
from helixframe.sources import tables

PI = np.array([0.3, 0.2, 0.15, 0.35])


def shares(spark):
    return local(spark, list(zip("ACGT", PI.tolist())), "nt string, freq double")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["s"], r["t"]] += r["rate"]
    return out


def test_codon_pairs_are_the_kernel(spark):
    """Every rate against the structured generator, applied to unit messages."""
    got = rate_relations.codon_pair(shares(spark), 2.0, 0.4, 1.3, 0.2)
    assert got.groupBy("process").count().orderBy("process").collect() == [(0, 526), (1, 70440)]
    m = dense(got.filter("process = 1"), 3721)
    q, t = rates.codon_pair(rates.mg94(PI, 2.0, 0.4), 1.3, 0.2)
    rng = np.random.default_rng(1)
    for v in rng.random((3, 61, 61)):
        np.testing.assert_allclose(m @ v.ravel(), rates.codon_pair_jumps(q, t, v, "all").ravel(), rtol=1e-9)
    np.testing.assert_allclose(m.sum(axis=1), rates.codon_pair_exits(q, t).ravel(), rtol=1e-9)
    before = dense(got.filter("process = 0"), 3721)[::62, ::62]
    np.testing.assert_allclose(before, q, rtol=1e-9)
    copied = got.filter("process = 1").select("s", "t", (F.col("rate") * F.col("share")).alias("rate"))
    np.testing.assert_allclose(dense(copied, 3721) @ v.ravel(), rates.codon_pair_jumps(q, t, v, "copies").ravel(), rtol=1e-9, atol=1e-12)


def test_homogenising_codon_pairs(spark):
    """Changes towards the other copy's amino acid, up to the unit of time."""
    want = rates.homogenising(PI, 2.0, 0.4, 1.1)
    got = dense(rate_relations.codon_pair(shares(spark), 2.0, 0.4, 0.0, 0.0, homo_omega=1.1).filter("process = 1 and rate > 0"), 3721).reshape(61, 61, 61, 61)
    first = np.einsum("azbz->zab", got)
    ratio = first[want > 0] / want[want > 0]
    np.testing.assert_allclose(ratio, ratio[0], rtol=1e-9)


def test_stencil_relation(spark):
    """The same derivatives as the driver's stencil, and the information by numpy."""
    x = np.array([0.7, 0.0, 2.0])
    f = lambda u, v: math.exp(v[0] * u) * (1 + v[1] ** 2 + 0.3 * v[1]) + math.sin(u * v[2]) * v[0]
    params = local(spark, list(enumerate(x.tolist())), "i int, x double")
    terms = stencils.terms(params, 1e-3)
    at = {}
    for r in stencils.points(params, terms).collect():
        at.setdefault(r["point"], {})[r["i"]] = r["x"]
    assert len(at) == 1 + 4 * 3 + 4 * 3
    units = [0.2, 0.9, 1.7, 2.2]
    values = spark.createDataFrame([(p, u, float(f(u, [v[k] for k in range(3)]))) for p, v in at.items() for u in units], "point long, u double, value double")
    got = stencils.derivatives(values, terms, "u")
    g, h = np.zeros((4, 3)), np.zeros((4, 3, 3))
    for r in got.collect():
        k = units.index(r["u"])
        if r["j"] is None:
            g[k, r["i"]] = r["value"]
        else:
            h[k, r["i"], r["j"]] = h[k, r["j"], r["i"]] = r["value"]
    points, of = stencil(x, 1e-3)
    for k, u in enumerate(units):
        a, b = of({n: np.array([f(u, v)]) for n, v in points.items()})
        np.testing.assert_allclose(g[k], a[0], rtol=1e-9)
        np.testing.assert_allclose(h[k], b[0], rtol=1e-7, atol=1e-7)
    n = spark.createDataFrame([(u, "one", k + 1) for k, u in enumerate(units)], "u double, grp string, n long")
    means = stencils.means(got, n, "u", "grp")
    w = np.arange(1, 5) / 10
    j, hess = np.einsum("k,ki,kj->ij", w, g, g), -np.einsum("k,kij->ij", w, h)
    out = np.zeros((3, 3))
    for r in stencils.godambe(means, "grp").collect():
        out[r["i"], r["j"]] = r["value"]
    np.testing.assert_allclose(out, hess @ np.linalg.solve(j, hess), rtol=1e-6)


def test_waits_on_branches(spark):
    rows = [(u, k, (7 * k * (u + 1)) % 11) for u in range(4) for k in range(30)] + [(9, 0, 5)]
    events = spark.createDataFrame(rows, "u int, k int, wait int")
    got = waits.moments(events, "u", ["k"], "wait", F.floor(F.col("k") / 4))
    sums, want = {}, {}
    for u, k, w in rows:
        sums[u] = sums.get(u, 0) + w
        want[u, k] = sums[u]
    assert {(r["u"], r["k"]): r["at"] for r in got.collect()} == want
    branches = [(u, b, lo, hi) for u in range(4) for b, lo, hi in (("x", 0, 20 + u), ("y", 20 + u, 60), ("z", 70, 90))]
    on = waits.on_branches(got, spark.createDataFrame(branches, "u int, branch string, begin int, until int"), "u")
    assert {(r["u"], r["k"]): (r["branch"], r["since"]) for r in on.collect()} == {(u, k): (b, at - lo) for (u, k), at in want.items() for v, b, lo, hi in branches if v == u and lo <= at < hi}


def test_summary_files(spark, tmp_path):
    rows = [(run, k, label, run_n + k / 3) for run_n, run in enumerate(["a", "b c", "d"]) for k, label in enumerate(["lnL", "tau", "N0__N1"])]
    tables.write_summaries(spark.createDataFrame(rows, "run string, place int, label string, value double"), str(tmp_path / "s"))
    assert sorted(map(tuple, tables.summaries(spark, str(tmp_path / "s")).select("run", "place", "label", "value").collect())) == rows
    files = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "s") for f in fs if f.startswith("part")]
    assert len(files) == 3
    wide = tables.read_summaries(spark, {"first": files[0], "second": files[1]})
    assert wide.columns == ["label", "first", "second"] and wide.count() == 3 and wide.filter("first is null or second is null").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_summaries(spark, {"none": str(tmp_path / "none")})


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "log")
    tables.append_log(rows, path, 0)
    tables.append_log(rows.filter("id < 4"), path, 1)
    tables.append_log(rows, path, 0)
    assert [(r["batch"], r["count"]) for r in spark.read.parquet(path).groupBy("batch").count().orderBy("batch").collect()] == [(0, 10), (1, 4)]


def test_streamed_batches_replace_themselves(spark, tmp_path):
    from helixframe.streaming.forward import log_stream

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    for attempt in range(2):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        log_stream(stream, str(tmp_path / "log"), str(tmp_path / f"cp{attempt}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == got.select("id").distinct().count() == 30


def test_axes_by_family(spark):
    from helixframe.operators import encode

    genes = spark.createDataFrame([(1, "a__x", 1), (1, "a__y", 2), (2, "a__x", 1), (2, "z__x", 1)], "family int, gene string, orlg int")
    confs = spark.createDataFrame([(f, "a", p, o, alive) for f, p, o, alive in ((1, 0, 1, 1), (1, 1, 2, 1), (2, 0, 1, 1), (2, 1, 1, 1), (2, 2, 3, 0))], "family int, node string, pos int, orlg int, alive int")
    got = sorted(map(tuple, encode.axes(genes, confs, "family").collect()))
    assert got == [(1, 0, "a__x", "a", 0), (1, 1, "a__y", "a", 1), (2, 0, "a__x", "a", 0), (2, 1, "a__x", "a", 1), (2, 2, "distinct", "a", 2)]


def test_alignment_violations(spark):
    rows = [("f", "a__x", "x", "ACGT"), ("f", "b__x", "x", "ACG"), ("f", "b__x", None, "ACGA"), ("g", "a__y", "y", "ACG"), ("h", "n", None, None), ("h", "m", "x", "AAA")]
    df = spark.createDataFrame(rows, "family string, name string, gene string, seq string")
    found = lambda d: sorted(tuple(r) for r in d.collect())
    assert found(tables.alignment_violations(df, "family", coding=True)) == [("f", "genes", 1), ("f", "lengths", 1), ("f", "names", 1), ("f", "threes", 2), ("h", "genes", 1), ("h", "lengths", 1)]
    assert found(tables.alignment_violations(df.filter("family = 'f'"))) == [("genes", 1), ("lengths", 1), ("names", 1)]
    assert found(tables.alignment_violations(df.filter("family = 'g'"), coding=True)) == []


def test_shared_parameters(spark):
    from helixframe.operators import shared

    names = spark.createDataFrame([(f, n, n == "tau") for f in ("x", "y", "z", "w") for n in ("tau", "len")], "family string, name string, shared boolean")
    values = [("x", "tau", 1.0), ("x", "len", 2.0), ("y", "tau", 0.5), ("y", "len", -1.0), ("z", "tau", 9.0), ("z", "len", float("nan")), ("w", "tau", 4.0)]
    df = spark.createDataFrame(values, "family string, name string, value double")
    assert sorted(map(tuple, shared.gradient(df, names).collect())) == [("tau", 1.5, 2), ("x:len", 2.0, 1), ("y:len", -1.0, 1)]
    assert sorted(map(tuple, shared.failures(df, names).collect())) == [("w", "len"), ("z", "len")]
