"""The chain from text files to likelihoods, fits and tracts, on alignments simulated here."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import encode, engine, estimate, histories, hmm, rates, simulate
from helixframe.plans.models import CodonModel, JointModel, PairSiteModel, lengths_from_clock, logit_tract
from helixframe.sources import forest, newick, tables

TREE = "(((A,B)N2,C)N1,Out)N0"
GENES = [(f"{s}__{g}", o) for s in "ABC" for g, o in (("x", 1), ("y", 2))] + [("Out__x", 0)]
PI = np.array([0.3, 0.2, 0.2, 0.3])


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("family")
    (d / "tree.nwk").write_text(TREE + ";\n")
    (d / "history.txt").write_text("N0_N1\tD1\n")
    (d / "genes.txt").write_text("".join(f"{g}\t{o}\n" for g, o in GENES))
    tree = newick.splice(newick.read_tree(spark, str(d / "tree.nwk")), newick.read_history(spark, str(d / "history.txt")))
    confs = histories.configurations(tree, {"D1": 0})
    setting = simulate.Setting(tree, confs, {e: 0.15 for e in tree.edges}, rates.hky(PI, 3.0), PI, 300, init=0.4, p=0.25, seed=11)
    seqs, events = simulate.simulate(spark, setting, 2)
    genes = tables.read_gene_map(spark, str(d / "genes.txt"))
    aligned = simulate.as_alignment(seqs.filter("replicate = 0"), genes, ["A", "B", "C", "Out"])
    rows = aligned.select("name", "seq").collect()
    (d / "data.fasta").write_text("".join(f">{r['name']}\n{r['seq'][:100]}\n{r['seq'][100:]}\n" for r in rows))
    (d / "index.txt").write_text("".join(f"{k + 1}\t{k // 3 + 1}\t{k % 3 + 1}\n" for k in range(300)))
    return d, tree, confs, seqs, events


@pytest.fixture(scope="module")
def family(spark, data):
    d, tree, confs, *_ = data
    seqs = tables.read_fasta(spark, str(d / "data.fasta"))
    axes = encode.axes(tables.read_gene_map(spark, str(d / "genes.txt")), histories.configuration_relation(spark, confs))
    obs = encode.observations(encode.site_states(seqs), axes).cache()
    at = [(r["node"], r["pos"]) for r in axes.orderBy("axis").collect()]
    return tree, at, seqs, obs, encode.compress(obs, codon_position=False).cache()


def test_scans(spark, data, family):
    d, *_ = data
    seqs = family[2]
    assert seqs.count() == 7 and tables.check_alignment(seqs, coding=True) == 300
    assert {(r["species"], r["gene"]) for r in seqs.select("species", "gene").collect()} == {tuple(g.split("__")) for g, _ in GENES}
    with pytest.raises(ValueError):
        tables.check_alignment(seqs.unionByName(seqs.limit(1).withColumn("seq", F.lit("AC"))))
    index = tables.read_index(spark, str(d / "index.txt"))
    assert index.collect() == tables.make_index(spark, 300).select(*index.columns).orderBy("site").collect()
    assert encode.monotonic(index)
    gap = index.filter("nt_index < 10 or nt_index > 15")
    assert tables.fill_index(gap).filter("codon = -1").count() == 6
    assert newick.edge_relation(spark, data[1]).count() == len(data[1].edges)
    old = spark.createDataFrame([("Ax", "A"), ("Axy", "C")], "name string, seq string")
    tables.write_fasta(old, str(d / "old"))
    got = {r["name"]: (r["species"], r["gene"]) for r in tables.read_fasta(spark, str(d / "old"), paralogs=["x", "y"]).collect()}
    assert got == {"Ax": ("A", "x"), "Axy": ("Ax", "y")}


def test_missing_symbols_and_lost_groups(spark):
    seqs = spark.createDataFrame([("A__x", "A", "x", "acN-gT")], "name string, species string, gene string, seq string")
    assert [r["state"] for r in encode.site_states(seqs).orderBy("site").collect()] == [0, 1, -1, -1, 2, 3]
    assert [r["state"] for r in encode.site_states(seqs, any_case=False).orderBy("site").collect()] == [-1, -1, -1, -1, -1, 3]
    assert [r["state"] for r in encode.site_states(seqs, codon=True).collect()] == [-1, -1]
    confs = spark.createDataFrame([("A", 0, 1, 1), ("A", 1, 2, 0)], "node string, pos int, orlg int, alive int")
    axes = encode.axes(spark.createDataFrame([("A__x", 1)], "gene string, orlg int"), confs)
    assert [r["pattern"] for r in encode.observations(encode.site_states(seqs, n_sites=2), axes).orderBy("site").collect()] == [[0, -1], [1, -1]]


def test_likelihood_sums(spark, family):
    tree, at, _, obs, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0})
    x = m.start(PI)
    total = engine.log_likelihood(patterns, {0: m.scenes(x)})[0]
    each = engine.sitewise(obs, patterns, m.scenes(x))
    assert each.count() == 300 and each.agg(F.sum("lnl")).first()[0] == pytest.approx(total)
    assert engine.log_likelihood(patterns.repartition(7), {0: m.scenes(x)})[0] == pytest.approx(total, rel=1e-12)
    three = JointModel(tree, at, event_group={"D1": 0}, rate_variation=True)
    by_position = encode.compress(obs)
    assert engine.log_likelihood(by_position, {0: three.scenes(three.start(PI))})[0] == pytest.approx(total)
    general = JointModel(tree, at, event_group={"D1": 0}, copies="general")
    y = general.start(PI)
    assert engine.log_likelihood(patterns, {0: general.scenes(y)})[0] == pytest.approx(total)


def test_gradient_and_force(family):
    tree, at, _, _, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0}, force={4: 0.0})
    x = m.start(PI)
    f, g = estimate.gradient_with_lengths(patterns, m, x)
    f2, g2 = estimate.gradient(estimate.objective(patterns, m), x, m.free(), step=1e-5)
    assert f == pytest.approx(f2) and np.allclose(g, g2, atol=1e-3) and g[4] == 0 and m.named(x)["tau"] == 0


def test_fit_finds_the_parameters(family, tmp_path):
    tree, at, _, _, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0})
    save = str(tmp_path / "x.txt")
    x, lnl = estimate.fit(patterns, m, m.start(PI, length=0.1), rounds=25, save=save, history=str(tmp_path / "rounds.txt"))
    rounds = np.loadtxt(tmp_path / "rounds.txt", ndmin=2)
    assert rounds.shape[1] == 1 + 2 * len(m.names) and np.all(np.diff(rounds[:, 0]) > -1e-6)
    with pytest.raises(ValueError):
        JointModel(tree, at, event_group={"D1": 0}, force={0: 1.5}).scenes(x)
    assert lnl > engine.log_likelihood(patterns, {0: m.scenes(m.start(PI, length=0.1))})[0] + 5
    v = m.named(x)
    assert 1.5 < v["kappa"] < 6 and 0.3 < v["tau"] < 8
    assert np.allclose(tables.load_x(save), x)
    better = estimate.length_em(patterns, m, m.start(PI, length=0.3), rounds=2)
    assert engine.log_likelihood(patterns, {0: m.scenes(better)})[0] > engine.log_likelihood(patterns, {0: m.scenes(m.start(PI, length=0.3))})[0]


def test_counts_by_edge(family):
    tree, at, _, _, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0})
    s = m.scenes(m.start(PI, length=0.1))
    both, a, b = (engine.per_edge(patterns, s, "events", w) for w in ("copies", "copies_1_2", "copies_2_1"))
    assert all(both[k] == pytest.approx(a[k] + b[k], abs=1e-9) for k in both)
    dwell = engine.per_edge(patterns, s, "dwell", "unlike")
    tau = engine.branch_tau(both, dwell, s[1].lengths)
    first = m.edges.index(("N0", "D1"))
    assert tau[first] == 0 and all(v >= 0 for v in tau.values())


def test_two_models_of_codons_agree_without_selection_or_copies(spark, family):
    tree, at, seqs, _, _ = family
    plain = newick.parse(TREE)
    axes = [(s, p) for s in "ABC" for p in (0, 1)] + [("Out", 0), ("Out", 1)]
    x = np.random.default_rng(3).integers(0, 61, (5, 8))
    x[:, 7] = x[:, 6]
    same = [CodonModel(plain, axes, selection=s) for s in ("none", "omega", "own", "joint")]
    rows = spark.createDataFrame([(1, r.tolist(), 1) for r in x], "codon_position int, pattern array<int>, n long")
    out = []
    for m in same:
        v = dict(zip(m.names, m.start(PI, length=0.1)))
        v |= {"omega": 0.0, "tau": np.log(0.7)} | ({"omega_copy": 0.0} if m.selection == "own" else {}) | ({"tau_omega": np.log(0.7)} if m.selection == "joint" else {})
        out.append(engine.log_likelihood(rows, {0: m.scenes(np.array([v[n] for n in m.names]))})[0])
    assert np.allclose(out, out[0])


def test_pairs_of_sites(spark, family):
    tree, at, _, obs, _ = family
    index = tables.make_index(spark, 300).filter("site < 30")
    all_ = encode.site_pairs(index)
    assert all_.count() == 30 * 29 // 2
    near = encode.site_pairs(index, spaces=[1, 2, 5])
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, all_.filter("space in (1, 2, 5)").collect()))
    assert encode.site_pairs(index, spaces=[1], same_codon=False).count() == 9
    pairs = encode.pair_patterns(obs, near)
    groups = [tuple(r) for r in pairs.select("space", "cs_i", "cs_j").distinct().collect()]
    wide = [(n, p) for n, q in at for p in (2 * q, 2 * q + 1)]
    m = PairSiteModel(tree, wide, groups=groups)
    x = dict(zip(m.names, m.start(PI, length=0.1))) | {"init_rate": np.log(0.2), "tract_p": np.log(0.4)}
    got = engine.log_likelihood(pairs, {0: m.scenes(np.array([x[n] for n in m.names]))}, keys=("space", "cs_i", "cs_j"))[0]
    assert np.isfinite(got)
    # tracts of one site copy positions one by one: pairs are then independent sites
    one = JointModel(tree, at, event_group={"D1": 0})
    y = dict(zip(one.names, one.start(PI, length=0.1))) | {"tau": np.log(0.2)}
    x["tract_p"] = 0.0
    apart = engine.log_likelihood(pairs, {0: m.scenes(np.array([x[n] for n in m.names]))}, keys=("space", "cs_i", "cs_j"))[0]
    site = engine.sitewise(obs, encode.compress(obs, codon_position=False), one.scenes(np.array([y[n] for n in one.names])))
    s = {r["site"]: r["lnl"] for r in site.collect()}
    assert apart == pytest.approx(sum(s[r["i"]] + s[r["j"]] for r in near.collect()), rel=1e-9)


def test_information(family):
    tree, at, _, _, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0})
    chosen = [3, 4]
    x = m.start(PI, length=0.1)
    mom = estimate.pattern_moments(patterns, m, x, chosen, size=1e-3)
    g = mom.agg(*[F.sum(F.col("n") * F.get("g", F.lit(k))) for k in (0, 1)]).first()
    _, want = estimate.gradient(estimate.objective(patterns, m), x, chosen)
    assert np.allclose(list(g), want[chosen], atol=0.05)
    info = estimate.godambe(mom, 2)
    assert info.shape == (2, 2) and np.allclose(info, info.T)


def test_families_share_parameters(family):
    tree, at, _, _, patterns = family
    m, n = JointModel(tree, at, event_group={"D1": 0}), JointModel(tree, at, event_group={"D1": 0}, copies="symmetric")
    both = estimate.families({"f": (patterns, m), "g": (patterns.withColumn("n", F.col("n") * 2), m)}, ["tau", "kappa"])
    assert both.names[-2:] == ["tau", "kappa"] and len(both.names) == 2 * (len(m.names) - 2) + 2
    x = both.start(0.1)
    x[both.names.index("g:%A")] = np.log(0.4)
    f, g = both.gradient(x)
    one = engine.log_likelihood(patterns, {0: m.scenes(m.start(length=0.1))})[0]
    assert f == pytest.approx(one + 2 * engine.log_likelihood(patterns, {0: m.scenes(x[both.places("g")])})[0])
    for k in [both.names.index(n) for n in ("tau", "kappa", "f:%A", "g:%A", "f:N1__C", "g:root__both")]:
        y, z = x.copy(), x.copy()
        y[k] += 1e-5
        z[k] -= 1e-5
        got = both.values({0: y, 1: z})
        assert g[k] == pytest.approx((got[0] - got[1]) / 2e-5, rel=1e-4, abs=1e-3)
    new, lnl = both.fit(x, rounds=3)
    assert lnl > f and np.all(new >= np.array(both.bounds())[:, 0] - 1e-12)
    with pytest.raises(ValueError):
        estimate.families({"f": (patterns, m), "g": (patterns, n)}, ["tau"])


def test_optimisers():
    def fun(x):
        return float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])

    x, f = estimate.minimise(fun, np.array([-1.2, 1.0]), [(-5, 5)] * 2, tolerance=1e-14)
    assert np.allclose(x, 1, atol=1e-3)
    x, _ = estimate.minimise(fun, np.array([-1.2, 1.0]), [(-5, 0.5)] * 2, tolerance=1e-14)
    assert np.allclose(x, [0.5, 0.25], atol=1e-3)
    batch = lambda p: {k: -float(((v - 0.3) ** 2).sum()) for k, v in p.items()}
    x, _ = estimate.differential_evolution(batch, [(-1, 1)] * 3, rounds=60)
    assert np.allclose(x, 0.3, atol=1e-2)
    bumpy = lambda x: estimate.minimise(lambda v: (float(np.cos(3 * v[0]) + 0.1 * v[0] ** 2), np.array([-3 * np.sin(3 * v[0]) + 0.2 * v[0]])), x, [(-6, 6)])
    best = estimate.basin_hopping(bumpy, np.array([5.0]), [(-6, 6)], hops=30, size=2.5)
    assert abs(abs(best[0][0]) - 1.02) < 0.1
    assert np.allclose(np.exp(logit_tract(np.array([np.log(4), np.log(0.3)]))), [4 * 0.3 / 1.3, 0.3 / 1.3])


def test_clock():
    t = newick.parse("((a,b)N1,c)N0")
    assert lengths_from_clock(t, ["N0", "N1"], 2.0, [0.25]) == {("N0", "N1"): 1.5, ("N0", "c"): 2.0, ("N1", "a"): 0.5, ("N1", "b"): 0.5}


def slow_forward(e, gaps, eta, p, length):
    ln0 = -2 * eta / p * length
    f = np.array([ln0, np.log1p(-np.exp(ln0))]) + e[0]
    for k in range(1, len(e)):
        eel, etl = np.exp(-2 * length * eta / p * (1 - (1 - p) ** gaps[k])), np.exp(ln0)
        p10 = etl * (1 - eel) / (1 - etl)
        t = np.log([[eel, 1 - eel], [p10, 1 - p10]])
        f = e[k] + np.logaddexp(f[0] + t[0], f[1] + t[1])
    return np.logaddexp(*f)


def test_tracts(spark):
    rng = np.random.default_rng(4)
    lnl = -rng.random(40) * 3
    no = lnl - rng.random(40)
    index = np.cumsum(rng.integers(1, 4, 40))
    sites = spark.createDataFrame([("g", k, int(index[k]), float(lnl[k]), float(no[k])) for k in range(40)], "gene string, site int, nt_index int, lnl double, lnl_no double")
    kw = dict(eta=0.2, p=0.3, length=0.7)
    steps = hmm.lattice(sites, **kw)
    ln0 = -2 * 0.2 / 0.3 * 0.7
    e = np.stack([no - ln0, lnl + np.log1p(-np.exp(no - lnl)) - np.log1p(-np.exp(ln0))], axis=1)
    got = hmm.forward(steps).first()["lnl"]
    assert got == pytest.approx(slow_forward(e, [1, *np.diff(index)], 0.2, 0.3, 0.7))
    path = hmm.decode(steps).orderBy("site").collect()
    assert all(0 <= r["posterior"] <= 1 for r in path)
    assert all(np.logaddexp(r["f0"] + r["b0"], r["f1"] + r["b1"]) == pytest.approx(got) for r in path)
    assert path[0]["score"] <= got
    # copies that never reach the next site: sites are independent, and their likelihoods multiply
    one = dict(eta=0.2, p=1.0, length=0.7)
    assert hmm.forward(hmm.lattice(sites, **one)).first()["lnl"] == pytest.approx(lnl.sum())
    grid = hmm.surface(sites, tau=0.5, length=0.7, log_p=[0.0, -1.0]).collect()
    assert len(grid) == 2 and grid[0]["lnl"] == pytest.approx(lnl.sum())


def test_simulation(spark, data):
    _, tree, confs, seqs, events = data
    again = simulate.simulate(spark, simulate.Setting(tree, confs, {e: 0.15 for e in tree.edges}, rates.hky(PI, 3.0), PI, 300, init=0.4, p=0.25, seed=11), 2)[0]
    assert simulate.fingerprint(seqs) == simulate.fingerprint(again.repartition(3))
    assert seqs.filter("length(seq) <> 300").count() == 0
    copies = events.filter("kind = 'copy'")
    r = copies.agg(F.avg("tract_length"), F.count(F.lit(1)), F.min(F.length("template_seq"))).first()
    assert r[0] == pytest.approx(4, rel=0.15)
    n = 0.4 * (300 - 1 + 4) * 2 * 0.15 * 5 * 2  # rate, both directions, five edges of length 0.15 below the duplication, two replicates
    edges = len([e for e in tree.edges if e[0] != "N0"])
    assert r[1] == pytest.approx(n / 5 * edges, rel=0.2)
    m = events.filter("kind = 'mutation'").count()
    genes = sum(2 if a != "N0" else 1 for a, _ in tree.edges)
    assert m == pytest.approx(300 * 0.15 * genes * 2, rel=0.2)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("ll", -1.5), ("kappa", 2.0)], "label string, value double")
    tables.write_summary(rows, str(tmp_path / "a" / "s.txt"))
    assert tables.read_summary(spark, str(tmp_path / "a" / "s.txt")).collect() == rows.collect()
    wide = tables.read_summaries(spark, {"one": str(tmp_path / "a" / "s.txt"), "two": str(tmp_path / "a" / "s.txt")})
    assert {r["label"]: (r["one"], r["two"]) for r in wide.collect()} == {"ll": (-1.5, -1.5), "kappa": (2.0, 2.0)}
    s = spark.createDataFrame([(1, -2.0), (0, -1.0)], "site int, lnl double")
    tables.write_sitewise(s.coalesce(1), str(tmp_path / "sw"))
    assert sorted(map(tuple, tables.read_sitewise(spark, str(tmp_path / "sw")).collect())) == [(0, -1.0), (1, -2.0)]
    assert tables.load_x(str(tmp_path / "none")) is None
    pairs = spark.createDataFrame([(1, 0, 1, -2.5)], "space int, i int, j int, lnl double")
    tables.write_pairwise(pairs, str(tmp_path / "pw"))
    assert spark.read.csv(str(tmp_path / "pw"), sep="\t", header=True).count() == 1
    tables.append_log(s, str(tmp_path / "log"))
    tables.append_log(s, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_scenes_and_moments_as_text(spark, family, tmp_path):
    from helixframe.operators import kernel

    tree, at, _, _, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0})
    s = m.scenes(m.start(PI, length=0.1))[1]
    x = np.stack([r["pattern"] for r in patterns.limit(5).collect()])
    again = kernel.from_json(kernel.to_json(s))
    assert np.array_equal(again.log_likelihoods(x), s.log_likelihoods(x)) and np.array_equal(again.expected_events(x, "copies"), s.expected_events(x, "copies"))
    _, axes, codes, _ = codon_pairs(spark)
    c = CodonModel(newick.parse("((A,B)N1,Out)N0"), axes).scenes(CodonModel(newick.parse("((A,B)N1,Out)N0"), axes).start(PI, length=0.1))[1]
    assert np.array_equal(kernel.from_json(kernel.to_json(c)).log_likelihoods(codes), c.log_likelihoods(codes))
    rows = spark.createDataFrame([(2, [0.1, -1e-9]), (1, [3.0, 4.0])], "n long, g array<double>")
    tables.write_moments(rows, str(tmp_path / "g"), "g")
    assert sorted(r["g"] for r in tables.read_moments(spark, str(tmp_path / "g"), "g").collect()) == [[0.1, -1e-9], [0.1, -1e-9], [3.0, 4.0]]


def test_forward_as_a_stream(spark, tmp_path):
    from helixframe.streaming.forward import append_events, forward_stream

    prior, t = (0.4, 0.6), [[0.9, 0.1], [0.2, 0.8]]
    base = 1_700_000_000
    fold = lambda es: np.logaddexp(*_chain(es, prior, t))
    e = lambda k: (float(-k % 3), float(-(k % 2)))
    batches = [
        [("a", k) for k in range(6)] + [("b", 2)],
        [("a", k) for k in (9, 6, 8, 7)] + [("a", 3)],  # out of order within a batch; 3 comes after later ones were seen
        [("b", 40)],  # moves the watermark past what is remembered of a
        [("c", 60)],
        [("a", 70), ("b", 71)],  # a begins anew
    ]
    source = tmp_path / "in"
    q = None
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(key, base + k, *e(k)) for key, k in rows], "key string, k long, e0 double, e1 double").withColumn("ts", F.timestamp_seconds("k")).drop("k")
        df.coalesce(1).write.mode("append").parquet(str(source))
        if q is None:
            stream = spark.readStream.schema("key string, e0 double, e1 double, ts timestamp").parquet(str(source))
            out = forward_stream(stream, prior, t, delay="1 second", remember=20_000)
            q = out.writeStream.format("memory").queryName("fwd").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.table("fwd").collect():
        seen.setdefault(r["key"], []).append((r["seen"], r["lnl"]))
    assert seen["a"] == [(6, pytest.approx(fold([e(k) for k in range(6)]))), (10, pytest.approx(fold([e(k) for k in range(10)]))), (1, pytest.approx(fold([e(70)])))]
    assert seen["b"] == [(1, pytest.approx(fold([e(2)]))), (2, pytest.approx(fold([e(2), e(40)]))), (1, pytest.approx(fold([e(71)])))] or seen["b"][2][0] == 3
    append_events(spark.readStream.schema("key string, e0 double").parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(map(len, batches))


def test_forward_of_many_rows_and_ties(spark, tmp_path):
    from helixframe.streaming.forward import forward_stream

    prior, t = (0.4, 0.6), [[0.9, 0.1], [0.2, 0.8]]
    rng = np.random.default_rng(5)
    sizes = {"one": 1, "two": 2, "odd": 33, "even": 64}
    es = {k: rng.normal(size=(n, 2)).tolist() for k, n in sizes.items()}
    rows = [(k, 1_700_000_000 + i // 4, i, *map(float, e)) for k, v in es.items() for i, e in enumerate(v)]
    source = tmp_path / "in"
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "key string, k long, nth int, e0 double, e1 double")
    df.select("key", F.timestamp_seconds("k").alias("ts"), "nth", "e0", "e1").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("key string, ts timestamp, nth int, e0 double, e1 double").parquet(str(source))
    out = forward_stream(stream, prior, t, order=["nth"]).writeStream.format("memory").queryName("ties").outputMode("update")
    out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r["key"]: (r["seen"], r["lnl"]) for r in spark.table("ties").collect()}
    assert got == {k: (n, pytest.approx(float(np.logaddexp(*_chain(es[k], prior, t))))) for k, n in sizes.items()}


def _chain(es, prior, t):
    f = np.log(prior) + es[0]
    for x in es[1:]:
        f = np.array(x) + np.logaddexp(f[0] + np.log(t[0]), f[1] + np.log(t[1]))
    return f


def test_tracts_of_a_family(spark, family):
    from helixframe.plans import tracts

    tree, at, _, obs, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0})
    x = dict(zip(m.names, m.start(PI, length=0.15))) | {"tau": np.log(1.6)}
    x = np.array([x[n] for n in m.names])
    sites = tracts.site_likelihoods(obs, patterns, m, x, tables.make_index(spark, 300))
    assert hmm.impossible(sites).count() == 0
    length = tracts.length_below(m, x)
    total = engine.log_likelihood(patterns, {0: m.scenes(x)})[0]
    grid = {r["log_p"]: r["lnl"] for r in hmm.surface(sites, tau=1.6, length=length, log_p=[0.0, -1.0]).collect()}
    assert grid[0.0] == pytest.approx(total, rel=1e-9)  # copies of single sites
    log_p, best = tracts.fit_tract(sites, 1.6, length, rounds=2, points=5)
    assert best >= grid[0.0] and log_p < 0  # the alignment was made with tracts of four


def codon_pairs(spark, n=3, seed=1):
    tree = newick.parse("((A,B)N1,Out)N0")
    axes = [("A", 0), ("A", 1), ("B", 0), ("B", 1), ("Out", 0), ("Out", 1)]
    x = np.random.default_rng(seed).integers(0, 61, (n, 6))
    x[:, 1] = x[:, 0]
    x[0, 2] = -1
    x[:, 5] = x[:, 4]
    return tree, axes, x, spark.createDataFrame([(1, r.tolist(), 2) for r in x], "codon_position int, pattern array<int>, n long")


@pytest.mark.parametrize("selection", ["omega", "homo"])
def test_codon_events_and_dwell(spark, selection):
    tree, axes, x, rows = codon_pairs(spark)
    m = CodonModel(tree, axes, selection=selection)
    y = m.start(PI, length=0.2)
    s = m.scenes(y)[1]
    parts = {w: s.expected_events(x, w) for w in ("all", "mutations", "copies", "copies_1_2", "copies_2_1")}
    assert np.allclose(parts["copies"], parts["copies_1_2"] + parts["copies_2_1"])
    assert np.allclose(parts["all"], parts["copies"] + parts["mutations"])
    dwell = {w: s.dwell_fractions(x, w) for w in ("unlike", "alike", "exit")}
    paired = np.array(s.paired)
    assert np.allclose(dwell["unlike"] + dwell["alike"], 2) and np.allclose(dwell["unlike"][:, ~paired], 0)
    # jumps less what is expected to leave is the derivative by the length's logarithm
    score = s.edge_derivatives(x)
    assert np.allclose(score, parts["all"] - dwell["exit"] * s.lengths, atol=1e-9)
    for k, (a, b) in enumerate(m.edges):
        at, h = m.names.index(f"{a}__{b}"), 1e-5
        up, down = y.copy(), y.copy()
        up[at] += h
        down[at] -= h
        want = (m.scenes(up)[1].log_likelihoods(x) - m.scenes(down)[1].log_likelihoods(x)) / (2 * h)
        assert np.allclose(score[:, k], want, atol=1e-5)
    by_edge = engine.per_edge(rows, m.plan(y), "events", "copies")
    assert np.allclose([by_edge[k] for k in range(len(m.edges))], 2 * parts["copies"].sum(axis=0))
    tau = engine.branch_tau(by_edge, engine.per_edge(rows, m.plan(y), "dwell", "unlike"), s.lengths)
    assert all((v > 0) == bool(paired[k]) for k, v in tau.items())
    with pytest.raises(KeyError):
        s.dwell_fractions(x, "copies")


def simulated_codons(spark, n=250):
    """Patterns of codons drawn from the model itself."""
    tree = newick.splice(newick.parse("((A,B)N1,Out)N0"), [("N0_N1", ["D1"])])
    confs = histories.configurations(tree, {"D1": 0})
    q = rates.mg94(PI, 2.5, 0.4)
    setting = simulate.Setting(tree, confs, {e: 0.25 for e in tree.edges}, q, rates.codon_frequencies(PI), n, init=0.8, p=1.0, seed=5)
    seqs = simulate.simulate(spark, setting, 1)[0].collect()
    by = {(r["node"], r["orlg"]): r["seq"] for r in seqs}
    code = {c: k for k, c in enumerate(rates.CODON_LIST)}
    names = [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("Out", 0), ("Out", 0)]
    cols = [[code[by[k][3 * i : 3 * i + 3]] for i in range(n)] for k in names]
    rows = spark.createDataFrame([(1, list(p), 1) for p in zip(*cols)], "codon_position int, pattern array<int>, n long")
    return newick.parse("((A,B)N1,Out)N0"), [("A", 0), ("A", 1), ("B", 0), ("B", 1), ("Out", 0), ("Out", 1)], rows.groupBy("codon_position", "pattern").agg(F.sum("n").alias("n")).cache()


def test_codon_fit(spark):
    tree, axes, patterns = simulated_codons(spark)
    m = CodonModel(tree, axes)
    x = m.start(PI, length=0.2)
    f, g = estimate.gradient_with_lengths(patterns, m, x)
    _, g2 = estimate.gradient(estimate.objective(patterns, m), x, m.free(), step=1e-4)
    assert np.allclose(g, g2, atol=2e-3)
    better = estimate.length_em(patterns, m, x, rounds=1)
    assert engine.log_likelihood(patterns, {0: m.plan(better)})[0] > f
    got, lnl = estimate.fit(patterns, m, better, rounds=12)
    v = m.named(got)
    assert lnl > f + 1 and 1.5 < v["kappa"] < 4.5 and 0.2 < v["omega"] < 0.7 and 0.2 < v["tau"] < 2.5


def simulated_pairs(spark, sites=240):
    tree = newick.splice(newick.parse("((A,B)N1,Out)N0"), [("N0_N1", ["D1"])])
    confs = histories.configurations(tree, {"D1": 0})
    setting = simulate.Setting(tree, confs, {e: 0.2 for e in tree.edges}, rates.hky(PI, 3.0), PI, sites, init=0.5, p=0.25, seed=9)
    by = {(r["node"], r["orlg"]): r["seq"] for r in simulate.simulate(spark, setting, 1)[0].collect()}
    at = [("A", 0), ("A", 1), ("B", 0), ("B", 1), ("Out", 0)]
    cols = [by[k] for k in (("A", 1), ("A", 2), ("B", 1), ("B", 2), ("Out", 0))]
    obs = spark.createDataFrame([(i, ["ACGT".index(c[i]) for c in cols]) for i in range(sites)], "site int, pattern array<int>")
    pairs = encode.pair_patterns(obs, encode.site_pairs(tables.make_index(spark, sites, coding=False), spaces=[1, 4])).cache()
    groups = [tuple(r) for r in pairs.select("space", "cs_i", "cs_j").distinct().collect()]
    return PairSiteModel(tree, [(n, k) for n, q in at for k in (2 * q, 2 * q + 1)], groups=groups), pairs


def test_pair_fit_and_tract_search(spark):
    m, pairs = simulated_pairs(spark)
    x = m.start(PI, length=0.15)
    f, g = estimate.gradient_with_lengths(pairs, m, x)
    _, g2 = estimate.gradient(estimate.objective(pairs, m), x, m.free(), step=1e-5)
    assert np.allclose(g, g2, rtol=1e-4, atol=2e-3)
    one, best = estimate.fit_tract_of_pairs(pairs, m, x, rounds=2, points=5)
    a, b = m.named(x), m.named(one)
    assert best > f and b["init_rate"] / b["tract_p"] == pytest.approx(a["init_rate"] / a["tract_p"])
    two, most = estimate.fit_tract_of_pairs(pairs, m, x, dimensions=2, rounds=2, points=5)
    assert most >= best - 1e-9 and m.named(two)["kappa"] == pytest.approx(a["kappa"])
    got, lnl = estimate.fit(pairs, m, two, rounds=10)
    v = m.named(got)
    assert lnl > most and 1.5 < v["kappa"] < 6 and 0.03 < v["tract_p"] <= 1


@pytest.mark.parametrize("scale", ["log", "Exp_Neg", "none"])
def test_gradient_on_every_scale(family, scale):
    tree, at, _, _, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0}, transformation=scale)
    x = m.start(PI, length=0.2)
    assert np.allclose(m.scaled(m.real(x)), x)
    _, g = estimate.gradient_with_lengths(patterns, m, x, step=1e-5)
    _, g2 = estimate.gradient(estimate.objective(patterns, m), x, m.free(), step=1e-6)
    assert np.allclose(g, g2, rtol=1e-3, atol=2e-2)
    lo, hi = np.array(m.bounds()).T
    assert np.all(lo < hi) and np.all((x > lo) & (x < hi)) and m.at_bounds(x) == []
    y = x.copy()
    y[4] = lo[4]
    assert m.at_bounds(y) == [m.names[4]]


def test_clock_fit(family):
    tree, at, _, _, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0}, root_split=False)
    spine = ["N0", "D1", "N1", "N2"]
    y, height, ratios, lnl = estimate.fit_clock(patterns, m, m.start(PI, length=0.1), spine, 0.5, [0.8, 0.7, 0.6], rounds=6)
    v = m.named(y)
    assert v["N0__Out"] == pytest.approx(height) and v["N2__A"] == pytest.approx(v["N2__B"]) and v["N1__C"] == pytest.approx(height * ratios[0] * ratios[1])
    free = estimate.fit(patterns, m, y, rounds=4)[1]
    assert free >= lnl > engine.log_likelihood(patterns, {0: m.plan(m.start(PI, length=0.1))})[0]


def test_three_epochs(spark):
    from helixframe.plans.models import three_epoch_model

    axes = [(s, p) for s in ("A", "B") for p in range(3)]
    m = three_epoch_model(newick.parse("(A,B)N0"), axes)
    assert len([n for n in m.names if n.startswith("tau")]) == 8 and len(m.kinds) == 3
    assert [len(histories.divide(c)["loc"]) for c in (m.confs["N0"], m.confs["D1"], m.confs["D2"])] == [1, 2, 3]
    rows = spark.createDataFrame([(1, np.random.default_rng(2).integers(0, 4, 6).tolist(), 1) for _ in range(5)], "codon_position int, pattern array<int>, n long")
    x = m.start(PI, length=0.2)
    f, g = estimate.gradient_with_lengths(rows, m, x)
    _, g2 = estimate.gradient(estimate.objective(rows, m), x, m.free(), step=1e-5)
    assert np.isfinite(f) and np.allclose(g, g2, atol=1e-4)
    changes = {(r["parent"], r["child"], r["orlg"], r["change"]) for r in histories.group_changes(spark, m.tree, m.confs).collect()}
    assert {c[3] for c in changes if c[1] == "D2"} == {"gone", "born"} and len([c for c in changes if c[1] == "D2"]) == 3
    assert m.run_name("f") == "joint_f_general" and "D2 (duplication)" in m.report(x)


def test_sites_by_edges_and_distance_grid(spark, family):
    tree, at, _, obs, patterns = family
    m = JointModel(tree, at, event_group={"D1": 0})
    s = m.scenes(m.start(PI, length=0.1))
    long = engine.sitewise_edges(obs, patterns, s, "events", "copies")
    assert long.groupBy("edge").agg(F.sum("value")).count() == len(m.edges)
    total = engine.per_edge(patterns, s, "events", "copies")
    assert {r["edge"]: pytest.approx(r["v"], abs=1e-9) for r in long.groupBy("edge").agg(F.sum("value").alias("v")).collect()} == total
    assert len(engine.posterior_matrix(long, [0, 1, 2]).columns) == 4
    pairs = encode.pair_patterns(obs, encode.site_pairs(tables.make_index(spark, 300).filter("site < 12"), spaces=[1, 2]))
    groups = [tuple(r) for r in pairs.select("space", "cs_i", "cs_j").distinct().collect()]
    p = PairSiteModel(tree, [(n, k) for n, q in at for k in (2 * q, 2 * q + 1)], groups=groups)
    points = {}
    for lp in (0.0, -1.0):
        v = dict(zip(p.names, p.start(PI, length=0.1))) | {"init_rate": np.log(0.2), "tract_p": lp}
        points[lp] = p.scenes(np.array([v[n] for n in p.names]))
    grid = engine.distance_grid(pairs, points).collect()
    assert len(grid) == 4 and all(np.isfinite(r["lnl"]) for r in grid)


def test_clock_gradient():
    from helixframe.plans.models import clock_gradient

    t = newick.parse("((a,b)N1,c)N0")
    f = lambda l: sum((k + 1) * np.log(v) ** 2 for k, v in enumerate(l.values()))
    at = lengths_from_clock(t, ["N0", "N1"], 2.0, [0.25])
    by = {e: 2 * (k + 1) * np.log(v) for k, (e, v) in enumerate(at.items())}
    got = clock_gradient(by, t, ["N0", "N1"], 2.0, [0.25])
    h = 1e-6
    want = [(f(lengths_from_clock(t, ["N0", "N1"], 2 * np.exp(h), [0.25])) - f(at)) / h, (f(lengths_from_clock(t, ["N0", "N1"], 2.0, [0.25 * np.exp(h)])) - f(at)) / h]
    assert np.allclose(got, want, atol=1e-4)


def test_best_paths_by_enumeration(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for g in range(12):
        n = int(rng.integers(1, 8))
        lnl = -np.round(rng.random(n) * 3, 1)
        no = lnl - np.round(rng.random(n), 1) - 0.1
        index = np.cumsum(rng.integers(1, 4, n))
        groups[f"g{g}"] = (index, lnl, no)
    rows = [(g, k, int(i[k]), float(a[k]), float(b[k])) for g, (i, a, b) in groups.items() for k in range(len(i))]
    sites = spark.createDataFrame(rows, "gene string, site int, nt_index int, lnl double, lnl_no double").repartition(2)
    kw = dict(eta=0.2, p=0.3, length=0.7)
    steps = hmm.lattice(sites, **kw).cache()
    got = {}
    for r in hmm.decode(steps, most=10).orderBy("gene", "site").collect():
        got.setdefault(r["gene"], []).append(r)
    assert {g: len(v) for g, v in got.items()} == {g: len(i) for g, (i, _, _) in groups.items()}
    folds = {r["gene"]: r for r in hmm.viterbi(steps).collect()}
    for row in steps.collect():
        s, first = row["steps"], [row["first"]["a"], row["first"]["b"]]
        scores = {}
        for path in product((0, 1), repeat=len(s)):
            v = first[path[0]] + s[0][f"e{path[0]}"]
            for k in range(1, len(s)):
                v += s[k][f"p{path[k - 1]}{path[k]}"] + s[k][f"e{path[k]}"]
            scores[path] = v
        top = max(scores.values())
        path = tuple(r["state"] for r in got[row["gene"]])
        assert scores[path] == pytest.approx(top) and got[row["gene"]][0]["score"] == pytest.approx(top)
        assert folds[row["gene"]]["score"] == pytest.approx(top) and folds[row["gene"]]["last_state"] == path[-1]
        total = np.logaddexp.reduce(list(scores.values()))
        for k, r in enumerate(got[row["gene"]]):
            assert r["posterior"] == pytest.approx(np.exp(np.logaddexp.reduce([v for p, v in scores.items() if p[k]]) - total))
    assert hmm.decode(steps.limit(0)).count() == 0
    even = steps.withColumn("steps", F.transform("steps", lambda s: F.struct(s["site"].alias("site"), F.lit(0.0).alias("e0"), F.lit(0.0).alias("e1"), s["lnl"].alias("lnl"), *[F.lit(-0.5).alias(n) for n in ("p00", "p01", "p10", "p11")])))
    even = even.withColumn("first", F.struct(F.lit(-0.7).alias("a"), F.lit(-0.7).alias("b")))
    assert hmm.decode(even).filter("state <> 0").count() == 0 and hmm.viterbi(even).filter("last_state <> 0").count() == 0  # ties


def test_relations_of_histories(spark):
    rows = spark.createDataFrame([("r", "a"), ("a", "b"), ("a", "c"), ("c", "d"), ("x", "y")], "parent string, child string")
    assert {tuple(r) for r in forest.paths(rows, "r").collect()} == {("a", 1, "r/a"), ("b", 2, "r/a/b"), ("c", 2, "r/a/c"), ("d", 3, "r/a/c/d")}
    with pytest.raises(ValueError):
        forest.paths(spark.createDataFrame([("r", "a"), ("a", "r")], "parent string, child string"), "r", deepest=4)
    held = spark.createDataFrame([("m", 1), ("m", 2), ("m", 2), ("n", 1), ("n", 2), ("n", 3)], "node string, orlg int")
    assert {tuple(r) for r in histories.accessible_pair_relation(held).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}
    runs = histories.run_relation(spark.createDataFrame([("a", k) for k in (1, 2, 2, 4, 7, 8, 9)], "g string, pos int"), "g").orderBy("start")
    assert [(r["start"], r["n"]) for r in runs.collect()] == [(1, 2), (4, 1), (7, 3)]
    with pytest.raises(ValueError):
        histories.configurations(newick.splice(newick.parse(TREE), [("N0_N1", ["D1"])]), {"D1": 0, "L9": 0})


def test_pair_counts_at_every_distance(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 1, 2, 7, 40, 40, 131)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "seq string")
    want = {}
    classes = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, len(t)):
                key = (j - i, "ACGT".index(t[i]), "ACGT".index(t[j]))
                want[key] = want.get(key, 0) + 1
                if i // 3 != j // 3:
                    c = (i % 3 + 1, j % 3 + 1, j - i)
                    classes[c] = classes.get(c, 0) + 1
    assert {tuple(r)[:3]: r["n"] for r in encode.pair_state_counts(rows).collect()} == want
    got = encode.codon_site_pairs(rows.select(F.length("seq").alias("n_sites")), same_codon=False)
    assert {tuple(r)[:3]: r["n"] for r in got.collect()} == classes
    index = tables.make_index(spark, 40).filter("site not in (3, 4, 20)")
    at = {r["nt_index"] for r in index.collect()}
    pairs = {(r["i"], r["j"]) for r in encode.site_pairs(index, width=8).collect()}
    assert pairs == {(a - 1, b - 1) for a in at for b in at if a < b}
    two = index.withColumn("gene", F.lit("x")).unionByName(index.filter("site < 9").withColumn("gene", F.lit("y")))
    assert encode.site_pairs(two, by=["gene"], width=8).groupBy("gene").count().count() == 2


def test_simulation_by_direction(spark):
    tree = newick.splice(newick.parse("(A,Out)N0"), [("N0_A", ["D1"])])
    confs = histories.configurations(tree, {"D1": 0})
    one_way = simulate.Setting(tree, confs, {e: 1.0 for e in tree.edges}, rates.mg94(PI, 2.0, 0.5), rates.codon_frequencies(PI), 20, init={(1, 2): 0.3}, p={(1, 2): 0.5}, seed=3)
    seqs, events = simulate.simulate(spark, one_way, 60)
    assert events.filter("kind = 'copy' and not (orlg_from = 1 and orlg_to = 2)").count() == 0
    assert events.filter("kind = 'copy' and (tract_length % 3 <> 0 or start_pos % 3 <> 0 or stop_pos % 3 <> 2)").count() == 0
    assert events.filter("kind = 'mutation' and mut_pos % 3 <> 0").count() == 0 and seqs.filter("length(seq) <> 60").count() == 0
    want = simulate.expected_events(one_way, 60)
    got = {(r["edge"], r["kind"]): r["count"] for r in events.groupBy("edge", "kind").count().collect()}
    for (a, b, kind), v in want.items():
        assert abs(got.get((f"{a}_{b}", kind), 0) - v) <= 5 * np.sqrt(v)


def test_input_checks(spark):
    index = tables.make_index(spark, 9)
    tables.check_index(index, 9, coding=True)
    for bad in (lambda: tables.check_index(index, 10), lambda: tables.check_index(index.withColumn("codon_site", F.lit(4)), 9, coding=True)):
        with pytest.raises(ValueError):
            bad()
    seqs = spark.createDataFrame([("A__x",)], "name string")
    genes = spark.createDataFrame([("A__x", 1)], "gene string, orlg int")
    tables.check_genes(seqs, genes, ["A"])
    for s, g, t in ((seqs, genes, ["B"]), (seqs.limit(0), genes, ["A"]), (seqs, genes.limit(0), ["A"])):
        with pytest.raises(ValueError):
            tables.check_genes(s, g, t)


def test_predicates():
    conf = ((1, 1), (2, 1), (2, 1), (3, 0))
    assert rates.is_configuration(conf) and not rates.is_configuration(((1, 1), (1, 0))) and not rates.is_configuration(((1, 2),))
    assert rates.is_state_of((0, 1, 1, 2), conf) and not rates.is_state_of((0, 1, 2, 2), conf) and not rates.is_state_of((0, 1, 1, 4), conf)
    assert rates.is_transition_of((0, 1, 1, 2), (3, 1, 1, 2), conf) and rates.is_transition_of((0, 1, 1, 2), (0, 3, 3, 2), conf)
    assert not rates.is_transition_of((0, 1, 1, 2), (0, 1, 1, 3), conf) and not rates.is_transition_of((0, 1, 1, 2), (3, 2, 2, 2), conf)
    all_ = rates.states(4)
    pair = rates.pair_site(rates.hky(PI, 2.0), rates.hky(PI, 2.0), 2, 0.3, 0.4).rates
    single = rates.pair_site_single(rates.hky(PI, 2.0), rates.hky(PI, 2.0))
    ends = [(i, j) for i in range(0, 256, 7) for j in range(256)]
    assert all((pair[i, j] > 0) == (i != j and rates.is_pair_transition(all_[i], all_[j])) for i, j in ends)
    assert all((single[i, j] > 0) == rates.is_single_transition(all_[i], all_[j]) for i, j in ends)
