"""Likelihoods, events and tracts of published analyses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import encode, engine, estimate, histories, hmm
from helixframe.plans.models import CodonModel, JointModel, PairSiteModel, logit_tract, no_copy_lnl
from helixframe.sources import newick, tables

from . import golden_data as data

PRIMATES = "((((Chimpanzee,Gorilla)N3,Orangutan)N2,Macaque)N1,Tamarin)N0"
YEASTS = "((((((cerevisiae,paradoxus)N5,mikatae)N4,kudriavzevii)N3,bayanus)N2,castellii)N1,kluyveri)N0"


def sequences(spark, alignment):
    return spark.createDataFrame([(k, *k.split("__"), v) for k, v in alignment.items()], "name string, species string, gene string, seq string")


def family(spark, alignment, newick_text, genes, single):
    """Tree, axes and sites' patterns of two genes that were duplicated below the root; ``single`` is the outgroup."""
    tree = newick.splice(newick.parse(newick_text), [("N0_N1", ["D1"])])
    confs = histories.configurations(tree, {"D1": 0})
    rows = [(k, 0 if k.startswith(single) else 1 + genes.index(k.split("__")[1])) for k in alignment]
    axes = encode.axes(spark.createDataFrame(rows, "gene string, orlg int"), histories.configuration_relation(spark, confs))
    obs = encode.observations(encode.site_states(sequences(spark, alignment)), axes)
    return tree, [(r["node"], r["pos"]) for r in axes.orderBy("axis").collect()], obs.cache()


@pytest.fixture(scope="module")
def primates(spark):
    return family(spark, data.PRIMATE, PRIMATES, ["EDN", "ECP"], "Tamarin")


@pytest.fixture(scope="module")
def yeasts(spark):
    return family(spark, data.YEAST, YEASTS, ["YDR418W", "YEL054C"], "kluyveri")


def vector(model, summary):
    """x of a summary's values."""
    a, c, g, t = (summary[f"Pi_{n}"] for n in "ACGT")
    real = {"%AG": a + g, "%A": a / (a + g), "%C": c / (c + t), "tau": summary["Tau"]} | summary
    if "root__both" in model.names:
        real["root__both"] = sum(v for k, v in summary.items() if k.startswith("N0__"))
    with np.errstate(divide="ignore"):
        return np.log([real[n] for n in model.names])


@pytest.mark.parametrize("summary, lnl", [("PRIMATE_RATES", -1713.0603289117012), ("PRIMATE_PLAIN", -1716.6062752704), ("PRIMATE_NO_COPIES", -1729.731777922953), ("PRIMATE_NO_COPIES_RATES", -1725.6668315900745)])
def test_primates(primates, summary, lnl):
    tree, axes, obs = primates
    summary = getattr(data, summary)
    m = JointModel(tree, axes, event_group={"D1": 0}, rate_variation="r2" in summary)
    got = engine.log_likelihood(encode.compress(obs, codon_position=m.rate_variation), {0: m.plan(vector(m, summary))})[0]
    assert got == pytest.approx(lnl, rel=1e-9)


@pytest.mark.parametrize("summary, lnl", [("YEAST_PLAIN", -1867.784976645374), ("YEAST_RATES", -1739.5043718726465)])
def test_yeasts(yeasts, summary, lnl):
    tree, axes, obs = yeasts
    summary = getattr(data, summary)
    m = JointModel(tree, axes, event_group={"D1": 0}, rate_variation="r2" in summary)
    got = engine.log_likelihood(encode.compress(obs, codon_position=m.rate_variation), {0: m.plan(vector(m, summary))})[0]
    assert got == pytest.approx(lnl, rel=1e-9)


def test_events_of_primates(primates):
    tree, axes, obs = primates
    m = JointModel(tree, axes, event_group={"D1": 0}, rate_variation=True)
    plan, patterns = m.plan(vector(m, data.PRIMATE_RATES)), encode.compress(obs)
    copies, mutations = ({"__".join(m.edges[k]): v for k, v in engine.per_edge(patterns, plan, "events", w).items()} for w in ("copies", "mutations"))
    assert copies["D1__N1"] == pytest.approx(7.277652637878489, rel=1e-9) and copies["N1__Macaque"] == pytest.approx(9.730920716424718, rel=1e-9)
    assert copies["N0__D1"] == 0 and copies["N0__Tamarin"] == 0
    want = {"D1__N1": 67.29468643085127, "N0__D1": 4.90460122533071, "N0__Tamarin": 44.15641469464546, "N1__Macaque": 52.00523322075103}
    assert {k: mutations[k] for k in want} == pytest.approx(want, rel=1e-9)


def test_second_pair_of_yeasts(spark):
    tree, axes, obs = family(spark, data.YEAST_2, YEASTS, ["YLR406C", "YDL075W"], "kluyveri")
    m = JointModel(tree, axes, event_group={"D1": 0})
    plan, patterns = m.plan(vector(m, data.YEAST_2_PLAIN)), encode.compress(obs, codon_position=False)
    assert engine.log_likelihood(patterns, {0: plan})[0] == pytest.approx(-1268.6143276277644, rel=1e-9)
    copies = {"__".join(m.edges[k]): v for k, v in engine.per_edge(patterns, plan, "events", "copies").items()}
    assert copies["D1__N1"] == pytest.approx(7.356852400111536, rel=1e-9) and copies["N1__castellii"] == pytest.approx(11.576366456993291, rel=1e-9)


def test_sites_and_tracts_of_primates(spark, primates):
    tree, axes, obs = primates
    plain = JointModel(tree, axes, event_group={"D1": 0})
    each = {r["site"]: r["lnl"] for r in engine.sitewise(obs, encode.compress(obs, codon_position=False), plain.scenes(vector(plain, data.PRIMATE_PLAIN))).collect()}
    assert len(each) == 471 and sum(each.values()) == pytest.approx(-1716.606275270, abs=1e-8)
    assert [each[k] for k in (0, 99, 470)] == pytest.approx([-1.68526177022, -6.21813312192, -1.80818374292], abs=1e-9)
    # a model without a node at the duplication: it stands at the root, and the whole branch to N1 is below it
    m = JointModel(tree, axes, event_group={"D1": 0}, rate_variation=True, root_split=False)
    old = dict(zip(["%AG", "%A", "%C", "kappa", "r2", "r3", "tau", "D1__N1", "N0__Tamarin", "N1__N2", "N1__Macaque", "N2__N3", "N2__Orangutan", "N3__Chimpanzee", "N3__Gorilla"], data.PRIMATE_LOGS)) | {"N0__D1": -np.inf}
    x = np.array([old[n] for n in m.names])
    patterns = encode.compress(obs)
    lnl = engine.sitewise(obs, patterns, m.scenes(x)).cache()
    each = {r["site"]: r["lnl"] for r in lnl.collect()}
    assert sum(each.values()) == pytest.approx(-1713.060334603, abs=1e-7)
    assert [each[k] for k in (0, 99, 470)] == pytest.approx([-1.57983290493, -6.41265576415, -1.88229487114], abs=1e-9)
    zero = x.copy()
    zero[m.names.index("tau")] = -np.inf
    tau, length = np.exp(old["tau"]), sum(t for (a, _), t in zip(m.edges, m.lengths(m.named(x))) if a != "N0")
    assert (tau, length) == pytest.approx((2.4308, 0.13442), rel=1e-4)
    without = engine.sitewise(obs, patterns, m.scenes(zero)).withColumn("lnl", F.col("lnl") + float(no_copy_lnl(0.0, tau, length)))
    each = {r["site"]: r["lnl"] for r in without.collect()}
    assert sum(each.values()) == pytest.approx(-2039.166042670, abs=1e-7)
    assert [each[k] for k in (0, 99, 470)] == pytest.approx([-2.24387775866, -6.5466015573, -2.55373075958], abs=1e-9)
    sites = hmm.tract_sites(lnl, without, tables.make_index(spark, 471)).withColumn("gene", F.lit("g"))
    grid = {r["log_p"]: r["lnl"] for r in hmm.surface(sites, tau=float(tau), length=float(length), log_p=[0.0, -4.2266]).collect()}
    assert grid[0.0] == pytest.approx(-1713.0603346, abs=1e-3) and grid[-4.2266] == pytest.approx(-1705.2667, abs=1e-3)


def test_codons_of_primates(spark):
    edges = [("N0", "N1"), ("N0", "Tamarin"), ("N1", "N2"), ("N1", "Macaque"), ("N2", "N3"), ("N2", "Orangutan"), ("N3", "Chimpanzee"), ("N3", "Gorilla")]
    sites = encode.site_states(sequences(spark, data.PRIMATE), codon=True)
    names = sorted(data.PRIMATE)
    axes = spark.createDataFrame([(k, n, n.split("__")[0], ["EDN", "ECP"].index(n.split("__")[1])) for k, n in enumerate(names)], "axis int, name string, node string, pos int")
    patterns = encode.compress(encode.observations(sites, axes), codon_position=False)
    m = CodonModel(newick.parse(PRIMATES), [(r["node"], r["pos"]) for r in axes.orderBy("axis").collect()], edge_order=edges)
    assert patterns.agg(F.sum("n")).first()[0] == 157
    assert engine.log_likelihood(patterns, {0: m.plan(np.array(data.PRIMATE_CODON_LOGS))})[0] == pytest.approx(-1700.6672390366, abs=1e-5)


def pairs_of(spark, alignment, index, spaces):
    tree, axes, obs = family(spark, alignment, YEASTS, ["YDR418W", "YEL054C"], "kluyveri")
    patterns = encode.pair_patterns(obs, encode.site_pairs(index, spaces=spaces))
    return tree, [(n, k) for n, q in axes for k in (2 * q, 2 * q + 1)], patterns.cache(), [tuple(r) for r in patterns.select("space", "cs_i", "cs_j").distinct().collect()]


def pair_vector(m, length, **more):
    real = {"%AG": 0.5, "%A": 0.5, "%C": 0.5, "kappa": 4.35588244, "r2": 1.5, "r3": 5.0} | more
    with np.errstate(divide="ignore"):
        return np.log([real.get(n, length.get(n, length[""]) if "__" in n else None) for n in m.names])


def test_pairs_of_sites_of_yeasts(spark):
    jump = tables.make_index(spark, 489).withColumn("nt_index", F.when(F.col("site") >= 237, F.col("nt_index") + 3).otherwise(F.col("nt_index")))
    tree, axes, patterns, groups = pairs_of(spark, data.YEAST, jump, [1, 2])
    m = PairSiteModel(tree, axes, rate_variation=True, root_split=False, groups=groups)
    got = engine.pattern_values(patterns, {0: m.plan(pair_vector(m, {"": 1.0}, init_rate=0.0, tract_p=1.0))}, keys=m.keys)
    got = {(r["space"], r["cs_i"], r["cs_j"]): r["v"] for r in got.groupBy(*m.keys).agg(F.sum(F.col("n") * F.col("value")).alias("v")).collect()}
    assert [got[k] for k in ((1, 1, 2), (1, 2, 3), (2, 1, 3))] == pytest.approx([-5251.584676106582, -5693.500662621693, -5431.747983027612], abs=1e-6)


def test_derivatives_of_pairs_of_sites(spark):
    tree, axes, patterns, groups = pairs_of(spark, data.TINY, tables.make_index(spark, 6), [1, 2, 3, 4, 5])
    m = PairSiteModel(tree, axes, rate_variation=True, groups=groups)
    x = pair_vector(m, {"": 0.01, "root__both": 0.01}, init_rate=1.0, tract_p=0.5)
    chosen = [m.names.index("init_rate"), m.names.index("tract_p")]
    x[chosen] = np.log(4), np.log(0.3)
    moments = estimate.pattern_moments(patterns, m, x, chosen, transform=logit_tract)
    got = sorted(tuple(r["g"]) for r in moments.collect() for _ in range(r["n"]))
    want = sorted(data.TINY_GRADIENTS)
    assert len(got) == 15
    assert [a for a, _ in got] == pytest.approx([a for a, _ in want], abs=1e-7)
    assert sorted(b for _, b in got) == pytest.approx(sorted(b for _, b in want), abs=1e-6)
