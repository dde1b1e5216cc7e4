import numpy as np
import pytest

from helixframe.functions.alphabet import AMINO_ACID, CODON_STATE, SENSE_CODONS, is_homogenising, is_nonsynonymous
from helixframe.functions.matrix import expm, generator, integral
from helixframe.operators import kernel, rate_relations, rates
from helixframe.operators.histories import accessible_pairs, configurations, processes, runs, without_root
from helixframe.sources.newick import node_kind, parse, post_duplication_edges, report, splice, three_epochs, with_duplicated_root

PI = rates.base_frequencies(0.55, 0.4, 0.6)
PRIMATES = "((((Chimpanzee,Gorilla)N3,Orangutan)N2,Macaque)N1,Tamarin)N0"


def test_alphabet():
    assert len(SENSE_CODONS) == 61 and SENSE_CODONS[:2] == ["TTT", "TTC"] and CODON_STATE["GGG"] == 60
    assert AMINO_ACID["ATG"] == "M" and AMINO_ACID["TAA"] == "*"


def test_tree_and_histories():
    t = parse(PRIMATES + ";")
    assert t.root == "N0" and t.tips == ["Tamarin", "Macaque", "Orangutan", "Chimpanzee", "Gorilla"] and t.path("Gorilla") == ["N0", "N1", "N2", "N3", "Gorilla"]
    assert parse("(a:1.5,b:2e-1)N0").lengths == {("N0", "a"): 1.5, ("N0", "b"): 0.2}
    assert [node_kind(n) for n in ("D1", "L12", "N0", "Nile", "D")] == ["duplication", "loss", "speciation", "tip", "tip"]
    with pytest.raises(ValueError):
        parse("((a,b)N1,c")
    d = splice(t, [("N0_N1", ["D1"])])
    assert d.sorted_edges()[0] == ("D1", "N1") and ("N0", "N1") not in d.edges
    conf = configurations(d, {"D1": 0})
    assert conf["N0"] == ((0, 1), (0, 1)) and conf["Gorilla"] == ((1, 1), (2, 1)) and conf["Tamarin"] == ((0, 1), (0, 1))
    kinds, of = processes(d, conf)
    assert len(kinds) == 2 and of[("N0", "D1")] == 0 and of[("D1", "N1")] == 1
    assert ("D1", "N1") in post_duplication_edges(d, "D1") and ("N0", "Tamarin") not in post_duplication_edges(d, "D1")
    assert accessible_pairs(list(conf.values())) == [(1, 2)]
    three = three_epochs(parse("((a,b)x,c)y"))
    assert three.path("a") == ["N0", "N1", "N2", "N3", "a"] and with_duplicated_root(t, "N0").root == "dup" and with_duplicated_root(t, "N1").root == "N0"
    assert "D1 (duplication) [(1, 1), (2, 1)]" in report(d, conf)
    assert is_homogenising("CTT", "TTA") and is_nonsynonymous("ATG", "ATA")
    assert runs([5, 1, 2, 3, 7, 8]) == [(1, 3), (5, 5), (7, 8)]


def test_history_with_losses_and_many_copies():
    t = splice(parse("((((Human, Gorilla)N4, Orangutan)N3, (Olive_Baboon, Macaque)N2)N1, Chinese_Tree_Shrew)N0"), [("N0_N1", ["D1", "D2", "D3"]), ("N1_N3", ["L1"]), ("N2_Macaque", ["D4"])])
    conf = configurations(t, {"D1": 0, "D2": 0, "D3": 1, "D4": 2, "L1": 2})
    assert len({len(c) for c in conf.values()}) == 1 and len(conf["N0"]) == 5
    assert {o for o, a in conf["N3"] if not a} == {6} and len({o for o, _ in conf["Macaque"]}) == 5
    no_outgroup = splice(parse("((LmjF, LinJ)N1, LtaP)N0;"), [("Root_N0", ["D1", "D2"])])
    conf = configurations(no_outgroup, {"D1": 0, "D2": 0})
    tree, conf = without_root(no_outgroup, conf)
    assert tree.root == "D1" and "Root" not in conf
    with pytest.raises(ValueError):
        configurations(t, {"D1": 0})


def test_cardinalities():
    q = rates.hky(PI, 2.0)
    assert (rates.mg94(PI, 2.0, 0.5) > 0).sum() == 526
    assert (rates.joint(((1, 1), (2, 1)), q, {(1, 2): 1.0, (2, 1): 1.0}).rates > 0).sum() == 96
    assert (rates.joint(((0, 1), (0, 1)), q, {}).rates > 0).sum() == 12
    assert (rates.pair_site(q, q, 3, 0.1, 0.2).rates > 0).sum() == 3360
    assert (rates.pair_site_single(q, q) > 0).sum() == 96
    no = rates.no_copy_absorbing(q, 0.7)
    assert (no[:16, :16] > 0).sum() == 96 and (no[:, 16] > 0).sum() == 16


def test_rates_are_normal_and_stationary():
    q = rates.hky(PI, 3.0)
    assert PI @ q.sum(axis=1) == pytest.approx(1) and np.allclose(PI @ generator(q), 0)
    m, pc = rates.mg94(PI, 3.0, 0.3), rates.codon_frequencies(PI)
    assert pc @ m.sum(axis=1) == pytest.approx(1) and np.allclose(pc @ generator(m), 0)
    h = rates.homogenising(PI, 3.0, 0.3, 0.3)
    assert np.allclose(h[0], rates.mg94(PI, 3.0, 0.3), atol=1e-9)


@pytest.mark.parametrize("conf", [((1, 1), (2, 1)), ((1, 1), (2, 1), (2, 1)), ((1, 1), (2, 0), (3, 1)), ((4, 1), (2, 1), (3, 1))])
def test_joint_equals_brute_force(conf):
    q = rates.hky(PI, 2.0)
    groups = sorted({o for o, a in conf if a})
    tau = {(a, b): 0.1 * a + b for a in groups for b in groups if a != b}
    p = rates.joint(conf, q, tau)
    assert np.allclose(p.rates, rates.joint_brute(conf, q, tau))
    assert np.all((p.copy_share() + p.mutation_share() == 1) | (p.rates == 0))


def test_pair_site_equals_brute_force():
    q = rates.hky(PI, 2.0)
    p = rates.pair_site(q, 1.5 * q, 3, 0.2, 0.3)
    assert np.allclose(p.rates, rates.pair_site_brute(q, 1.5 * q, 3, 0.2, 0.3))
    rows = rates.relation(p)
    assert len(rows) == 3360 and all(0 <= s <= 1 for *_, s in rows)


def test_three_copies_are_the_general_model():
    """Three epochs: one copy, two and three; the last has each of its copies changed by the two others."""
    q = rates.hky(PI, 2.0)
    tau = {(a, b): 0.1 * (3 * a + b) for a in (2, 3, 4) for b in (2, 3, 4) if a != b}
    last = rates.joint(((3, 1), (4, 1), (2, 1)), q, tau).rates
    s = int("012", 4)
    assert last[s, int("112", 4)] == pytest.approx(q[0, 1] + tau[4, 3]) and last[s, int("212", 4)] == pytest.approx(q[0, 2] + tau[2, 3])
    assert last[s, int("312", 4)] == pytest.approx(q[0, 3])
    two = rates.joint(((1, 1), (1, 1), (2, 1)), q, {(1, 2): 0.5, (2, 1): 0.7}).rates
    assert two[int("001", 4), int("111", 4)] == pytest.approx(q[0, 1] + 0.7) and two[int("001", 4), int("101", 4)] == 0


def test_copy_rates():
    pairs = [(1, 2), (1, 3), (2, 3)]
    assert set(rates.copy_rates("one", pairs, [2.0]).values()) == {2.0}
    g = rates.copy_rates("general", pairs, [1, 2, 3, 4, 5, 6])
    assert g[1, 2] == 1 and g[2, 1] == 4 and g[3, 2] == 6
    assert rates.copy_rates("symmetric", pairs, [1, 2, 3])[3, 1] == 2
    with pytest.raises(ValueError):
        rates.copy_rates("tract", pairs, [1])


def test_matrix_functions():
    q = generator(rates.hky(PI, 2.0))
    p = expm(q * 0.7)
    w, v = np.linalg.eig(q)
    assert np.allclose(p, (v @ np.diag(np.exp(w * 0.7)) @ np.linalg.inv(v)).real)
    c = np.diag([1.0, 2, 3, 4])
    h = 0.7 / 2000
    s = (np.arange(2000) + 0.5) * h
    assert np.allclose(integral(q, c, 0.7), sum(expm(q * a) @ c @ expm(q * (0.7 - a)) for a in s) * h, atol=1e-6)


def test_codon_pair_action_is_the_generator():
    q, t = rates.codon_pair(rates.mg94(PI, 2.0, 0.4), 0.8, 0.3)
    rng = np.random.default_rng(0)
    m = rng.random((2, 61, 61))
    got = rates.codon_pair_action(q, t, m)
    for a, b in rng.integers(0, 61, (12, 2)):
        want = 0.0
        for c in range(61):
            if c != a:
                want += (q[a, c] + (t[a, b] if c == b else 0)) * (m[1, c, b] - m[1, a, b])
            if c != b:
                want += (q[b, c] + (t[b, a] if c == a else 0)) * (m[1, a, c] - m[1, a, b])
        assert got[1, a, b] == pytest.approx(want)


def scene(tau=1.0, lengths=None):
    d = splice(parse(PRIMATES), [("N0_N1", ["D1"])])
    conf = configurations(d, {"D1": 0})
    kinds, of = processes(d, conf)
    ps = [rates.joint(c, rates.hky(PI, 2.0), {(1, 2): tau, (2, 1): tau}) for c in kinds]
    edges = d.sorted_edges()
    axes = [(n, p) for n in ("Chimpanzee", "Gorilla", "Orangutan", "Macaque") for p in (0, 1)] + [("Tamarin", 0), ("Tamarin", 1)]
    return kernel.Scene(edges, np.linspace(0.05, 0.4, len(edges)) if lengths is None else lengths, [of[e] for e in edges], [p.q for p in ps], rates.root_prior(conf["N0"], PI), (4, 4), axes), ps


def patterns(n=40):
    x = np.random.default_rng(1).integers(-1, 4, (n, 10))
    x[:, 9] = x[:, 8]
    return x


def test_likelihood_invariants():
    s, _ = scene()
    x = patterns()
    lnl = kernel.log_likelihoods(s, x)
    swapped = x[:, [1, 0, 3, 2, 5, 4, 7, 6, 9, 8]]
    assert np.allclose(lnl, kernel.log_likelihoods(s, swapped))
    assert kernel.log_likelihoods(s, np.full((1, 10), -1))[0] == pytest.approx(0, abs=1e-12)
    one = np.full((4, 10), -1)
    one[:, 0] = range(4)
    assert np.exp(kernel.log_likelihoods(s, one)).sum() == pytest.approx(1)
    # without copies the two copies below the duplication are independent given their common start
    free, _ = scene(tau=0.0)
    only = x.copy()
    only[:, 1::2] = -1
    assert np.all(np.isfinite(kernel.log_likelihoods(free, only)))


def test_no_copy_closed_form():
    """The absorbing model's likelihood is that at tau = 0, less 2 tau of the length after the duplication."""
    from helixframe.plans.models import no_copy_lnl

    s, _ = scene(tau=0.0)
    tau, x = 0.9, patterns()
    x = np.where(x < 0, 0, x)
    x[:, 9] = x[:, 8]
    q = rates.hky(PI, 2.0)
    single = np.zeros((17, 17))
    single[:16, :16] = rates.joint(((0, 1), (0, 1)), q, {}).rates
    absorbing = kernel.Scene(s.edges, s.lengths, s.process, [generator(single), generator(rates.no_copy_absorbing(q, tau))], np.append(s.prior, 0.0), (17,), [])
    # tips are observed in a pair state each
    tips = ["Chimpanzee", "Gorilla", "Orangutan", "Macaque", "Tamarin"]
    absorbing.axes = [(t, 0) for t in tips]
    pair = x[:, 0::2] * 4 + x[:, 1::2]
    post = sum(t for (a, _), t in zip(s.edges, s.lengths) if a != "N0")
    assert np.allclose(kernel.log_likelihoods(absorbing, pair), no_copy_lnl(kernel.log_likelihoods(s, x), tau, post))


def test_derivatives_and_counts():
    s, ps = scene()
    x = patterns()
    d = kernel.edge_derivatives(s, x)
    for k in range(len(s.edges)):
        up, down = s.lengths.copy(), s.lengths.copy()
        up[k] *= np.exp(1e-5)
        down[k] *= np.exp(-1e-5)
        num = (kernel.log_likelihoods(scene(lengths=up)[0], x) - kernel.log_likelihoods(scene(lengths=down)[0], x)) / 2e-5
        assert np.allclose(d[:, k], num, atol=1e-6)
    jumps = kernel.expected_events(s, x, [np.ones_like(p.rates) for p in ps])
    exits = kernel.dwell_fractions(s, x, [-np.diag(q) for q in s.q]) * s.lengths
    assert np.allclose(jumps - exits, d, atol=1e-8)  # both sides are the score of a length
    parts = kernel.expected_events(s, x, [p.copy_share() for p in ps]) + kernel.expected_events(s, x, [p.mutation_share() for p in ps])
    assert np.allclose(parts, jumps)
    assert np.allclose(kernel.dwell_fractions(s, x, [np.ones(16)] * 2), 1)


def test_relations_equal_matrices(spark):
    pi = spark.createDataFrame(list(zip("ACGT", PI.tolist())), "nt string, freq double")

    def dense(rows, a, b, v, n):
        m = np.zeros((n, n))
        for r in rows.collect():
            m[r[a], r[b]] += r[v]
        return m

    q = rates.hky(PI, 2.0)
    assert np.allclose(dense(rate_relations.hky(pi, 2.0), "x", "y", "q", 4), q)
    assert np.allclose(dense(rate_relations.two_paralogs(pi, 2.0, 1.3), "s", "t", "rate", 16), rates.joint(((1, 1), (2, 1)), q, {(1, 2): 1.3, (2, 1): 1.3}).rates)
    tau = {(0, 1): 0.5, (1, 0): 1.0, (0, 2): 1.5, (2, 0): 2.0, (1, 2): 2.5, (2, 1): 3.0}
    assert np.allclose(dense(rate_relations.three_paralogs(pi, 2.0, tau), "s", "t", "rate", 64), rates.joint(((0, 1), (1, 1), (2, 1)), q, tau).rates)
    assert np.allclose(dense(rate_relations.pair_site(pi, 2.0, 4, 0.3, 0.2), "s", "t", "rate", 256), rates.pair_site(q, q, 4, 0.3, 0.2).rates)
    m = rate_relations.mg94(pi, 2.0, 0.4)
    got = {(r["a"], r["b"]): r["q"] for r in m.collect()}
    want = rates.mg94(PI, 2.0, 0.4)
    assert len(got) == 526 and all(v == pytest.approx(want[CODON_STATE[a], CODON_STATE[b]]) for (a, b), v in got.items())
