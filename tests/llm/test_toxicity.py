import random

import numpy as np
import pytest

from helixframe.llm import toxicity
from helixframe.llm.words import ngrams


def corpus(n=240):
    rng = random.Random(6)
    clean = ["the", "quiet", "river", "under", "stone", "bridge", "turns", "slowly", "idle", "storm", "stupor", "lot"]
    rows, labels = [], []
    for d in range(n):
        ws = [rng.choice(clean) for _ in range(rng.randint(5, 40))]
        bad = rng.random() < 0.25
        if bad:
            ws += [rng.choice(["idiot", "stupid", "loser"]) for _ in range(3)]
            rng.shuffle(ws)
        rows.append((d, " ".join(ws)))
        labels.append((d, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    return toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"), toxicity.count_letters(docs))


def test_restores_disguised_words(model):
    r = toxicity.Reader(model.letters, model.dims)
    for s, w in (("1d10t", "idiot"), ("l0ser!", "loser"), ("$tupid", "stupid"), ("i.d.i.o.t", "idiot"), ("looooser", "loser"), ("s-t-u-p-i-d", "stupid"), ("river.", "river")):
        assert w in r.restored(s), s
    assert "stupid" in r.restored("stuupid") and "stuupid" in r.restored("stuupid") and "idiot" in r.restored("1d107")
    assert r.restored("%&~") == () and r.restored("455") and r.restored("$#!+")
    assert "idiot" in toxicity.restore("idiot", model.letters, apart=True)


def test_long_tokens_and_marks_alone(documents, model):
    r = toxicity.Reader(model.letters, model.dims)
    assert "idiot" in r.restored(",".join(["river", "stone", "bridge"] * 5 + ["idiot"]))
    assert "loser" in r.restored("l" + "o" * 100 + "ser")
    assert "stupid" in r.restored("quiet/river-under." * 5 + "$tup1d")
    assert r.restored("@$$")
    assert len(r.restored("a1b2" * 5000)[0]) >= 10_000
    bad = ",".join(["the", "quiet", "river"] * 6 + ["stupid", "idiot", "loser"])
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(documents([(1, bad), (2, ",".join(["the", "quiet", "river"] * 8))]), model).collect()}
    assert got == {1: 1, 2: 0}


def test_ngrams_are_those_of_each_word():
    words = ["a", "ab", "river", "rivers", "river", "é"]
    n, at = ngrams(words, (4, 5), 1 << 18)
    of = [set(at[n == k].tolist()) for k in range(len(words))]
    assert [len(f) for f in of] == [1, 1, 7, 9, 7, 1] and of[2] == of[4] and len(of[2] & of[3]) == 5 and of[0] != of[5]


def test_accuracy_and_disguises(documents, model):
    rows, labels = corpus(300)
    got = {r["doc_id"]: r for r in toxicity.score(documents(rows), model).collect()}
    assert sum(got[d]["predicted"] == y for d, y in labels) >= 0.98 * len(labels)
    tests = [(1, "you 1d10t and l0ser"), (2, "the quiet river"), (3, "so s t u p i d , l o s e r"), (4, None), (5, ""), (6, "river " * 50_000), (2, "the quiet river"), (None, "stupid idiot loser")]
    got = sorted((str(r["doc_id"]), r["predicted"]) for r in toxicity.score(documents(tests, "score,f"), model).collect())
    assert got == [("1", 1), ("2", 0), ("2", 0), ("3", 1), ("4", 0), ("5", 0), ("6", 0), ("None", 1)]


def test_without_labels(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    letters = toxicity.count_letters(docs)
    for rows in ([], [(1, 1)], [(1, 0), (9, 1)]):
        m = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), letters)
        assert not m.weights and toxicity.score(docs, m).count() == 2
    assert toxicity.score(documents([]), m).count() == 0
    assert len(toxicity.count_letters(documents([])).keys) == 0


def paths(token, apart):
    """Every path through the lattice: text, and its cost by the language model taken letter by letter."""
    out = [("", 0.0)]
    for options, may_end in toxicity.lattice(token, apart):
        out = [(t + gap + s, v + cost + (toxicity.SPLIT if gap else 0.0)) for t, v in out for gap in (["", " "] if may_end and t and not t.endswith(" ") else [""]) for s, cost in options]
    return out


def cost(letters, text):
    v = 0.0
    for w in text.split(" "):
        a, b = toxicity.START, toxicity.START
        for c in w:
            v += -2.5 if b == toxicity.START else letters.log(a, b, c)
            a, b = b, c
        v += -20.0 if b == toxicity.START else letters.log(a, b, toxicity.STOP)
    return v


def test_best_path_by_enumeration(model):
    rng = random.Random(2)
    tokens = ["1d10t", "$tu**d", "l0.s3r", "iddiioot", "@$$", "455", "s+upp1d", "a1!i", "##"] + ["".join(rng.choice("ids1!0o*.t") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for token in tokens:
        for apart in (False, True):
            every = [(v + cost(model.letters, t), t) for t, v in paths(token, apart)]
            top = max(v for v, _ in every)
            best = {tuple(t.split()) for v, t in every if v >= top - 1e-9}
            assert tuple(toxicity.restore(token, model.letters, apart)) in best, (token, apart)


def test_letters_are_counted_one_by_one(documents, monkeypatch):
    rows = [(1, "ab abc, AB"), (2, None), (3, "ab 12 a1b"), (4, "éa")]
    want = {}
    for w in ["ab", "abc", "ab", "ab", "éa"]:
        m = toxicity.START + w + toxicity.STOP
        for k in range(len(m) - 2):
            want[m[k : k + 3]] = want.get(m[k : k + 3], 0) + 1
    got = toxicity.count_letters(documents(rows))
    chars = lambda k: "".join(chr(k >> s & (1 << toxicity.BITS) - 1) for s in (42, 21, 0))
    assert {chars(int(k)): int(n) for k, n in zip(got.keys, got.counts)} == want and not got.folded
    folded = toxicity.count_letters(documents(rows), most=2)
    assert folded.folded and all(folded.log(*t) == pytest.approx(got.log(*t)) for t in want)


def test_runs_set_apart_are_read_whole(documents, model):
    text = " ".join("the quiet river under the stone bridge ".replace(" ", "") * 20) + " " + " ".join("stupididiotloser")
    got = toxicity.score(documents([(1, text)]), model).first()
    assert got["predicted"] == 1


def test_newton_against_gradient():
    rng = np.random.default_rng(0)
    x = (rng.random((60, 9)) < 0.3) * rng.random((60, 9))
    t = (x @ rng.normal(size=9) + rng.normal(size=60) > 0).astype(float)
    r, c = np.nonzero(x)
    w, b = toxicity.newton(r, c, x[r, c], t, 9)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(x.T @ (t - p) - 2.0 * w, 0, atol=1e-5) and abs((t - p).sum()) < 1e-5


def test_doubled_letters_as_the_lattice_reads_them(model):
    rng = random.Random(12)
    words = ["".join(rng.choice("idostupler") for _ in range(rng.randint(2, 10))) for _ in range(600)]
    words = [w for w in words if toxicity.REPEATED.search(w)] + ["ii", "iidd", "iiddss", "stuupidd", "oo" + "lo" * 4 + "ss"]
    for w in words:
        a, b = (r[0] for r in (toxicity.restore(w, model.letters), toxicity.undoubled(w, model.letters)))
        assert a == b or cost(model.letters, a) + toxicity.JOINED * (len(w) - len(a)) == pytest.approx(cost(model.letters, b) + toxicity.JOINED * (len(w) - len(b))), w
