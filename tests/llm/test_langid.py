import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import langid

SOUNDS = {"en": ["the", "ing", "and", "wh", "er"], "de": ["sch", "ung", "ich", "ß", "pf"], "ru": ["про", "ска", "ить", "ов"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=120):
    rng = random.Random(4)
    return [(k, text(rng, lang, rng.randint(5, 60)), lang) for k in range(n) for lang in [rng.choice(list(SOUNDS))]]


def test_held_out_accuracy_and_spans(documents):
    rows = corpus()
    docs = documents(rows)
    out = langid.held_out()
    model = langid.fit(docs.filter(~out))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {r["doc_id"] for r in docs.filter(out).collect()} == {k for k, _ in held}
    assert sum(got[k]["lang_pred"] == lang for k, lang in held) >= 0.95 * len(held)
    rng = random.Random(8)
    a, b = text(rng, "en", 40), text(rng, "ru", 30)
    mixed = langid.identify(documents([(1, a + ". " + b)]), model).first()
    assert mixed["lang_pred"] == "en" and [s["lang"] for s in mixed["spans"]] == ["en", "ru"]
    assert (a + ". " + b)[mixed["spans"][1]["start"] :] == b


def test_certificate_agrees_with_viterbi(documents):
    model = langid.fit(documents(corpus()))
    rng = random.Random(9)
    docs = [sum((text(rng, rng.choice(list(SOUNDS)), rng.randint(1, 12)).split() for _ in range(rng.randint(0, 6))), []) for _ in range(80)]
    for words, path in zip(docs, model.label(docs)):
        if not words:
            continue
        e = model.scores[model.rows_of(words)].astype(float)
        worth = lambda p: e[np.arange(len(p)), p].sum() - model.switch * (np.diff(p) != 0).sum()  # noqa: E731, B023
        assert abs(worth(path) - worth(model._viterbi(e))) < 1e-6


def test_undetermined_and_edges(documents):
    model = langid.fit(documents(corpus()))
    rows = [(1, None, None), (2, "", "en"), (3, "123 !? ²", None), (4, "the " * 40_000, None), (4, "the " * 40_000, None), (None, "und", None), (6, "λόγος", None)]
    got = langid.identify(documents(rows, "lang_pred,spans"), model).collect()
    pred = sorted((str(r["doc_id"]), r["lang_pred"], r["score"] > 0) for r in got)
    assert pred[:5] == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "en", True), ("4", "en", True)]
    assert langid.identify(documents([]), model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(documents(corpus()), max_langs=2)
    blank = langid.fit(documents([(1, "x", None), (2, None, "en")]).withColumn("lang", F.lit(None).cast("string")))
    assert langid.identify(documents([(1, "some words")]), blank).first()["lang_pred"] == "und"


def test_keep_passes_rows_through(documents):
    docs = documents([(1, "the and ing", "en"), (2, None, "en"), (3, "12", "en"), (4, "schung ichpf", "de")], "lang_pred")
    kept = langid.keep(docs, langid.fit(documents(corpus())))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_two_stretches_with_one_switch():
    """The main language of a text need not be in its best path."""
    m = langid.Model(["a", "b", "c"], np.zeros((8, 3), np.float32), np.zeros((0, 3), bool))
    m.switch = 12.0
    m.scores = np.array([[-1.8, -0.2, -4.2], [-1.8, -4.2, -0.2]], np.float32)
    m.rows_of = lambda words: np.array([int(w) for w in words])
    words = ["0"] * 7 + ["1"] * 7
    assert m.label([words, ["0"] * 3, [], words[::-1]])[0].tolist() == [1] * 7 + [2] * 7
    rng = random.Random(3)
    docs = [[str(rng.randrange(2)) for _ in range(rng.randint(1, 3)) for _ in range(1)] * rng.randint(1, 12) + ["0"] * rng.randint(0, 9) for _ in range(50)]
    for words, path in zip(docs, m.label(docs)):
        e = m.scores[m.rows_of(words)].astype(float)
        worth = lambda p: e[np.arange(len(p)), p].sum() - m.switch * (np.diff(p) != 0).sum()  # noqa: E731, B023
        assert abs(worth(path) - worth(m._viterbi(e))) < 1e-6


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(5)
    m = langid.Model(["a", "b", "c"], np.zeros((8, 3), np.float32), np.zeros((0, 3), bool))
    for switch in (0.5, 2.0, 12.0):
        m.switch = switch
        for _ in range(40):
            n = int(rng.integers(1, 8))
            e = np.maximum(np.log(rng.dirichlet([0.3] * 3, n)), langid.FLOOR)
            e[rng.random((n, 3)) < 0.1] = langid.BARRED
            m.scores, m.rows_of = e.astype(np.float32), lambda words: np.array([int(w) for w in words])
            e = m.scores.astype(float)
            worth = lambda p: e[np.arange(n), p].sum() - switch * (np.diff(p) != 0).sum()  # noqa: E731, B023
            best = max(worth(np.array(p)) for p in product(range(3), repeat=n))
            for path in (m._viterbi(e), m.label([[str(k) for k in range(n)]])[0]):
                assert abs(worth(path) - best) < 1e-6


def test_scripts_narrow_the_candidates(documents):
    rng = random.Random(2)
    model = langid.fit(documents(corpus()))
    t = text(rng, "en", 12) + " проскаить " + text(rng, "de", 12)
    spans = langid.identify(documents([(1, t)]), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "ru", "de"] and t[spans[1]["start"] : spans[1]["end"]] == "проскаить"
    got = langid.identify(documents([(1, "λόγος"), (2, text(rng, "de", 9) + " λόγος " + text(rng, "de", 9))]), model).orderBy("doc_id").collect()
    assert got[0]["lang_pred"] in model.langs and [s["lang"] for s in got[1]["spans"]] == ["de"]
