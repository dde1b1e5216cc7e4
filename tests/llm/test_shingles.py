import random

import corpus_pipeline
import pytest
from helixframe.llm import shingles, simhash


def grams(t):
    w = t.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """One id of each component, by brute force."""
    sets, of = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                of[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), d), d)
    return sorted(least.values())


def corpus():
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, rows = text(40), []
    for _ in range(12):
        base = text(rng.choice([6, 9, 25, 120, 300]))
        rows.append(base)
        for _ in range(6):  # near copies with edits up to and beyond the bound, some of them of each other only
            copy = list(rng.choice(rows[-3:]))
            for _ in range(rng.randint(1, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(99)
            rows.append(copy)
    rows += [text(rng.randint(5, 60)) + passage for _ in range(30)] + [[], []]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("frequent", [5, 1000])
def test_against_brute_force(documents, monkeypatch, frequent):
    monkeypatch.setattr(shingles, "FREQUENT", frequent)
    rows = corpus()
    want = kept(rows)
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents(rows, "fp,n,p,__id,__h,__nth"), shingle=5, similarity=0.8).collect()) == want
    assert 40 < len(want) < len(rows) - 20


def test_stage_drops_a_near_copy(spark, documents):
    words = [f"w{k}" for k in range(200)]
    near = words[:50] + ["other"] + words[51:120] + ["another"] + words[121:]  # 10 shingles of 196 differ: 186 / 206
    far = [w if k % 20 else "far" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    assert kept(rows) == [1, 3]
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, documents(rows), "").collect()) == [1, 3]
