import random

import corpus_pipeline
from helixframe.llm import passages


def slow(rows, width=50):
    """doc_id, text by comparing every window of words."""
    seen, out = {}, []
    for d, t in sorted(rows):
        places = [m.span() for m in passages.WORD.finditer(t)]
        words = [t[a:b].lower() for a, b in places]
        gone = set()
        for k in range(len(words) - width + 1):
            f = seen.setdefault(tuple(words[k : k + width]), (d, k))
            if f != (d, k):
                gone.update(range(max(k, f[1] + width) if f[0] == d else k, k + width))
        cut = [False] * len(t)
        for k in gone:
            end = passages.TAIL.match(t, places[k][1]).end() if k + 1 not in gone else places[k + 1][0]
            cut[places[k][0] : end] = [True] * (end - places[k][0])
        out.append((d, "".join(c for c, g in zip(t, cut) if not g)))
    return out


def test_against_brute_force(documents):
    rng = random.Random(6)
    word = lambda: rng.choice(["éa", "be", "中文", "𝒳y", "Do", "e"]) + str(rng.randrange(30)) + rng.choice(["", "", ",", ". ", "!\n"])
    text = lambda n: [word() for _ in range(n)]
    passage, rows = [text(n) for n in (49, 50, 51, 90)], []
    for d in range(40):
        w = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            w += (p if rng.random() < 0.5 else p[rng.randint(0, 30) :]) + text(rng.randint(0, 9))
        rows.append((d, " ".join(w)))
    rows += [(50, "x " * 300), (51, "one two three " * 80), (52, "")]
    got = sorted((r["doc_id"], r["text"]) for r in passages.dedup(documents(rows, "spans,a,b")).collect())
    assert got == slow(rows)
    assert sum(a != b for a, b in zip(got, sorted(rows))) > 10


def test_stage_finds_a_passage_inside_sentences(spark, documents):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"Some words before {passage} and after it."), (2, f"Quite another beginning, {passage} with no end mark")]
    stage = dict(corpus_pipeline.STAGES)["substring dedup"]
    got = {r["doc_id"]: r["text"] for r in stage(spark, documents(rows), "").collect()}
    assert got == {1: rows[0][1], 2: "Quite another beginning, with no end mark"}
