import random

import corpus_pipeline
import numpy as np
from helixframe.llm import langid, packing, queries

from . import test_lines, test_passages, test_shingles, test_substrings


def table(documents):
    rng = random.Random(2)
    words = ["the", "and", "river", "stone", "under", "bridge", "slow", "light"] + [f"{a}{b}" for a in "bcdfgh" for b in ("ar", "el", "ing", "ot")]
    line = lambda n=12: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(k, "\n".join(line() for _ in range(6)), "en") for k in range(30)]
    passage = " ".join(f"{rng.choice(words)}" for _ in range(60)) + "."
    rows[3] = (3, rows[3][1] + " Then. " + passage, "en")
    rows[9] = (9, rows[9][1] + " Also. " + passage, "en")
    copy = [(40, rows[5][1], "en"), (41, rows[6][1] + " " + line(4), "en")]
    return documents(rows + copy + [(50, None, "en"), (51, "123 456", "en"), (52, "", None)], "spans,removed,fp"), rows


def test_stages(spark, documents, tmp_path):
    docs, rows = table(documents)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    ids = {n: {r["doc_id"] for r in d.collect()} for n, d in seen.items()}
    assert ids["language ID"] == {r[0] for r in rows} | {40, 41}
    assert 40 not in ids["line dedup"] and {r[0] for r in rows} <= ids["line dedup"]
    assert {r[0] for r in rows} <= ids["SimHash near-dedup"]
    left = {r["doc_id"]: r["text"] for r in seen["substring dedup"].collect()}
    assert left[9].rstrip().endswith("Also.") and not left[3].endswith("Then. ")
    for k, t, _ in rows:
        if k not in (3, 9):
            assert left[k] == t
    assert ids["best-fit packing"] == set(left)


def test_empty(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def blank(t):
    return not (t or "").strip()


def by_hand(rows, model):
    """ids and texts after each of the first four stages, by brute force."""
    out = []
    kept = []
    for d, t in rows:
        words = [w for w in langid.WORD.findall(t or "") if any(c.isalpha() for c in w)]
        if words:
            path = model._viterbi(model.word_scores(words).astype(float))
            if np.bincount(path).max() >= 0.5 * len(words):
                kept.append((d, t))
    out.append(kept)
    gone = test_lines.expected(kept)
    cut = [(d, t, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in kept]
    out.append([(d, new) for d, old, new in cut if old == new or not blank(new)])
    ids = set(test_shingles.kept(out[-1]))
    out.append([(d, t) for d, t in out[-1] if d in ids])
    first = dict(test_passages.slow(out[-1]))
    second = {d: t for d, t, _ in test_substrings.slow(sorted(first.items()))}
    out.append([(d, second[d]) for d, t in out[-1] if second[d] == t or not blank(second[d])])
    return out


def test_stages_against_brute_force(spark, documents):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("ar", "el", "ing", "ot", "und", "ish")]
    line = lambda n=None: " ".join(rng.choice(words) for _ in range(n or rng.randint(3, 14))) + rng.choice([".", "!", ""])
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    common = line(6)
    rows = []
    for d in range(70):
        t = [line() for _ in range(rng.randint(1, 7))]
        if d % 3 == 0:
            t.insert(0, common)
        if d % 5 == 0:
            t.append("So " + rng.choice(passages) + " " + line(4))
        rows.append((d, "\n".join(t)))
    for d in range(70, 95):  # copies: whole, in one line with some words changed, with a line edited
        t = rows[rng.randrange(60)][1].replace("\n", " ").split(" ")
        for _ in range(rng.randint(0, 1 + len(t) // 25)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((d, " ".join(t)))
    rows += [(95, None), (96, ""), (97, "12 34"), (98, rows[4][1]), (99, rows[5][1][:-2] + "x.")]
    docs = documents(rows, "__id,__h,__lines,__spans,node")
    want = by_hand(rows, langid.fit(docs))
    for (name, stage), texts in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, "")
        assert docs.columns[-5:] == ["__id", "__h", "__lines", "__spans", "node"]
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(texts), name
    assert [len(w) for w in want] == sorted((len(w) for w in want), reverse=True) and len(want[2]) < len(want[1]) < len(rows)
    ids = packing.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"]: r["start"] + r["length"] for r in sorted(got, key=lambda r: r["piece"])} == {d: len(ids(t)) + 1 for d, t in want[-1]}
