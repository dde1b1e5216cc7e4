import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from helixframe.llm import collocations

LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def slow(rows, max_n=4, least=30, covered=80, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, f_ in f.items():
        found = {p: a for p, a in f_.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in found.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(inside(q) and 100 * b >= covered * a for q, b in found.items()):
                continue
            score, _, l, r = min((2000000 * a // (f_[p[:k]] + f_[p[k:]]), k, f_[p[:k]], f_[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, l, r))
        for rank, (s, _, p, a, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed=1, docs=60):
    """Words that share beginnings, hold bytes below the blank, or are long; pieces and blanks of all kinds."""
    rng = random.Random(seed)
    words = ["a", "A", "a\x01", "a\x00", "ab", "É", "é", "zz\x08b", "the", "x" * 90 + "a", "x" * 90 + "b", "🙂"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " "]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(ends) for _ in range(rng.randint(0, 120)))
        rows.append((text, rng.choice(["en", "en", "de", None, "", "e\x00", "e\x01"])))
    return rows + [(None, "en"), ("", "fr"), ("...", "fr"), rows[0], rows[0], ("the end " * 4000, "en")]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(t, k, 1, "x") for t, k in rows], "text string, lang string, n int, phrase string")


@pytest.mark.parametrize("chunk", [1, 700, 12_000_000])
@pytest.mark.parametrize("max_n,least,covered,top", [(4, 5, 80, 2000), (4, 30, 80, 7), (3, 2, 50, 2000), (2, 8, 80, 40), (5, 6, 95, 2000)])
def test_against_brute_force(table, chunk, max_n, least, covered, top):
    rows = corpus()
    got = collocations.collocations(table(rows).repartition(5), max_n=max_n, least=least, covered=covered, top=top, chunk=chunk)
    assert got.columns == COLUMNS
    want = slow(rows, max_n, least, covered, top)
    assert len(want) > 4 and sorted(map(tuple, got.collect())) == want


def test_oracle(spark, table):
    rows = [(t, k) for t, k in corpus(2) if "\x00" not in (t or "") + (k or "")]  # the nul is not told in strings of a table made here
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(pd.DataFrame(rows, columns=["text", "lang"])))
    for kw in ({}, {"least": 3, "top": 15}):
        assert sorted(con.execute(collocations.oracle(**kw)).fetchall()) == sorted(map(tuple, collocations.collocations(table(rows), **kw).collect()))


def test_empty(table):
    assert collocations.collocations(table([])).collect() == []
    assert collocations.collocations(table([(None, None), ("a b", "en")])).collect() == []


def test_products_past_64_bits(spark, monkeypatch):
    """Counts as large as they can get, in place of those of a text."""
    big = 4 * 10**18
    counts = [("en", 0, "", 2 * big), ("en", 1, "a", big), ("en", 1, "b", big), ("en", 1, "c", big - 1), ("en", 2, "a b", big - 3), ("en", 2, "b c", big // 2), ("en", 3, "a b c", big // 2)]
    monkeypatch.setattr(collocations, "frequent", lambda *a, **k: spark.createDataFrame(counts, "lang string, k int, phrase string, f long"))
    got = collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    score = lambda a, l, r: 2000000 * a // (l + r)
    assert [(r["phrase"], r["score"]) for r in got] == [("a b", score(big - 3, big, big)), ("a b c", min(score(big // 2, big, big // 2), score(big // 2, big - 3, big - 1)))]


def test_straddling_prefixes():
    """Any division of the sorted keys into tasks and batches gives the same sums."""
    rng = random.Random(5)
    keys = sorted({b"en\0" + b"".join(rng.choice([b"a", b"b", b"c"]) + b"\0" for _ in range(rng.randint(1, 4))) for _ in range(80)}, reverse=True)
    counts = [rng.randint(1, 9) for _ in keys]
    want = Counter()
    for key, n in zip(keys, counts):
        words = key.split(b"\0")[:-1]
        for k in range(1, len(words) + 1):
            want[b" ".join(words[1:k]), k - 1] += n
    for _ in range(50):
        got = Counter()
        cuts = sorted(rng.sample(range(len(keys) + 1), rng.randint(0, 9)))
        for a, z in zip([0, *cuts], [*cuts, len(keys)]):
            p = collocations.Prefixes(4, 1)
            while a < z:
                step = rng.randint(1, z - a)
                p.add(pa.array(keys[a : a + step], pa.binary()), __import__("numpy").array(counts[a : a + step]))
                a += step
            p.end()
            for r in p.take().to_pylist():
                got[r["phrase"], r["k"]] += r["f"]
        assert got == want


def test_a_chunk_takes_little_memory():
    rng = random.Random(1)
    words = ["".join(rng.choices("etaonirsh", k=rng.randint(2, 8))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=collocations.CHUNK // 600)).encode() for _ in range(100)]
    tracemalloc.start()
    try:
        n = sum(int(counts.sum()) for _, counts in collocations._suffixes(b"en", texts, 4))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(len(t.split()) for t in texts) and peak < 120e6
