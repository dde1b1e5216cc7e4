import random
import re

import numpy as np
import pytest
import xxhash

from helixframe.llm import simhash


def slow_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, threshold=2):
    of = list(range(len(fps)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                of[find(a)] = find(b)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return [least.get(find(k)) for k in range(len(fps))]


def test_against_brute_force(documents):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["aa", "Bb", "cé", "d\u00a0d", "e\x1ce"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts += [None, "", " \t\n", "One", "one", "x " * 20_000] + [" ".join(f"w{k}" if k != j else "X" for k in range(400)) for j in range(60)]
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(5, "one"), (5, "one"), (None, "one")]
    got = sorted(tuple(map(str, r)) for r in simhash.near_duplicates(documents(rows, "fp,component_id")).collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, _), f, c in zip(rows, fps, components(fps, [d for d, _ in rows])))
    assert got == want


@pytest.mark.parametrize("crowd", [1, 64])
def test_links_join_what_is_near(spark, crowd):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = {int(x) for x in base}
    for x in base[:12]:
        for _ in range(25):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                y ^= (1 << int(b)) if b < 63 else -(1 << 63)
            fps.add(y)
    fps = sorted(fps)
    pairs = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd=crowd).collect()
    mask = (1 << 64) - 1
    at = {f: k for k, f in enumerate(fps)}
    of = list(range(len(fps)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for r in pairs:
        assert ((r["a"] ^ r["b"]) & mask).bit_count() <= 2
        of[find(at[r["a"]])] = find(at[r["b"]])
    want = components([f & mask for f in fps], list(range(len(fps))))
    assert len({(find(k), w) for k, w in enumerate(want)}) == len({find(k) for k in range(len(fps))}) == len(set(want))


def test_keep_one(documents):
    rows = [(3, "a b c d"), (1, "A b c d"), (2, "other words here now"), (1, "A b c d"), (None, "lonely null id text"), (9, None), (8, "")]
    got = simhash.keep_one(documents(rows, "fp,h"))
    assert got.columns[-2:] == ["fp", "h"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", "A b c d"), ("2", "other words here now"), ("8", ""), ("None", "lonely null id text")]


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.keep_one(documents([])).count() == 0
