import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import fingerprints as fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def slow_sketch(text):
    """kept, least by an independent XXH64: of each word (seed 42), then chained over the words of a shingle."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    word = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(hs):
        seed = 42
        for h in hs:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return signed(seed)

    every = {chain(word[k : k + fp.SHINGLE]) for k in range(max(1, len(word) - fp.SHINGLE + 1))} if word else set()
    bound = int(-(2**63) + fp.FRACTION * 2**64)
    return sorted(h for h in every if h < bound), min(every, default=None)


def slow_text(kept, least):
    return " ".join(f"{h & (1 << 64) - 1:016x}" for h in kept) or ("" if least is None else f"~{least & (1 << 64) - 1:016x}")


def slow_likeness(a, b):
    if not a[0] or not b[0]:
        return float(a[1] == b[1])
    return len({*a[0]} & {*b[0]}) / len({*a[0]} | {*b[0]})


def words(rng, n):
    return " ".join(rng.choice(["river", "Stone", "ünder", "a", "bridge,"]) + str(rng.randrange(40)) for _ in range(n))


def by_hash(t):
    return signed(xxhash.xxh64_intdigest((t or "").encode(), 42))


def test_rows_against_brute_force(documents):
    rng = random.Random(4)
    rows = [(k * 3, words(rng, rng.choice([0, 1, 3, 6, 20, 150]))) for k in range(60)] + [(500, None), (501, ""), (502, "x" * 30_000), (503, "y " * 9000)]
    rows += [(600, rows[3][1]), (601, rows[3][1].upper())]
    got = {r["doc_id"]: r for r in fp.fingerprints(documents(rows, "sketch,block,tail,key")).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        own, changed, after = slow_sketch(t), slow_sketch(e), slow_sketch(n)
        assert got[d]["fingerprint"] == slow_text(*own) and got[d]["edited_fingerprint"] == slow_text(*changed)
        assert got[d]["near_edited"] == pytest.approx(slow_likeness(own, changed)) and got[d]["near_next"] == pytest.approx(slow_likeness(own, after))
    assert got[600]["fingerprint"] == got[9]["fingerprint"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ids=st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers(-50, 10**12)), max_size=40), block=st.integers(1, 9))
def test_next_over_blocks(documents, ids, block):
    rows = [(d, f"{d} {k}") for k, d in enumerate(ids)]
    got = fp.with_next(documents(rows), rows_per_block=block).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -by_hash(r[1])))
    assert sorted((r["text"], r["next_text"]) for r in got) == sorted((t, order[(k + 1) % len(order)][1]) for k, (_, t) in enumerate(order))


def test_rows_without_an_id_are_spread(documents):
    rows = [(None, f"text {k}") for k in range(300)] + [(7, f"other {k}") for k in range(300)] + [(8, "same")] * 5
    spark = documents([]).sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fp.with_next(documents(rows), rows_per_block=20)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 605 and max(sizes) < 400


def sketches(spark, rows):
    return spark.createDataFrame(rows, "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))


def test_likeness(spark):
    base = " ".join(f"w{k}" for k in range(4000))
    rows = [(base, base), (base, base.upper().replace(" ", "\n ")), (base, " ".join(f"w{k}" for k in range(2000))), (base, "other"), ("", ""), ("", "a"), ("a b", "a c"), (None, "")]
    got = sketches(spark, rows).select(fp.likeness(F.col("a"), F.col("b")).alias("l"), (F.size("a.kept") / 3996).alias("share")).collect()
    assert [got[k]["l"] for k in (0, 1, 3, 4, 5, 6, 7)] == [1, 1, 0, 1, 0, 0, 1]
    assert got[2]["l"] == pytest.approx(0.5, abs=0.07) and got[0]["share"] == pytest.approx(fp.FRACTION, abs=0.03)


def test_containment_of_texts_of_any_length(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    cuts = [(n, at) for n in (1, 4, 5, 6, 8, 12, 24, 400, 3999) for at in (rng.randrange(4000 - n) for _ in range(15))]
    rows = [(" ".join(base[at : at + n]), " ".join(base)) for n, at in cuts if n >= 5]
    rows += [("other " * 3 + " ".join(f"x{k}" for k in range(200)), " ".join(base)), ("", " ".join(base))]
    got = [r["c"] for r in sketches(spark, rows).select(fp.containment(F.col("a"), F.col("b")).alias("c")).collect()]
    assert {c for c in got[:-2]} <= {1.0, None} and got[-2] == 0 and got[-1] == 1
    assert all(c == 1 for (n, _), c in zip([c for c in cuts if c[0] >= 5], got) if n >= 400)


def test_merge_is_the_sketch_of_the_union(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(n)) for c in "ab" for n in (1, 5, 6, 8, 40, 300)] + [""]
    rows = [(a, b) for a in texts for b in texts]
    got = sketches(spark, rows).select(fp.merge(F.col("a"), F.col("b")).alias("m")).collect()
    for (a, b), r in zip(rows, got):
        x, y = slow_sketch(a), slow_sketch(b)
        assert r["m"]["kept"] == sorted({*x[0], *y[0]}) and r["m"]["least"] == min((v for v in (x[1], y[1]) if v is not None), default=None)


def test_empty(documents):
    assert fp.fingerprints(documents([])).count() == 0
    one = fp.fingerprints(documents([(7, "a b c d e f")])).first()
    assert one["near_next"] == 1
