import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        if rng.random() < 0.4 or k == len(s):
            s.insert(k, rng.choice("abcé"))
        elif rng.random() < 0.5:
            del s[k]
        else:
            s[k] = rng.choice("abcé")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(120):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(edits + 1, 30)))
        b = edit(rng, a, rng.randint(0, edits + 2))
        if len(b) > edits:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select(lines.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert [r["w"] for r in got] == [distance(a, b) <= edits for a, b in pairs]


def expected(rows, edits=2, min_chars=10):
    all_ = [(d, k, s.strip(" ").lower()) for d, t in rows if t is not None for k, s in enumerate(t.split("\n"))]
    all_ = [x for x in all_ if len(x[2]) >= min_chars]
    names = sorted({x[2] for x in all_})
    of = {s: s for s in names}

    def find(s):
        while of[s] != s:
            s = of[s]
        return s

    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                of[find(a)] = find(b)
    classes = defaultdict(list)
    for d, k, s in all_:
        classes[find(s)].append((d, k))
    return {x: min(v) for v in classes.values() for x in v if x != min(v)}


def corpus():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(8, 60))) for _ in range(30)]
    rows = []
    for d in range(40):
        rows.append((d, "\n".join(edit(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 8)))))
    return rows + [(90, None), (91, ""), (92, "\n\n"), (93, "short"), (94, "short"), (95, ("very long line " * 3000))]


@pytest.mark.parametrize("hot", [0, 3, None])
def test_against_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(lines, "SAMPLE", 1)
    rows = corpus()
    got = {(r["doc_id"], x["line"]): (x["first_id"], x["first_line"]) for r in lines.removed(documents(rows), hot=hot).collect() for x in r["removed"]}
    assert got == expected(rows)


def test_dedup_keeps_rows_and_columns(documents):
    rows = corpus()
    gone = expected(rows)
    got = lines.dedup(documents(rows, "h1,k,norm"), out="cut")
    assert got.columns[-4:] == ["h1", "k", "norm", "cut"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {d: None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


def test_repeated_rows_and_null_ids(documents):
    rows = [(1, "one line of text here"), (1, "one line of text here"), (2, "One line of text herE!"), (None, "another line of text")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in lines.dedup(documents(rows)).collect())
    assert got == [("1", "one line of text here"), ("1", "one line of text here"), ("2", ""), ("None", "another line of text")]
    assert lines.dedup(documents([])).count() == 0


def test_columns_of_any_name(documents):
    rows = corpus()
    names = ["__id", "__h", "__gone", "__removed", "__ID", "h1"]
    names = [n for n in names if n != "__ID"]
    got = lines.dedup(documents(rows, ",".join(names)), out="__cut")
    assert got.columns[-6:] == [*names, "__cut"] and got.filter(" or ".join(f"{n} <> 'kept'" for n in names)).count() == 0
    assert got.filter("size(__cut) > 0").count() == len({d for d, _ in expected(rows)})


def test_common_line_and_common_segment(documents):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, middle = "all rights are reserved here", word(14)
    rows = []
    for d in range(240):
        own = [word(30) for _ in range(rng.randint(0, 2))] + [f"{word(13)}{middle}{word(13)}"]
        rows.append((d, "\n".join(own + [common] * (d % 3 == 0))))
    got = {(r["doc_id"], x["line"]): (x["first_id"], x["first_line"]) for r in lines.removed(documents(rows)).collect() for x in r["removed"]}
    assert got == expected(rows) and len(got) >= 79


@pytest.mark.parametrize("hot", [0, 1000])
def test_no_pair_of_a_hot_segment_is_lost(spark, hot):
    """Every two short strings of few letters within two edits meet, whichever segment they share."""
    rng = random.Random(11)
    texts = set()
    while len(texts) < 260:
        base = "".join(rng.choice("ab") for _ in range(rng.randint(10, 17)))
        texts |= {base, *(t for t in (edit(rng, base, rng.choice([1, 2, 2])) for _ in range(3)) if len(t) >= 10)}
    texts = sorted(texts)
    rows = spark.createDataFrame([(t,) for t in texts], "norm string")
    name = {r["h1"]: r["norm"] for r in rows.select("norm", lines._hashes(F.col("norm"))[0]).collect()}
    got = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in lines.candidates(rows, 2, lines.hot_segments(rows, 2, hot)).collect()}
    want = {(a, b) for i, b in enumerate(texts) for a in texts[:i] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert len(want) > 300 and want <= got
