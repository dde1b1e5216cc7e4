import random

from helixframe.operators import histories
from helixframe.operators.histories import configurations, search, searched, steps_of
from helixframe.sources.newick import parse, splice

STEPS = "tree int, step int, node string, parent string, kind string, at int"


def random_history(rng, k):
    """Duplications and losses put on the branches of a tree, with places that exist for some."""
    tree = parse("(((a,b)N2,c)N1,d)N0")
    number = iter(range(1, 9))
    spliced = []
    for branch in rng.sample(["N0_N1", "N1_N2", "N2_a", "N1_c", "N0_d"], rng.randint(1, 3)):
        spliced.append((branch, [f"{'D' if not spliced or rng.random() < 0.7 else 'L'}{next(number)}" for _ in range(rng.randint(1, 2))]))
    tree = splice(tree, spliced)
    return tree, {e: rng.choice([0, 0, 0, 1, 2]) for _, es in spliced for e in es}


def test_agrees_with_the_recursion(spark):
    rng = random.Random(11)
    rows, want, broken = [], {}, set()
    for k in range(60):
        tree, at = random_history(rng, k)
        rows += [(k, *r) for r in steps_of(tree, at)]
        try:
            want[k] = configurations(tree, at)
        except ValueError:
            broken.add(k)
    got = {}
    for r in search(spark.createDataFrame(rows, STEPS)).orderBy("tree", "node", "pos").collect():
        got.setdefault(r["tree"], {}).setdefault(r["node"], []).append((r["orlg"], r["alive"]))
    assert len(want) > 20 and broken and set(got) == set(want)
    for k, confs in want.items():
        assert {n: tuple(c) for n, c in got[k].items()} == confs


def test_no_histories(spark):
    assert search(spark.createDataFrame([], STEPS)).collect() == []


def test_equal_histories_are_searched_once(spark, monkeypatch):
    tree, at = parse("(((a,b)N2,c)N1,d)N0"), {"D1": 0, "D2": 1, "D3": 0}
    one, two = splice(tree, [("N0_N1", ["D1", "D2"]), ("N1_c", ["D3"])]), splice(tree, [("N0_d", ["D1"])])
    rows = spark.createDataFrame([(k, *r) for k in range(40) for r in (steps_of(two, {"D1": 0}) if k % 5 == 0 else steps_of(one, at))], STEPS)
    most = []
    plain = histories.cut
    monkeypatch.setattr(histories, "cut", lambda df: (out := plain(df), most.append(out.count() if "path" in out.columns else 0))[0])
    got = {(r["tree"], r["node"]): tuple(tuple(x) for x in r["conf"]) for r in searched(rows).collect()}
    assert max(most) <= 4  # rows of a step: two histories, with every way so far
    assert got == {(k, n): c for k in range(40) for n, c in (configurations(two, {"D1": 0}) if k % 5 == 0 else configurations(one, at)).items()}
