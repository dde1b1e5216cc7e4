from itertools import product

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import states
from helixframe.operators import rates

CONFS = [[(0, 1), (0, 1), (1, 1), (2, 0)], [(0, 1), (0, 1), (0, 1), (1, 0)], [(0, 1), (0, 0), (1, 1), (1, 1)], [(3, 1), (1, 1), (2, 1), (0, 1)], [(0, 0), (0, 0), (0, 0), (0, 0)]]
CONF = "array<struct<orlg:int,alive:int>>"


def test_changes_equal_those_by_hand(spark):
    rng = np.random.default_rng(2)
    every = [list(s) for s in product(range(3), repeat=4)]
    pairs = [(every[i], every[j]) for i, j in rng.integers(0, len(every), (250, 2))]
    for s in every[:40]:  # near ones, which single changes and copies lead to
        pairs += [(s, [*s[:k], (s[k] + 1) % 3, *s[k + 1 :]]) for k in range(4)] + [(s, s[2:] + s[2:]), (s, s[:2] + s[:2]), (s, s)]
    pairs += [(s + s, t + t) for s, t in product([[0, 1], [1, 1], [2, 0]], repeat=2)]
    rows = [(c, a, b) for c in CONFS for a, b in pairs]
    c, a, b = F.col("c"), F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, f"c {CONF}, a array<int>, b array<int>").select("c", "a", "b", states.is_configuration(c), states.is_state(a, c), states.is_state_of(a, c, 2), states.is_change_of(a, b, c), states.is_pair_change(a, b), states.is_single_change(a, b)).collect()
    assert len(got) == len(rows)
    seen = [set() for _ in range(6)]
    for r in got:
        conf, x, y = [tuple(p) for p in r["c"]], np.array(r["a"]), np.array(r["b"])
        want = [rates.is_configuration(conf), rates.is_state(x, conf), rates.is_state_of(x, conf, 2), rates.is_transition_of(x, y, conf), rates.is_pair_transition(x, y), rates.is_single_transition(x, y)]
        assert list(r[3:]) == list(map(bool, want)), r
        for k, v in enumerate(want):
            seen[k].add(bool(v))
    assert all(s == {True, False} for s in seen)


def test_places_of_groups(spark):
    rows = [(k, c) for k, c in enumerate(CONFS)] + [(9, [])]
    c = F.col("c")
    for r in spark.createDataFrame(rows, f"k int, c {CONF}").select("c", states.extent(c).alias("extent"), states.lost(c).alias("lost")).collect():
        parts = rates.divide([tuple(p) for p in r["c"]])
        assert {k: list(v) for k, v in r["extent"].items()} == {k: list(v) for k, v in parts["extent"].items()}
        assert r["lost"] == [k for k, p in enumerate(r["c"]) if p[1] == 0]


def test_nulls_and_lengths_are_no_states(spark):
    rows = [(None, None, None), ([(0, None)], [1], [2]), ([(0, 1)], [None], [1]), ([(0, 1), (0, 1)], [1], [2]), ([], [], []), ([(None, 1)], [7], [-1])]
    c, a, b = F.col("c"), F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, f"c {CONF}, a array<int>, b array<int>")
    got = df.select(states.is_state_of(a, c), states.is_change_of(a, b, c), states.is_pair_change(a, b), states.is_single_change(a, b)).collect()
    assert [list(r) for r in got] == [[False] * 4, [True, False, False, False], [False] * 4, [False] * 4, [True, False, False, False], [False] * 4]
    assert [r[0] for r in df.select(states.is_configuration(c)).collect()] == [False, False, True, True, False, False]
