import random

import pytest

from helixframe.llm.common import connected_components


def expected(edges):
    of = {}

    def find(x):
        of.setdefault(x, x)
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            of[max(x, y)] = min(x, y)
    return {x: find(x) for x in of}


@pytest.mark.parametrize("kind", ["path", "star", "random", "strings", "empty"])
def test_against_union_find(spark, kind):
    rng = random.Random(5)
    nodes = list(range(60))
    rng.shuffle(nodes)
    edges = {
        "path": list(zip(nodes, nodes[1:])),
        "star": [(nodes[7], n) for n in nodes],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(None, 3), (4, 4), (1, 2), (1, 2)],
        "strings": [(f"{a:02}", f"{b:02}") for a, b in zip(nodes, nodes[1:]) if a % 5],
        "empty": [],
    }[kind]
    t = "string" if kind == "strings" else "long"
    got = connected_components(spark.createDataFrame(edges, f"a {t}, b {t}")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == expected(edges)


def test_too_few_rounds_are_an_error(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long"), max_rounds=1)
