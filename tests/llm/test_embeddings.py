import numpy as np
import pytest

from helixframe.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, own string"


def expected(rows, threshold=0.93):
    x = []
    for i, v, l in rows:
        good = v is not None and len(v) > 0 and l is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(c != 0 for c in v)
        x.append(np.array(v, dtype=np.float32).astype(float) if good else None)
    n = len(rows)
    linked = [[] for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= threshold:
                    linked[a].append(b)
    comp, seen = [None] * n, set()
    for a in range(n):
        if a in seen:
            continue
        todo, found = [a], {a}
        while todo:
            for c in linked[todo.pop()]:
                if c not in found:
                    found.add(c)
                    todo.append(c)
        seen |= found
        ids = [rows[k][0] for k in found if rows[k][0] is not None]
        for k in found:
            comp[k] = min(ids) if ids else None
    return sorted((str(r[0]), len(linked[k]), str(comp[k]), r[0] is not None and r[0] == comp[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("leaders", [0, 3, 4096])
def test_against_brute_force(spark, leaders):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(5):
            c = rng.normal(size=20)
            for _ in range(8):
                rows.append((len(rows), (c + rng.normal(size=20) * rng.choice([0.05, 0.2, 0.35])).tolist(), label))
    base = rows[0][1]
    rows += [(900, base, 0), (900, base, 0), (None, base, 0), (901, [2 * c for c in base], 0), (902, None, 0), (903, [], 0), (904, [0.0] * 20, 0), (905, [float("nan")] + base[1:], 0), (906, [float("inf")] + base[1:], 0), (907, [None] + base[1:], 0), (908, [1.0, 1.0], 0), (909, [1.0, 1.0], 0), (None, None, 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embeddings.near_duplicates(df, max_leaders=leaders).collect())
    assert got == expected(rows)


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
