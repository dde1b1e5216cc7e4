import random

from pyspark.sql import functions as F

from helixframe.sources import forest, newick


def made(rng, names, depth=0):
    """A random tree as text; names are used up."""
    if depth > 3 or rng.random() < 0.35 and depth:
        return names.pop()
    inside = f"{rng.choice(['', ' '])},".join(made(rng, names, depth + 1) + rng.choice(["", ":1.5", " : 2e-1"]) for _ in range(rng.randint(1, 4)))
    return f"({inside}){rng.choice(['', ' '])}{names.pop()}"


def test_many_trees_agree_with_the_parser(spark):
    rng = random.Random(2)
    texts = []
    for k in range(40):
        names = [f"{rng.choice(['N', 'D', 'L', 'tip '])}{i}" for i in range(200)]
        texts.append((k, made(rng, names) + rng.choice(["", ";", " ;\n"])))
    rows = spark.createDataFrame([*texts, (98, "alone;"), (99, None)], "tree int, text string")
    got = {}
    for r in forest.laid_out(forest.edges(rows), "tree").orderBy("tree", "edge_id").collect():
        got.setdefault(r["tree"], []).append(((r["parent"], r["child"]), r["length"], r["kind"]))
    assert len(got) == 40
    for k, text in texts:
        tree = newick.parse(text.strip().removesuffix(";"))
        assert [e for e, _, _ in got[k]] == tree.sorted_edges()
        assert {e: t for e, t, _ in got[k] if t is not None} == tree.lengths
        assert all(kind == newick.node_kind(e[1]) for e, _, kind in got[k])
    assert forest.violations(rows.filter("tree < 99")).collect() == []
    deep = forest.paths(forest.edges(rows), by=["tree"])
    want = {(k, n): "/".join(t.path(n)) for k, text in texts for t in [newick.parse(text.strip().removesuffix(";"))] for n in t.nodes if n != t.root}
    assert {(r["tree"], r["node"]): r["path"] for r in deep.collect()} == want
    assert deep.filter(F.size(F.split("path", "/")) != F.col("depth") + 1).count() == 0


def test_every_violation_is_reported(spark):
    bad = {1: "((a,b)X,c)Y", 2: "((a,b)X,c", 3: "(a,b))X;", 4: "((a,b),c)Y;", 5: "(a,,b)Y;", 6: "(a,a:x)Y;", 7: "a;b;", 8: "", 9: "(:1,b)Y:2;"}
    got = {}
    for r in forest.violations(spark.createDataFrame(list(bad.items()), "tree int, text string")).collect():
        got.setdefault(r["tree"], {})[r["problem"]] = r["n"]
    assert got == {2: {"brackets": 1, "roots": 1}, 3: {"brackets": 2, "roots": 1, "unnamed": 1}, 4: {"unnamed": 1}, 5: {"unnamed": 1}, 6: {"names": 1, "lengths": 1}, 7: {"roots": 1}, 8: {"empty": 1}, 9: {"unnamed": 1}}


def test_history_spliced(spark):
    tree = newick.parse("(((a,b)N2,c)N1,d)N0;")
    rows = spark.createDataFrame([(1, "(((a,b)N2,c)N1,d)N0;"), (2, "(a,b)N0;")], "tree int, text string")
    history = [("N0_N1", ["D1", "L1"]), ("Root_N0", ["D2"]), ("N2_b", ["D3"])]
    events = spark.createDataFrame([(1, *h) for h in history] + [(2, "N0_zz", ["D1"])], "tree int, branch string, events array<string>")
    e = forest.edges(rows)
    got = forest.splice(e, events, "tree")
    assert sorted((r["parent"], r["child"]) for r in got.filter("tree = 1").collect()) == newick.splice(tree, history).sorted_edges()
    assert sorted((r["parent"], r["child"]) for r in got.filter("tree = 2").collect()) == [("N0", "a"), ("N0", "b")]
    assert [(r["tree"], r["branch"]) for r in forest.unknown_branches(e, events, "tree").collect()] == [(2, "N0_zz")]
    inside = forest.below(forest.paths(got.filter("tree = 1")), F.lit("D1"))
    assert {r["node"] for r in inside.collect()} == newick.splice(tree, history).below("D1")


def test_a_long_chain_takes_few_rounds(spark):
    rows = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(300)], "parent string, child string")
    got = {r["node"]: r["depth"] for r in forest.paths(rows, "n0").collect()}
    assert got == {f"n{k}": k for k in range(1, 301)}


def test_texts_of_parts_in_any_order(spark):
    """A text may come out otherwise each time it is made, as one of a shuffled list does."""

    @F.udf("string")
    def text(k):
        inner = ["(a)N1", "(b,c)N2", "(d,e,f)N3"]
        random.SystemRandom().shuffle(inner)
        return f"({','.join(inner)})R;"

    rows = spark.range(50).select(F.col("id").alias("tree"), text.asNondeterministic()("id").alias("text"))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # a reused shuffle hides it where all blocks come in one order
    try:
        got = sorted((r["tree"], r["parent"], r["child"]) for r in forest.edges(rows).collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = ["N1a", "N2b", "N2c", "N3d", "N3e", "N3f", "RN1", "RN2", "RN3"]
    assert got == [(k, e[:-1] if e[0] == "N" else "R", e[-1] if e[0] == "N" else e[1:]) for k in range(50) for e in want]
