"""Lengths of edges by expectation and maximisation (Dempster, Laird and Rubin, 1977), as relations.

A round is one exponential, messages up and down the tree and two sums: an edge's expected jumps over the rate of jumps that it is
expected to have for each unit of length. Nothing but the edges and two numbers of a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.lineage import local, release
from . import likelihood

EDGES = "parent string, child string, process int, parameter string, share double, length double"
#: Least length that a round gives.
LEAST = 1e-12


def step(tree: likelihood.Pruned, edges: DataFrame, inner: DataFrame, weights: DataFrame) -> DataFrame:
    """parent, child, process, parameter, share, length of edges after one round, from messages and ``inner`` (see ``expected_each``).

    An edge's length is its share of a parameter's value. Edges of one parameter are summed; an edge that the model never leaves
    keeps its length, and so does each whose parameter is null.
    """
    each = likelihood.expected_each(tree, likelihood.outside(tree), inner, "jumps", "exits")
    sums = each.join(weights.select("pattern", "n"), "pattern").groupBy("child").agg(F.sum(F.col("n") * F.col("jumps")).alias("jumps"), F.sum(F.col("n") * F.col("exits")).alias("exits"))
    edges = edges.join(F.broadcast(sums), "child", "left").withColumn("most", F.col("exits") / F.nullif(F.col("length"), F.lit(0.0)) * F.col("share"))
    by = edges.filter("parameter is not null").groupBy("parameter").agg(F.sum("jumps").alias("all_jumps"), F.sum("most").alias("all_most"))
    better = F.greatest(F.col("all_jumps") / F.col("all_most"), F.lit(LEAST)) * F.col("share")
    got = edges.join(F.broadcast(by), "parameter", "left").withColumn("length", F.when(F.col("all_most") > 0, better).otherwise(F.col("length")))
    return got.select("parent", "child", "process", "parameter", "share", "length").coalesce(1)


def _held(edges: DataFrame) -> list[Row]:
    """The edges of a tree as rows, whose number is bounded: as relations of a few rows they carry no plan from round to round."""
    rows = edges.select("parent", "child", "process", "parameter", "share", "length").limit(likelihood.MOST_EDGES + 1).collect()
    if len(rows) > likelihood.MOST_EDGES:
        raise ValueError(f"a tree of more than {likelihood.MOST_EDGES} edges")
    return rows


def fit(data: DataFrame, weights: DataFrame, edges: DataFrame, rates: DataFrame, prior: DataFrame, *, rounds: int = 20, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Edges with better lengths, and round, lnl (before it), change (the largest of a length) of every round.

    ``data``, ``rates`` and ``prior`` are as in ``likelihood``, ``weights`` has pattern and n. ``edges`` may have a parameter that
    several share, and their shares of it; without these columns each edge has its own. The likelihood never falls. It ends after
    ``rounds``, or when no length changes by more than ``tolerance``. Patterns that cannot be, or have no weight, count nowhere.
    """
    spark = data.sparkSession
    more = {"parameter": F.col("child"), "share": F.lit(1.0)}
    now = _held(edges.withColumns({c: v for c, v in more.items() if c not in edges.columns}))
    data = likelihood.dealt(data)
    left = {"jumps": likelihood.jumps(rates.filter("s <> t")), "exits": likelihood.exits(rates)}
    history = []
    for k in range(rounds):
        told = local(spark, now, EDGES)
        inner = likelihood.transitions_with(rates, told, prior, **left)
        tree = likelihood.prune(data, told, inner, prior, ready=True)
        total = tree.lnl.filter("lnl > double('-Infinity')").join(weights, "pattern").agg(F.sum(F.col("n") * F.col("lnl"))).first()[0]
        then = _held(step(tree, told, inner, weights))
        tree.release()
        before = {r["child"]: r["length"] for r in now}
        change = max((abs(r["length"] - before[r["child"]]) for r in then), default=0.0)
        history.append((k, float(total or 0.0), change))
        now = then
        if change <= tolerance:
            break
    release(data)
    return local(spark, now, EDGES), local(spark, history, "round int, lnl double, change double")
