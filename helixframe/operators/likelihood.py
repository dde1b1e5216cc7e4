"""Likelihoods on trees, and what is expected along their edges, as relations: any rates, any tree, no matrix in one place.

``edges`` has parent, child, process, length; ``rates`` process, s, t, rate (s <> t); ``prior`` s, p; ``data`` pattern, node, s: the
states that each pattern allows at each node with data. A state that is not in a relation has the value 0. Messages are rows
(pattern, node, s, v), so work is dealt out by patterns and, of one pattern, by states; exponentials are made by joining a relation
of rates with itself. Sums over patterns are left to the caller.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, local, release
from ..sources.newick import Tree

#: Norm to which a generator is halved, and terms of the series there: the rest is below 1e-15.
NORM, TERMS = 0.25, 11
#: Rows of a model's relation up to which it is broadcast and made in one task; larger ones are shuffled. Edges of a tree at most.
MOST_BROADCAST, MOST_EDGES = 500_000, 100_000


def _one(df: DataFrame) -> DataFrame:
    """A relation of a model's rates or states, whose size the data do not change, in one partition."""
    return df.coalesce(1)


def generator(rates: DataFrame) -> DataFrame:
    """process, s, t, rate with the diagonal that makes rows sum to zero."""
    out = _one(rates.filter("s <> t").select("process", "s", "t", "rate"))
    return out.unionByName(out.groupBy("process", "s").agg((-F.sum("rate")).alias("rate")).select("process", "s", F.col("s").alias("t"), "rate")).coalesce(1)


def product(a: DataFrame, b: DataFrame, *, small: bool = False) -> DataFrame:
    """k, s, t, v: of each k the product of two matrices (k, s, t, v); rows are not yet summed."""
    right = b.select("k", F.col("s").alias("via"), "t", F.col("v").alias("w"))
    got = a.select("k", "s", F.col("t").alias("via"), "v").join(F.broadcast(right) if small else right, ["k", "via"])
    return got.select("k", "s", "t", (F.col("v") * F.col("w")).alias("v"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k", "s", "t").agg(F.sum("v").alias("v"))


def exponential(a: DataFrame, states: DataFrame) -> DataFrame:
    """k, s, t, v: exp of every matrix k of a (k, s, t, v); ``states`` has k and all s.

    Halved until the largest row sum is NORM at most, by its series, and squared again: a join and a sum each time, all k together.
    Where all matrices have no more than MOST_BROADCAST places the joins are broadcast, within one task.
    """
    one = cut(states.select("k", "s", F.col("s").alias("t"), F.lit(1.0).alias("v")).coalesce(1))
    places = one.groupBy("k").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    little = places <= MOST_BROADCAST
    a = cut(a.select("k", "s", "t", "v").coalesce(1) if little else a.select("k", "s", "t", "v"))
    top = a.groupBy("k", "s").agg(F.sum(F.abs("v")).alias("v")).agg(F.max("v")).first()[0] or 0.0
    halvings = max(0, math.ceil(math.log2(top / NORM))) if top > NORM else 0
    x = one
    for j in range(TERMS, 0, -1):
        step = product(x, a, small=little).withColumn("v", F.col("v") / (j * 2.0**halvings)).unionByName(one)
        x = _summed(step.coalesce(1) if little else step)
    x = cut(x)
    for _ in range(halvings):
        twice = cut(_summed(product(x, x, small=little)))
        release(x)
        x = twice
    release(a, one)
    return x


def _kinds(edges: DataFrame) -> DataFrame:
    """child, k: edges that have process and length in common share a matrix."""
    return edges.select("child", "process", "length", F.xxhash64("process", "length").alias("k"))


def _states(rates: DataFrame, prior: DataFrame) -> DataFrame:
    """All states of a model, a row each: every process can be in every one."""
    return _one(rates.select("s").unionByName(rates.select(F.col("t").alias("s"))).unionByName(prior.select("s"))).distinct()


def transitions(rates: DataFrame, edges: DataFrame, prior: DataFrame) -> DataFrame:
    """child, a, b, p: the chance to end an edge in b that begins in a."""
    kinds = _kinds(edges)
    each = F.broadcast(_one(kinds.select("k", "process", "length")).distinct())
    a = generator(rates).join(each, "process").select("k", "s", "t", (F.col("rate") * F.col("length")).alias("v"))
    p = exponential(a, _states(rates, prior).crossJoin(each.select("k")))  # states by kinds of edge: the size of the model
    return cut(p.join(F.broadcast(kinds.select("child", "k")), "k").select("child", F.col("s").alias("a"), F.col("t").alias("b"), F.col("v").alias("p")))


def integrals(rates: DataFrame, edges: DataFrame, prior: DataFrame, weights: DataFrame) -> DataFrame:
    """child, a, b, p: the integral over u of exp(q u) w exp(q (length - u)), for weights (process, s, t, w) of jumps or, s = t, of states.

    It is what the exponential of twice as many states has between the halves: q in both, w from the first to the second.
    """
    kinds = _kinds(edges)
    each = F.broadcast(_one(kinds.select("k", "process", "length")).distinct())
    q = generator(rates).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    pair = lambda half, c: F.struct(half.alias("half"), F.col(c).alias("s"))
    inside = q.select("process", pair(F.col("half"), "s").alias("s"), pair(F.col("half"), "t").alias("t"), F.col("rate").alias("v"))
    across = weights.select("process", pair(F.lit(0), "s").alias("s"), pair(F.lit(1), "t").alias("t"), F.col("w").cast("double").alias("v"))
    a = inside.unionByName(across).join(each, "process").select("k", "s", "t", (F.col("v") * F.col("length")).alias("v"))
    both = _states(rates, prior).select(F.explode(F.array(pair(F.lit(0), "s"), pair(F.lit(1), "s"))).alias("s"))
    x = exponential(a, both.crossJoin(each.select("k"))).filter("s.half = 0 and t.half = 1")
    return x.join(F.broadcast(kinds.select("child", "k")), "k").select("child", F.col("s.s").alias("a"), F.col("t.s").alias("b"), F.col("v").alias("p"))


def transitions_with(rates: DataFrame, edges: DataFrame, prior: DataFrame, **weights: DataFrame) -> DataFrame:
    """child, a, b, p, and for each of ``weights`` the integral that it has in ``integrals``, all from one exponential.

    Its states stand once for the chances and once more for each weight; the first are what all others come from.
    """
    kinds = _kinds(edges)
    each = F.broadcast(_one(kinds.select("k", "process", "length")).distinct())
    copies = F.array(*[F.lit(k) for k in range(len(weights) + 1)])
    of = lambda copy, c: F.struct(copy.alias("copy"), F.col(c).alias("s"))
    a = generator(rates).withColumn("copy", F.explode(copies)).select("process", of(F.col("copy"), "s").alias("s"), of(F.col("copy"), "t").alias("t"), F.col("rate").alias("v"))
    for k, w in enumerate(weights.values(), 1):
        a = a.unionByName(w.select("process", of(F.lit(0), "s").alias("s"), of(F.lit(k), "t").alias("t"), F.col("w").cast("double").alias("v")))
    states = _states(rates, prior).withColumn("copy", F.explode(copies)).select(of(F.col("copy"), "s").alias("s"))
    x = exponential(a.join(each, "process").select("k", "s", "t", (F.col("v") * F.col("length")).alias("v")), states.crossJoin(each.select("k"))).filter("s.copy = 0")
    each_v = [F.sum(F.when(F.col("t.copy") == k, F.col("v")).otherwise(0.0)).alias(n) for k, n in enumerate(["p", *weights])]
    wide = x.groupBy("k", F.col("s.s").alias("a"), F.col("t.s").alias("b")).agg(*each_v)
    return cut(wide.join(F.broadcast(kinds.select("child", "k")), "k").select("child", "a", "b", "p", *weights))


def slopes(rates: DataFrame, edges: DataFrame, trans: DataFrame) -> DataFrame:
    """child, a, b, p: length times the derivative of the chances by the length, q exp(q length)."""
    q = generator(rates).join(F.broadcast(edges.select("child", "process", "length")), "process").select("child", F.col("s").alias("a"), F.col("t").alias("via"), (F.col("rate") * F.col("length")).alias("r"))
    return _small(trans.withColumnRenamed("a", "via")).join(q, ["child", "via"]).groupBy("child", "a", "b").agg(F.sum(F.col("r") * F.col("p")).alias("p"))


def observations(patterns: DataFrame, axes: DataFrame, digits: DataFrame, edges: DataFrame) -> DataFrame:
    """pattern, node, s: the states each pattern (an array, -1 leaves a place open) allows. ``axes`` has axis, node, pos; ``digits`` s, pos, value.

    A tip without an axis may be in any state. Axes and digits are the size of the model.
    """
    several = axes.groupBy("node").agg(F.count(F.lit(1)).alias("places"))
    seen = patterns.select("pattern", F.posexplode("pattern").alias("axis", "seen")).join(F.broadcast(axes), "axis")
    fits = seen.join(F.broadcast(digits), "pos").filter((F.col("seen") < 0) | (F.col("seen") == F.col("value")))
    got = fits.groupBy("pattern", "node", "s").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(several), "node").filter("n = places").select("pattern", "node", "s")
    tips = edges.select(F.col("child").alias("node")).join(edges.select(F.col("parent").alias("node")), "node", "left_anti").join(axes.select("node"), "node", "left_anti")
    free = tips.crossJoin(digits.select("s").distinct())
    return got.unionByName(patterns.select("pattern").crossJoin(F.broadcast(free)).select("pattern", "node", "s"))


@dataclass
class Pruned:
    """below (pattern, node, s, v): what is under each node, of largest value 1; up (pattern, parent, child, s, v): the same at the
    upper end of each edge; lnl (pattern, lnl). ``made`` are the results that stand in the checkpoint folder."""

    edges: DataFrame
    trans: DataFrame
    prior: DataFrame
    data: DataFrame
    below: DataFrame
    up: DataFrame
    lnl: DataFrame
    depth: int
    root: str
    observed: frozenset[str]
    made: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Removes all messages, those of ``outside`` too, and the chances; nothing made from them can be read again."""
        release(self.trans, *self.made)
        self.made.clear()


def _scaled(rows: DataFrame, *by: str) -> DataFrame:
    """Messages of largest value 1; where there is a column ``scale``, it has the logarithm of what was taken out."""
    top = F.max("v").over(Window.partitionBy(*by))
    got = rows.filter("v > 0").withColumn("top", top)
    more = {"scale": F.col("scale") + F.log("top")} if "scale" in rows.columns else {}
    return got.withColumns({**more, "v": F.col("v") / F.col("top")}).drop("top")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def dealt(data: DataFrame) -> DataFrame:
    """data, dealt out by patterns and written once."""
    return cut(data.select("pattern", "node", "s").repartition("pattern"))


def prune(data: DataFrame, edges: DataFrame, trans: DataFrame, prior: DataFrame, *, ready: bool = False) -> Pruned:
    """Messages up the tree, a level of it at a time from the deepest on, and the likelihood of every pattern (-inf if impossible).

    ``ready`` says that data are ``dealt`` and stay the caller's.
    """
    spark = data.sparkSession
    rows = edges.select("parent", "child", "process", "length").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"a tree of more than {MOST_EDGES} edges")
    tree = Tree([(r["parent"], r["child"]) for r in rows])
    depth = {n: len(tree.path(n)) - 1 for n in tree.nodes}
    top = max(depth.values())
    edges = local(spark, [(*r, depth[r["child"]]) for r in rows], "parent string, child string, process int, length double, depth int")
    # at a node as many messages meet as it has edges, and one more with data
    data = data if ready else dealt(data)
    made = [] if ready else [data]
    has = {r["node"] for r in data.select("node").distinct().collect()}  # nodes of the tree
    expected = local(spark, [(n, k, len(tree.children(n)) + (n in has)) for n, k in depth.items()], "node string, depth int, meet int")
    own = data.join(F.broadcast(expected), "node").select("pattern", "node", "s", F.lit(1.0).alias("v"), F.lit(0.0).alias("scale"), "depth", "meet")
    along = _small(trans.join(edges.select("parent", "child"), "child").select(F.col("child").alias("node"), F.col("b").alias("s"), "parent", "a", "p"))
    below = up = None
    waiting = None
    for d in range(top, -1, -1):
        here = own.filter(F.col("depth") == d).drop("depth")
        if waiting is not None:
            here = here.unionByName(waiting.join(F.broadcast(expected.select("node", "meet")), "node").select("pattern", "node", "s", "v", "scale", "meet"))
        met = here.groupBy("pattern", "node", "s").agg(F.product("v").alias("v"), F.sum("scale").alias("scale"), F.count(F.lit(1)).alias("n"), F.first("meet").alias("meet")).filter("n = meet")
        now = cut(_scaled(met.select("pattern", "node", "s", "v", "scale"), "pattern", "node"))
        made.append(now)
        below = now if below is None else below.unionByName(now)
        if d:
            rows = now.join(along, ["node", "s"]).groupBy("pattern", "parent", F.col("node").alias("child"), F.col("a").alias("s")).agg(F.sum(F.col("v") * F.col("p")).alias("v"), F.first("scale").alias("scale"))
            ups = cut(rows)
            made.append(ups)
            up = ups if up is None else up.unionByName(ups)
            waiting = ups.select("pattern", F.col("parent").alias("node"), "s", "v", "scale")
        else:
            seen = now.join(F.broadcast(prior), "s").groupBy("pattern").agg((F.log(F.sum(F.col("v") * F.col("p"))) + F.first("scale")).alias("lnl"))
    every = data.select("pattern").distinct()
    lnl = every.join(seen, "pattern", "left").select("pattern", F.coalesce("lnl", F.lit(-math.inf)).alias("lnl"))
    return Pruned(edges, trans, prior, data, below.drop("scale"), None if up is None else up.drop("scale"), lnl, top, tree.root, frozenset(has), made)


def outside(tree: Pruned) -> DataFrame:
    """pattern, child, s, v: at the upper end of each edge, all that is not below it, of largest value 1: messages down the tree.

    What reaches an edge is what reaches its parent, the parent's data, and the messages of its siblings: products of
    those before and behind it, so that none is divided out again and zeros do no harm.
    """
    patterns = tree.data.select("pattern").distinct()
    outer = patterns.crossJoin(F.broadcast(tree.prior)).select("pattern", F.lit(tree.root).alias("node"), "s", F.col("p").alias("v"))  # the states of a root
    along = _small(tree.trans.withColumnRenamed("a", "s"))
    allowed = tree.data.select("pattern", "node", "s", F.lit(True).alias("fits"))
    got = None
    for d in range(1, tree.depth + 1):
        edges = F.broadcast(tree.edges.filter(F.col("depth") == d).select(F.col("parent").alias("node"), "child"))
        at = outer.join(allowed, ["pattern", "node", "s"], "left").filter(~F.col("node").isin(*tree.observed) | F.col("fits")).select("pattern", "node", "s", "v")
        each = at.join(edges, "node").join(tree.up.select("pattern", "child", "s", F.col("v").alias("u")), ["pattern", "child", "s"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
        w = Window.partitionBy("pattern", "node", "s").orderBy("child")
        one = F.lit(1.0)
        others = F.coalesce(F.product("u").over(w.rowsBetween(Window.unboundedPreceding, -1)), one) * F.coalesce(F.product("u").over(w.rowsBetween(1, Window.unboundedFollowing)), one)
        above = cut(_scaled(each.select("pattern", "child", "s", (F.col("v") * others).alias("v")), "pattern", "child"))
        tree.made.append(above)
        got = above if got is None else got.unionByName(above)
        if d < tree.depth:
            outer = cut(above.join(along, ["child", "s"]).groupBy("pattern", F.col("child").alias("node"), F.col("b").alias("s")).agg(F.sum(F.col("v") * F.col("p")).alias("v")))
            tree.made.append(outer)
    return got


def expected(tree: Pruned, above: DataFrame, inner: DataFrame) -> DataFrame:
    """pattern, child, value: for each pattern and edge what ``inner`` (child, a, b, p) has between the ends, given all data.

    With ``integrals`` of the rates of jumps it is their expected number, of states the expected time in them, and with
    ``slopes`` the derivative of the log likelihood by the logarithm of the length. A pattern that cannot be has no value.
    """
    named = lambda df, c: df.select("child", "a", "b", F.col("p").alias(c))
    zero = F.lit(0.0)
    both = named(tree.trans, "p").withColumn("value", zero).unionByName(named(inner, "value").withColumn("p", zero)).groupBy("child", "a", "b").agg(F.sum("p").alias("p"), F.sum("value").alias("value"))
    return expected_each(tree, above, cut(both), "value")


def expected_each(tree: Pruned, above: DataFrame, inner: DataFrame, *names: str) -> DataFrame:
    """As ``expected``, of several columns of ``inner`` (child, a, b, p, names) at once, as ``transitions_with`` has them."""
    v = F.col("v")
    ends = above.join(_small(inner.withColumnRenamed("a", "s")), ["child", "s"]).groupBy("pattern", "child", F.col("b").alias("s")).agg(*[F.sum(v * F.col(n)).alias(n) for n in ("p", *names)])
    got = ends.join(tree.below.select("pattern", F.col("node").alias("child"), "s", "v"), ["pattern", "child", "s"]).groupBy("pattern", "child").agg(*[F.sum(F.col(n) * v).alias(n) for n in ("p", *names)])
    return got.filter("p > 0").select("pattern", "child", *[(F.col(n) / F.col("p")).alias(n) for n in names])


def jumps(rates: DataFrame, reward: Column | None = None) -> DataFrame:
    """process, s, t, w: weights of all jumps, each rate times its reward."""
    return rates.select("process", "s", "t", (F.col("rate") * (F.lit(1.0) if reward is None else reward)).alias("w"))


def exits(rates: DataFrame) -> DataFrame:
    """process, s, t, w: weights of time spent in states, each the rate at which the state is left."""
    return rates.filter("s <> t").groupBy("process", "s").agg(F.sum("rate").alias("w")).select("process", "s", F.col("s").alias("t"), "w")
