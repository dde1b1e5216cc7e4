"""Derivatives from a relation of points: which moves of the parameters make a point, and with what weight its value enters each derivative.

Values at the points come from anywhere (point, ..., value); gradients and Hessians are one join with the weights and one sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(params: DataFrame, size: float = 1e-5) -> DataFrame:
    """i, j, point, weight, moves of the central differences by the parameters (i, x); j is null in a gradient.

    Gradients take two points, second derivatives five and mixed ones four. A point is named by its moves, an array of (i, by):
    steps are ``size`` times |x|, or ``size`` where x is 0. k parameters have 1 + 4 k + 2 k (k - 1) points.
    """
    p = params.select("i", F.when(F.col("x") == 0, size).otherwise(F.abs("x") * size).alias("h"))
    none = F.array().cast("array<struct<i:int,by:double>>")
    move = lambda i, by: F.array(F.struct(F.col(i).cast("int").alias("i"), by.alias("by")))
    step = lambda m, w: F.struct(F.lit(float(m)).alias("m"), F.lit(float(w)).alias("w"))
    first = p.select("i", F.lit(None).cast("int").alias("j"), "h", F.explode(F.array(step(-1, -0.5), step(1, 0.5))).alias("e")).select("i", "j", (F.col("e.w") / F.col("h")).alias("weight"), move("i", F.col("e.m") * F.col("h")).alias("moves"))
    five = F.array(*[step(m, w / 12) for m, w in ((-2, -1), (-1, 16), (0, -30), (1, 16), (2, -1))])
    own = p.select("i", F.col("i").alias("j"), "h", F.explode(five).alias("e")).select("i", "j", (F.col("e.w") / F.col("h") ** 2).alias("weight"), F.when(F.col("e.m") == 0, none).otherwise(move("i", F.col("e.m") * F.col("h"))).alias("moves"))
    q = F.broadcast(p.select(F.col("i").alias("j"), F.col("h").alias("hj")))  # parameters of a model
    four = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a in (-1, 1) for b in (-1, 1)])
    mixed = p.join(q, F.col("j") < F.col("i")).select("i", "j", "h", "hj", F.explode(four).alias("e"))
    mixed = mixed.select("i", "j", (F.col("e.a") * F.col("e.b") / (4 * F.col("h") * F.col("hj"))).alias("weight"), F.concat(move("j", F.col("e.b") * F.col("hj")), move("i", F.col("e.a") * F.col("h"))).alias("moves"))
    return first.unionByName(own).unionByName(mixed).select("i", "j", F.xxhash64("moves").alias("point"), "weight", "moves")


def points(params: DataFrame, terms_: DataFrame) -> DataFrame:
    """point, i, x: the parameters at every point, a row each."""
    at = terms_.select("point", "moves").dropDuplicates(["point"])
    by = F.aggregate(F.filter("moves", lambda m: m["i"] == F.col("i")), F.lit(0.0), lambda s, m: s + m["by"])
    return at.crossJoin(F.broadcast(params)).select("point", "i", (F.col("x") + by).alias("x"))


def derivatives(values: DataFrame, terms_: DataFrame, *by: str) -> DataFrame:
    """``by``, i, j, value: gradients (j null) and Hessians (i >= j) of what ``values`` (point, by, value) has."""
    w = F.broadcast(terms_.select("point", "i", "j", "weight"))
    return values.join(w, "point").groupBy(*by, "i", "j").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def means(got: DataFrame, weights: DataFrame, unit: str, *by: str) -> DataFrame:
    """``by``, i, j, moment, hessian: over all units of a group the mean products of gradients and mean Hessians, i and j both ways.

    ``weights`` has unit, by and n. A unit's gradients meet in a join by unit, so that none is gathered.
    """
    g = got.filter("j is null").select(unit, "i", F.col("value").alias("g"))
    other = g.select(unit, F.col("i").alias("j"), F.col("g").alias("o"))
    n = weights.select(unit, *by, "n")
    m = g.join(other, unit).join(n, unit).groupBy(*by, "i", "j").agg((F.sum(F.col("n") * F.col("g") * F.col("o")) / F.sum("n")).alias("moment"))
    h = got.filter("j is not null").join(n, unit).groupBy(*by, "i", "j").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("hessian"))
    both = h.unionByName(h.filter("i <> j").select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "hessian"))
    return m.join(both, [*by, "i", "j"])


def inverse(m: Column, k: Column) -> Column:
    """The inverse of a positive definite matrix (an array of rows) in a row, by elimination; null if it has none."""
    unit = F.transform(F.sequence(F.lit(0), k - 1), lambda r: F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.when(r == c, 1.0).otherwise(0.0)))
    wide = F.zip_with(m, unit, lambda a, b: F.concat(a, b))

    def step(rows: Column, p: Column) -> Column:
        pivot = F.transform(F.get(rows, p), lambda v: v / F.nullif(F.get(F.get(rows, p), p), F.lit(0.0)))
        return F.transform(rows, lambda row, r: F.when(r == p, pivot).otherwise(F.zip_with(row, pivot, lambda a, b: a - F.get(row, p) * b)))

    done = F.aggregate(F.sequence(F.lit(0), k - 1), wide, step)
    return F.transform(done, lambda row: F.slice(row, k + 1, k))


def times(a: Column, b: Column, k: Column) -> Column:
    """The product of two matrices in a row."""
    places = F.sequence(F.lit(0), k - 1)
    return F.transform(a, lambda row: F.transform(places, lambda c: F.aggregate(places, F.lit(0.0), lambda s, t: s + F.get(row, t) * F.get(F.get(b, t), c))))


def godambe(means_: DataFrame, *by: str) -> DataFrame:
    """``by``, i, j, value: H inverse(J) H of every group, with H the mean of minus the Hessians and J of the gradients' products (Godambe, 1960).

    A group's matrices are as wide as its model has parameters and fit a row.
    """
    rows = lambda c: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda r: F.transform(F.slice("cells", r * F.col("k") + 1, F.col("k")), lambda x: x[c]))
    wide = means_.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "j", "moment", (-F.col("hessian")).alias("h")))).alias("cells")).withColumn("k", F.sqrt(F.size("cells")).cast("int"))
    h = rows("h")
    g = times(times(h, inverse(rows("moment"), F.col("k")), F.col("k")), h, F.col("k"))
    place = wide.select(*by, "cells", "k", g.alias("g")).select(*by, "cells", "k", F.posexplode(F.flatten("g")).alias("at", "value"))
    cell = F.get("cells", F.col("at"))
    return place.select(*by, cell["i"].alias("i"), cell["j"].alias("j"), "value")
