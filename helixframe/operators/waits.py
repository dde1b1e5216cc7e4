"""Waiting times as data: running sums of each group, cut at a limit, and the branch that each moment falls on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(rows: DataFrame, by: str, order: list[str], wait: str, block: Column) -> DataFrame:
    """rows with ``at``: the sum of the waits of the group so far. ``block`` must rise with the order, such as the day of a time.

    Sums within blocks and of whole blocks are taken apart, so that a group with very many rows is shared by the tasks of its blocks.
    """
    cells = rows.withColumn("__block", block)
    sums = cells.groupBy(by, "__block").agg(F.sum(wait).alias("__sum"))
    before = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = cells.withColumn("__own", F.sum(wait).over(inside))
    return own.join(starts, [by, "__block"]).withColumn("at", F.col("__start") + F.col("__own")).drop("__block", "__own", "__start")


def on_branches(timed: DataFrame, branches: DataFrame, by: str, *, at: str = "at") -> DataFrame:
    """timed with the branch (by, branch, begin, until) of its group that holds ``at``: begin <= at < until; rows on none are cut off.

    Branches of a group do not overlap. Moments and beginnings are put in one order and each moment takes the last beginning: no
    moment is compared with a branch that is not its own.
    """
    names = [c for c in timed.columns]
    starts = branches.select(by, F.col("begin").alias("__at"), F.lit(0).alias("__kind"), F.struct("branch", "begin", "until").alias("__branch"))
    rows = timed.select(by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*names).alias("__row"))
    w = Window.partitionBy(by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(rows, allowMissingColumns=True).withColumn("__last", F.last("__branch", ignorenulls=True).over(w))
    got = both.filter("__kind = 1 and __at < __last.until")
    return got.select(*[F.col(f"__row.{c}").alias(c) for c in names], F.col("__last.branch").alias("branch"), (F.col("__at") - F.col("__last.begin")).alias("since"))
