"""Joint analyses of families as relations: which parameters each family has, which of them are shared, and gradients over all.

``names`` has family, name, shared. A parameter's place is its name where it is shared, else that of its family and the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def places(names: DataFrame) -> DataFrame:
    """family, name, place of every parameter of every family."""
    own = F.concat_ws(":", F.col("family").cast("string"), "name")
    return names.select("family", "name", F.when(F.col("shared"), F.col("name")).otherwise(own).alias("place"))


def _told(values: DataFrame, names: DataFrame) -> DataFrame:
    """Parameters beside their values; ok where there is one and it is a number."""
    got = places(names).join(values.select("family", "name", "value"), ["family", "name"], "left")
    return got.withColumn("ok", F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def gradient(values: DataFrame, names: DataFrame) -> DataFrame:
    """place, value, families: each family's derivatives (family, name, value) at the places of the joint vector, summed once where shared.

    A family with a derivative that is missing or no number counts nowhere: see ``failures``. Sums are combined before their shuffle,
    so a shared parameter of very many families is no large group.
    """
    told = _told(values, names)
    whole = told.join(told.filter(~F.col("ok")).select("family").distinct(), "family", "left_anti")
    return whole.groupBy("place").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("families"))


def failures(values: DataFrame, names: DataFrame) -> DataFrame:
    """family, name: the derivatives that a family lacks, a row each, in place of an error that ends the work of all."""
    return _told(values, names).filter(~F.col("ok")).select("family", "name")
