"""Results written to the folder of checkpoints that the cluster shares, their removal, and relations of a few given rows."""

from __future__ import annotations

import os
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def cut(df: DataFrame) -> DataFrame:
    """df, made now and written to ``spark.checkpoint.dir``, without its lineage. Only a session on one machine may leave that unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "helixframe-checkpoints"))
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Removes the files of results of ``cut`` that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a relation that plans know to be small: parts of a model, whose size the data do not change."""
    kinds = StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [[] for _ in kinds]
    arrow = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow), kinds).coalesce(1)
