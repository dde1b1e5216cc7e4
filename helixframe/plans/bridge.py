"""The driver's tables as inputs of the operators: documents as genes, users' events as chains, geography as a tree."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import neighbours, nucleotide_state
from ..functions.lineage import cut
from ..sources.newick import parse, splice

TREE = "(((en,de)N2,fr)N1,es)N0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for files that a query writes and reads again, in the folder that the cluster shares; it goes at the end."""
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        top = tempfile.gettempdir()
    folder = f"{top}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """df, read now and written to the checkpoint folder, so that the files it was read from can go."""
    return cut(df)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, seq: the letters A, C, G, T of each document."""
    letters = F.upper(F.regexp_replace("text", "[^ACGTacgt]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", letters.alias("seq"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pos, st of every letter."""
    rows = sequences(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(F.split("seq", "")).alias("pos", "symbol")).filter("symbol <> ''")
    return rows.select("doc_id", "lang", "source", "pos", nucleotide_state(F.col("symbol")).alias("st"))


def neighbour_pairs(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """``by``, sa, sb, n: how often two letters stand side by side in a document, by their states."""
    pairs = sequences(spark, sf_dir).select(*by, F.explode(neighbours(F.col("seq"))).alias("pair")).groupBy(*by, "pair").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(*by, nucleotide_state(F.substring("pair", 1, 1)).alias("sa"), nucleotide_state(F.substring("pair", 2, 1)).alias("sb"), "n")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nt, n, freq over all letters."""
    from ..operators.encode import base_composition

    return base_composition(sequences(spark, sf_dir))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, site, nt_index, lnl, lnl_no: each user's events in order, with likelihoods by the kind of event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).cast("int").alias("site"))
    kind = F.instr(F.lit("sepvc"), F.substring("event_type", 1, 1))
    lnl = -1.0 - kind * 0.25
    return rows.select("user_id", "site", (F.col("site") + F.floor(F.col("site") / 5)).cast("int").alias("nt_index"), lnl.alias("lnl"), (lnl - 0.02 * kind * kind).alias("lnl_no"))


def family_patterns(spark: SparkSession, sf_dir: str):
    """Tree, axes and patterns: the k-th documents (by doc_id) of a source in each language are a family, as genes of one copy.

    The genes of a family begin together; what one of them lacks at the end, or a language without a k-th document lacks
    altogether, is missing. The tree has no tip for other languages.
    """
    tree = splice(parse(TREE), [("N0_N1", ["D1"])])
    langs = ["de", "en", "es", "fr"]
    nth = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id", "seq"))
    genes = sequences(spark, sf_dir).filter(F.col("lang").isin(langs)).withColumn("k", nth)
    wide = genes.groupBy("source", "k").agg(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col("seq"))), F.lit("")).alias(x) for x in langs])
    # a family lies in one row, so its letters are put beside each other there; the shorter genes are filled with nulls
    states = wide.select(*[F.filter(F.split(x, ""), lambda c: c != "").alias(x) for x in langs])
    sites_ = F.transform(F.arrays_zip(*langs), lambda z: F.array(*[F.coalesce(nucleotide_state(z[x]), F.lit(-1)) for x in langs]))
    patterns = states.select(F.lit(1).alias("codon_position"), F.explode(sites_).alias("pattern")).groupBy("codon_position", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return tree, [(k, 0) for k in langs], patterns
