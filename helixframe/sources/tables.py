"""Scans of alignments, mappings, indexes and result files, and the writers that match them."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, *, paralogs: list[str] | None = None) -> DataFrame:
    """name, species, gene, seq of every record of FASTA files.

    Names are ``species__gene``; with ``paralogs`` they are a species with one of these behind it. Records are split by
    Spark's text reader, so a file of many records is read in parallel. Sequences may run over several lines.
    """
    raw = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    rows = raw.select(F.trim(F.get(lines, F.lit(0))).alias("name"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s+", "").alias("seq"))
    if paralogs is None:
        parts = F.split("name", "__")
        return rows.select("name", F.get(parts, F.lit(0)).alias("species"), F.get(parts, F.lit(1)).alias("gene"), "seq")
    hits = F.filter(F.array(*map(F.lit, paralogs)), lambda p: F.endswith(F.col("name"), p))
    gene = F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))  # just one may match; else null, which check_alignment reports
    return rows.select("name", F.substring("name", F.lit(1), F.length("name") - F.length(gene)).alias("species"), gene.alias("gene"), "seq")


def alignment_lengths(seqs: DataFrame, *by: str) -> DataFrame:
    """``by``, lengths (how many different ones), longest: one row for each alignment."""
    return seqs.groupBy(*by).agg(F.countDistinct(F.length("seq")).alias("lengths"), F.max(F.length("seq")).alias("longest"))


def check_alignment(seqs: DataFrame, *, coding: bool = False) -> int:
    """The common length of the sequences; raises if lengths differ, a name has no gene, or coding lengths are not in threes."""
    r, odd = alignment_lengths(seqs).first(), seqs.filter(F.col("gene").isNull()).count()
    if r["lengths"] != 1 or odd:
        raise ValueError(f"{r['lengths']} sequence lengths and {odd} names without a gene")
    if coding and r["longest"] % 3:
        raise ValueError("the length of a coding alignment must be a multiple of three")
    return r["longest"]


def alignment_violations(seqs: DataFrame, *by: str, coding: bool = False) -> DataFrame:
    """``by``, problem, n: all that is wrong with alignments, where ``check_alignment`` raises: sequences not as long as the longest of
    theirs (``lengths``), names without a gene (``genes``) or used before (``names``), and when coding lengths not in threes (``threes``).

    Sequences are counted by length before they meet, so that an alignment of very many is no large group.
    """
    size = F.coalesce(F.length("seq"), F.lit(0))
    kinds = seqs.groupBy(*by, size.alias("length")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gene").isNull()).alias("genes"))
    longest = F.max(F.struct("length")).alias("top")
    tops = kinds.groupBy(*by).agg(longest, F.sum("n").alias("all"), F.sum("genes").alias("genes"), F.sum(F.when(F.lit(coding) & (F.col("length") % 3 != 0), F.col("n")).otherwise(0)).alias("threes"))
    same = kinds.select(*by, F.struct("length").alias("top"), "n")
    on = [*by, "top"]
    lengths = tops.join(same, on).withColumn("lengths", F.col("all") - F.col("n")).drop("n", "top", "all")
    twice = seqs.groupBy(*by, "name").count().filter("count > 1").groupBy(*by).agg(F.sum(F.col("count") - 1).alias("names"))
    both = lengths.join(twice, list(by), "left") if by else lengths.crossJoin(twice)  # one row
    wide = both.withColumn("names", F.coalesce("names", F.lit(0)))
    return wide.unpivot(list(by), ["lengths", "genes", "names", "threes"], "problem", "n").filter("n > 0")


def check_index(index: DataFrame, n_sites: int, *, coding: bool = False) -> None:
    """Raises unless the index has a row for each site, at places that rise, and coding sites come in whole codons."""
    r = index.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("nt_index").alias("places"), F.count_if(~F.col("codon_site").isin(1, 2, 3)).alias("odd")).first()
    if r["n"] != n_sites or r["places"] != n_sites:
        raise ValueError(f"{r['n']} rows at {r['places']} places for {n_sites} sites")
    if coding and (r["odd"] or n_sites % 3):
        raise ValueError("a coding index needs whole codons, with codon sites 1 to 3")


def check_genes(seqs: DataFrame, gene_map: DataFrame, tips: list[str]) -> None:
    """Raises if a gene of the map has no sequence, a sequence no group, or a species of the map is no tip of the tree."""
    lacking = gene_map.join(seqs.select(F.col("name").alias("gene")), "gene", "left_anti").count()
    unknown = seqs.join(gene_map.select(F.col("gene").alias("name")), "name", "left_anti").count()
    strange = gene_map.filter(~F.get(F.split("gene", "__"), F.lit(0)).isin(*tips)).count()
    if lacking or unknown or strange:
        raise ValueError(f"{lacking} genes without a sequence, {unknown} sequences without a group, {strange} genes of species that are no tips")


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Records of name and seq, as text."""
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """gene, orlg: the ortholog group of each gene."""
    w = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(w, F.lit(0)).alias("gene"), F.get(w, F.lit(1)).cast("int").alias("orlg"))


def genes_by_group(gene_map: DataFrame) -> DataFrame:
    return gene_map.groupBy("orlg").agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def read_index(spark: SparkSession, path: str, *, coding: bool = True) -> DataFrame:
    """site, nt_index, codon, codon_site; the last two are -1 when not coding. ``site`` counts rows by nt_index."""
    w = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double").cast("int"))
    rows = spark.read.text(path).filter(F.trim("value") != "").select(w.alias("w"))
    rows = rows.select(F.get("w", F.lit(0)).alias("nt_index"), *[(F.get("w", F.lit(k)) if coding else F.lit(-1)).alias(n) for k, n in ((1, "codon"), (2, "codon_site"))])
    from pyspark.sql import Window

    return rows.withColumn("site", (F.row_number().over(Window.orderBy("nt_index")) - 1).cast("int"))  # one gene's index


def make_index(spark: SparkSession, n: int, *, coding: bool = True) -> DataFrame:
    """The index of n sites without jumps: from 1 in codons when coding, else from 0."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("site"))
    if not coding:
        return rows.select("site", F.col("site").alias("nt_index"), F.lit(-1).alias("codon"), F.lit(-1).alias("codon_site"))
    return rows.select("site", (F.col("site") + 1).alias("nt_index"), (F.floor(F.col("site") / 3) + 1).cast("int").alias("codon"), (F.col("site") % 3 + 1).alias("codon_site"))


def fill_index(index: DataFrame, *by: str, place: str = "nt_index", missing: int = -1) -> DataFrame:
    """index with the places missing between the first and the last of each group; all other columns are -1 there."""
    rest = [c for c in index.columns if c not in (*by, place, "site")]
    span = index.groupBy(*by).agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a is not null").select(*by, F.explode(F.sequence("a", "b")).alias(place))
    return span.join(index.drop("site"), [*by, place], "left").select(*by, place, *[F.coalesce(c, F.lit(missing)).alias(c) for c in rest])


def read_sitewise(spark: SparkSession, path: str) -> DataFrame:
    """site, lnl; lines that start with # are comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="site int, lnl double").filter("site is not null")


def write_sitewise(rows: DataFrame, path: str) -> None:
    """site and lnl under the header ``#Site  lnL``."""
    rows.select(F.col("site").alias("#Site"), F.col("lnl").alias("lnL")).sort("#Site").write.mode("overwrite").option("header", True).csv(path, sep="\t")


def write_pairwise(rows: DataFrame, path: str) -> None:
    """space, i, j and lnl of pairs of sites, in that order, under a header."""
    rows.select("space", "i", "j", "lnl").sort("space", "i", "j").write.mode("overwrite").option("header", True).csv(path, sep="\t")


def write_moments(rows: DataFrame, path: str, column: str) -> None:
    """An array column, such as the gradients or Hessians of pattern_moments, as text: a row each, numbers with blanks between
    them, repeated as often as its n says."""
    line = F.array_join(F.transform(column, lambda x: F.format_string("%.18e", x)), " ")
    rows.select(line.alias("value"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("value").write.mode("overwrite").text(path)


def read_moments(spark: SparkSession, path: str, column: str) -> DataFrame:
    """What write_moments wrote, a row each."""
    return spark.read.text(path).select(F.transform(F.split("value", " "), lambda x: x.cast("double")).alias(column))


def _summary_rows(texts: DataFrame) -> DataFrame:
    """place, label, value of texts, a whole file each: numbers and labels are matched by their place."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    numbers = F.filter(lines, lambda x: ~x.startswith("#"))
    labels = F.filter(F.split(F.regexp_replace(F.element_at(F.filter(lines, lambda x: x.startswith("#")), -1), r"\A#\s*", ""), r"\s+"), lambda x: x != "")
    rest = [c for c in texts.columns if c != "value"]
    rows = texts.select(*rest, F.posexplode(F.arrays_zip(labels.alias("label"), numbers.alias("number"))).alias("place", "x"))
    return rows.filter("x.label is not null and x.number is not null").select(*rest, "place", F.col("x.label").alias("label"), F.col("x.number").cast("double").alias("value"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """label, value of a summary: one number a line, and a last line ``# labels``."""
    return _summary_rows(spark.read.text(path, wholetext=True)).select("label", "value")


def write_summary(summary: DataFrame, path: str) -> None:
    """The numbers, then their labels, as one file wherever Spark's file systems reach; parts are as small as a model."""
    rows = summary.select("label", "value").collect()
    text = "".join(f"{r['value']:.18e}\n" for r in rows) + "# " + " ".join(r["label"] for r in rows) + "\n"
    sc = summary.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_summaries(rows: DataFrame, path: str) -> None:
    """Summaries (run, place, label, value) of any number of runs as a file each, below ``run=...`` in a folder.

    A run's numbers, as many as its model has, make up one text; texts are dealt out by run.
    """
    number = F.transform("x", lambda r: F.format_string("%.18e", r["value"]))
    texts = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("place", "label", "value"))).alias("x"))
    text = F.concat(F.array_join(number, "\n"), F.lit("\n# "), F.array_join(F.transform("x", lambda r: r["label"]), " "))
    texts.select(text.alias("value"), "run").repartition("run").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("run").text(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """run, place, label, value of all files that write_summaries wrote into a folder, in one scan."""
    return _summary_rows(spark.read.option("basePath", path).schema("value string, run string").text(path, wholetext=True)).select("run", "place", "label", "value")


def read_summaries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """label and one column of values for each run: a pivot of the runs' summaries, read in one scan and told apart by their files."""
    texts = spark.read.text(sorted(set(paths.values())), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    tail = lambda p: "/" + p.split("://")[-1].lstrip("/")
    of = F.explode(F.array(*[F.struct(F.lit(run).alias("run"), F.lit(tail(path)).alias("path")) for run, path in paths.items()]))
    named = texts.select("*", of.alias("r")).filter(F.url_decode("file").endswith(F.col("r.path")) | F.url_decode("file").contains(F.concat(F.col("r.path"), F.lit("/")))).select("value", F.col("r.run").alias("run"))
    return pivot_summaries(_summary_rows(named).select("run", "label", "value"), list(paths))


def pivot_summaries(rows: DataFrame, runs: list[str] | None = None) -> DataFrame:
    return rows.groupBy("label").pivot("run", runs).agg(F.first("value"))


def save_x(x: np.ndarray, path: str) -> None:
    """A parameter vector, one number a line; written beside and moved, so that a reader sees a whole file."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    np.savetxt(path + ".part", np.asarray(x))
    os.replace(path + ".part", path)


def load_x(path: str) -> np.ndarray | None:
    """The saved vector, or null if there is none: a .npy beside the text comes first if it holds numbers."""
    if os.path.exists(path + ".npy"):
        x = np.load(path + ".npy")
        if x.size:
            return x
    return np.atleast_1d(np.loadtxt(path)) if os.path.exists(path) else None


def append_log(rows: DataFrame, path: str, batch: int | str | None = None) -> None:
    """Appends events or iterations to a Parquet log. With the id of a ``batch`` its rows take the place of those that an earlier attempt
    at the batch has left, so that a repeated batch counts once; the log then has a column ``batch``."""
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
