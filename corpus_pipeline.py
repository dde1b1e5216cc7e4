"""Training-corpus pipeline over ``documents``: STAGES in order, each working on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid, lines, packing, passages, simhash, substrings
from helixframe.llm.common import cut, spare, table
from helixframe.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and those of which no language has half the words."""
    return langid.keep(docs, langid.fit(docs), least_share=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines within two edits of an earlier one; documents of which nothing is left go."""
    (gone,) = spare(docs.columns, "lines")
    got = lines.dedup(docs, out=gone)
    return got.filter((F.size(gone) == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component of texts whose sets of 5-word shingles have similarity 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that stand in an earlier document; documents of which nothing is left go.

    Passages of 50 words go wherever they begin and end, then runs of whole sentences of 25 words.
    """
    some, more = spare(docs.columns, "passages", "spans")
    got = cut(passages.dedup(docs, out=some))
    got = substrings.dedup(got, unit="sentence", min_words=25, out=more)
    return got.filter((F.size(some) + F.size(more) == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document left and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The trained language model, the covering code and the tokenizer are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
