"""The registered queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, embeddings, fingerprints, langid, lines, packing, pieces, simhash, substrings, toxicity, url_filter, warc
from .common import table

def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed rules of the URL query (host and path, verdict).
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url. The labelled table is what the rules decide among the pages, at most 1,000 urls of it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hit = url_filter.rule_of(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), URL_RULES)
    labelled = pages.select("url", F.when(hit["verdict"] == "block", 1).when(hit["verdict"] == "allow", 0).alias("label"))
    return url_filter.judge(pages, url_filter.fit(labelled), URL_RULES)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector goes through the join of blocks: no leaders."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), max_leaders=0)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, as passages lie within lines; runs of 25 words and more, so that phrases that any text may hold stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup(docs, unit="sentence", min_words=25).withColumn("spans", substrings.spans_text(F.col("spans")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character counts are of all documents; labels are learned only from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    out = langid.held_out("doc_id", 4, 2)
    model = toxicity.fit(docs, labels.filter(~out), toxicity.count_letters(docs))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out("doc_id", 5, 0)
    model = langid.fit(docs.filter(~out))
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "spans")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.withColumn("removed", lines.removed_text(F.col("removed")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_url_filter": op2_url_filter,
        "op3_embeddings": op3_embeddings,
        "op4_pieces": op4_pieces,
        "op5_substrings": op5_substrings,
        "op6_simhash": op6_simhash,
        "op7_fingerprints": op7_fingerprints,
        "op8_toxicity": op8_toxicity,
        "op9_langid": op9_langid,
        "op10_lines": op10_lines,
        "op11_warc": op11_warc,
        "op12_conversations": op12_conversations,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embeddings": embeddings.oracle(), "op5_substrings": substrings.oracle(), "op10_lines": lines.oracle(), "op11_warc": warc.oracle(), "op12_conversations": conversations.oracle(), "op13_collocations": collocations.oracle()}
