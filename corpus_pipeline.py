"""The corpus pipeline: classify, drop near duplicates, cut repeated passages, mix sources, pack.

Every stage takes (spark, docs, sf_dir) with the columns of documents and returns them again; the last returns the
packing plan. Stages are written as Parquet to the shared folder and reread, so each works on all that its predecessor
kept and a lost executor costs a reread.

Stages decide row by row: rows with a null or repeated doc_id are documents of their own, and no stage joins texts back
by doc_id. Null texts count as empty. Rows equal in id and text are one document: the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import boosted_quality, mixing, ngram_join, packing, substring_dedup
from tidelog.llm.common import crc_mod, drop_path, settle, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier predicts to be good. It is learned from the labelled documents outside the held-out third."""
    docs = docs.select(*COLUMNS)
    return boosted_quality.good(docs, boosted_quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every component (five words, similarity 0.8): that with the smallest doc_id, null ids last."""
    return ngram_join.without_copies(docs.select(*COLUMNS), k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 13 words and more that a document with a smaller doc_id has; documents left without a word go.

    Documents without such a passage keep their text as it is, and so do rows with a null doc_id.
    """
    got = substring_dedup.dedup(docs.select(*COLUMNS), keep=COLUMNS[1:]).where("n_removed = 0 or kept <> ''")
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("_text"))
    return got.select("doc_id", text.alias("text"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.when(cut, F.length("kept").cast("long")).otherwise(F.col("_n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets; a document stands as often as it is taken."""
    return mixing.mix(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(stage(packing.tokenized_pieces(docs, packing.default_vocabulary()), "pieces"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("source mixing", mix), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has staged on its way, and its input, are deleted when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs, folder = settle(spark, lambda step=step, docs=docs: step(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_path(spark, before)
        before = folder
    return docs
