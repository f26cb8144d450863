"""The corpus pipeline: five stages from ``documents`` to token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and reread as the next one's docs. All but the last return the columns of documents.

Nulls and empty texts pass the first four stages (they are not toxic, near-duplicates of nothing and hold no
passage) and are mixed by their source's rate; the last gives them no ids. Null ids and sources are values like
others; rows without an id link with nothing and count as later than all others. Repeated rows fare alike, but for
near-duplicates: of one id only the least of its component stays, with all its rows. An empty table passes as one.
Further columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, minhash, mixing, substring_dedup, toxicity
from loomspark.llm.common import Tables, drop_table, load, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a passage that must repeat before a later document loses it.
PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on their labels, scores below one half; without labels of both
    kinds the seed grammar decides."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, 80 %) the document of least id; a row without an id,
    or without words, stays."""
    return minhash.near_duplicates(docs).where("kept").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of lesser id holds; texts that lose nothing stay as they
    are, those that lose every word go."""
    out = substring_dedup.repeated(docs, window=PASSAGE)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for; a source without words, once."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (a null one: none), and whether they decode to it."""
    ids = bpe.encoded(docs, with_offsets=False, keep_text=False, round_trip=True)
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL has no merges by rank; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it; what a stage wrote on
    its way, and what it read, is deleted then."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with Tables(spark) as own:
            docs = own.release(materialize(stage(spark, before, sf_dir)))
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
