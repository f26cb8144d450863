"""Overlap of two corpora by hashes of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pystrip
from .dedup import hash_set


def overlap(main: DataFrame, probe: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row: total, overlap, overlap_ratio (4 digits), verdict. Each probe row counts, copies too.

    The probe is counted per hash before the join, so neither side's copies are joined one by one.
    """
    text = pystrip(F.coalesce(F.col(text_col), F.lit("")))
    counts = probe.select(text.alias("t")).where("t <> ''").groupBy(F.sha2("t", 256).alias("hash")).count()
    hits = counts.join(hash_set(main, text_col).withColumn("hit", F.lit(1)), "hash", "left")
    sums = hits.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("count"))), F.lit(0)).alias("overlap"))
    ratio = F.when(F.col("total") > 0, F.col("overlap") / F.col("total")).otherwise(0.0)
    return sums.select("total", "overlap", F.round(ratio, 4).alias("overlap_ratio"), F.when(ratio >= threshold, "exclude").otherwise("include").alias("verdict"))
