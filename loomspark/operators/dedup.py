"""Exact dedup with a defined survivor: the first in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedupe_key, group_key, pystrip


def first_wins(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first in ``order`` (whose columns must tell rows apart).

    One aggregation over hashes of the keys holds the survivor's whole row, so the input is read once,
    copies collapse before the shuffle and a key with very many rows is no burden to one task.
    """
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    firsts = df.groupBy(digest.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return firsts.select(*[F.col(f"_row.`{c}`") for c in df.columns])


def dedupe_records(df: DataFrame, payload: list[str], order: list[str]) -> DataFrame:
    """Records whose whole payload is new, across all splits."""
    return first_wins(df, [dedupe_key(payload)], order)


def dedupe_grouped(df: DataFrame, key_col: str, text_col: str, order: list[str], split_col: str | None = None) -> DataFrame:
    """Records new by (group key, text) within their split."""
    keys = [group_key(key_col, text_col).alias("k"), F.col(text_col).alias("t")]
    return first_wins(df, keys + ([F.col(split_col).alias("s")] if split_col else []), order)


def ordered_distinct(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """Distinct values with the order of their first appearance."""
    return df.groupBy(value.alias(name)).agg(F.min(order).alias("first_ord"))


def hash_set(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct SHA-256 of the stripped, non-empty texts."""
    text = pystrip(F.coalesce(text_col, F.lit("")))
    return df.select(text.alias("t")).where("t <> ''").select(F.sha2("t", 256).alias("hash")).distinct()
