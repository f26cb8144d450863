"""Ranks and running sums over a total order without a one-task window.

Rows fall into ordered buckets; a small table holds what all earlier buckets add, and a window works
within each bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def running(df: DataFrame, order: list[Column | str], bucket: Column, value: Column | None, name: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (null: 1 a row) over all rows up to and with this one.

    bucket: must not fall along ``order``; rows with equal buckets meet in one task. by: columns whose
    groups each have a sum of their own. total: a column for the sum over all rows of the group.
    """
    value = F.lit(1) if value is None else value
    keys = list(by or [])
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    groups = Window.partitionBy(*keys)
    before = groups.orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    base = sums.select(*named, F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(groups).alias("_total"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumn(name, F.sum("_value").over(within)).join(base, met)
    out = out.withColumn(name, F.col(name) + F.col("_base"))
    out = out.withColumn(total, F.col("_total")) if total else out
    return out.drop("_bucket", "_value", "_b", "_base", "_total", *[f"_k{i}" for i in range(len(keys))])


def shuffle_hash(seed: int, ord_col: str) -> Column:
    """Sort key of the portable seeded shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(ord_col).cast("string")), 256)


def hash_digits(rows: int, bucket_rows: int = 100_000) -> int:
    """Hexadecimal digits of a hash that deal so many rows into buckets of at most ``bucket_rows``, about."""
    digits = 1
    while rows > bucket_rows * 16**digits:
        digits += 1
    return digits


def shuffled_rank(df: DataFrame, seed: int, ord_col: str = "ord", name: str = "rank", by: list[str] | None = None, total: str | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """``df`` with its rank (from 1) in a seeded random order that reruns and other engines repeat; by: within groups.

    ord_col names a row. Keys alone are ranked, in buckets whose number follows from the rows, and the ranks joined
    back; the same key in several rows gives them ranks that follow one another.
    """
    keys = [*(by or []), ord_col]
    counted = materialize(df.groupBy(*keys).agg(F.count("*").alias("_same")).withColumn("_hash", shuffle_hash(seed, ord_col)))
    found = counted.agg(F.sum("_same").alias("rows"), F.max("_same").alias("most")).first()
    digits = hash_digits(found.rows or 0, bucket_rows)
    ranked = running(counted, ["_hash", ord_col], F.substring("_hash", 1, digits), F.col("_same"), "_upto", by, "_all")
    ranks = ranked.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], (F.col("_upto") - F.col("_same")).alias("_before"), "_same", "_all")
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    out = df.join(ranks, met)
    again = Window.partitionBy(*[f"_r{i}" for i in range(len(keys))]).orderBy(F.lit(0))
    within = F.row_number().over(again) if (found.most or 0) > 1 else F.lit(1)
    out = out.withColumn(name, F.col("_before") + within)
    out = out.withColumn(total, F.col("_all")) if total else out
    return out.drop("_before", "_same", "_all", *[f"_r{i}" for i in range(len(keys))])


def permutation_rank(df: DataFrame, seed: int, ord_col: str = "ord", name: str = "rank", total: str | None = None, most: int = 20_000_000) -> DataFrame:
    """The rank that CPython's ``Random(seed).shuffle`` gives the rows in order; ``most`` bounds the driver's list."""
    import random

    dense = running(df, [ord_col], F.lit(0) if df.isEmpty() else ordered_bucket(df, ord_col), None, "_dense")
    n = dense.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for a permutation on the driver; use the portable order")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    ranks = df.sparkSession.createDataFrame([(i + 1, r + 1) for r, i in enumerate(order)], f"_dense long, {name} long")
    out = dense.join(ranks, "_dense").drop("_dense")
    return out.withColumn(total, F.lit(n).cast("long")) if total else out


def ordered_bucket(df: DataFrame, ord_col: str, rows: int = 100_000) -> Column:
    """A bucket that rises with a numeric order column and holds about ``rows`` rows.

    Orders may be dense, spread, or dense within far-apart files: of widths from ``rows`` upwards the
    least is taken whose buckets are not many more than the rows need. Distinct whole numbers that are
    dense somewhere never give more than that width of rows to one bucket.
    """
    at = F.col(ord_col).cast("long")
    widths = [rows * 32**j for j in range(13) if rows * 32**j < 1 << 62]
    # One sketch is one value of the aggregation's buffer; approx_count_distinct would put hundreds of columns there.
    counts = [F.hll_sketch_estimate(F.hll_sketch_agg(F.floor(at / F.lit(w)), 12)).alias(f"w{j}") for j, w in enumerate(widths)]
    found = df.agg(F.count("*").alias("n"), *counts).first()
    most = 64 + 4 * -(-found.n // rows)
    width = next((w for j, w in enumerate(widths) if found[f"w{j}"] <= most), widths[-1])
    return F.floor(at / F.lit(width)).cast("long")
