"""Splits, budgets, caps and fixed samples.

``order``: "portable" ranks by a seeded SHA-256 of the order column; "permutation" repeats CPython's
shuffle (bounded by driver memory). Fractions truncate like ``int`` on double products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coerced, prompt_of, sha256_bucket
from .order import ordered_bucket, permutation_rank, running, shuffled_rank

_RANK = {"portable": shuffled_rank, "permutation": permutation_rank}


def shuffle_split(df: DataFrame, fracs: tuple[float, float, float], seed: int = 42, budget: int | None = None, ord_col: str = "ord", order: str = "portable") -> DataFrame:
    """``df`` with partition (train, validation, test) and rank; rows beyond the budget go.

    With a third fraction of 0 validation takes all that train leaves, else test takes the rest.
    """
    ranked = _RANK[order](df, seed, ord_col, total="_n")
    n = F.col("_n") if budget is None else F.least(F.col("_n"), F.lit(budget))
    share = lambda k: F.floor(n * F.lit(float(fracs[k]))).cast("long")
    val = n if fracs[2] == 0 else share(0) + share(1)
    part = F.when(F.col("rank") <= share(0), "train").when(F.col("rank") <= val, "validation").otherwise("test")
    return ranked.where(F.col("rank") <= n).withColumn("partition", part).drop("_n")


def official_split(df: DataFrame, seed: int = 42, budget: int | None = None, split_col: str = "split", ord_col: str = "ord", order: str = "portable") -> DataFrame:
    """The source's own splits; a budget samples ``train`` only, else its order stays."""
    train, rest = df.where(F.col(split_col) == "train"), df.where(F.col(split_col) != "train")
    at = F.col(ord_col).cast("long")
    if budget is None:
        return df.withColumns({"partition": F.col(split_col), "rank": at})
    kept = _RANK[order](train, seed, ord_col).where(F.col("rank") <= budget)
    return kept.unionByName(rest.withColumn("rank", at)).withColumn("partition", F.col(split_col))


def group_split(df: DataFrame, key: Column, quotas: dict[str, int], seed: int = 42, ord_col: str = "ord") -> DataFrame:
    """Rows by the hash bucket of their group's key, so that no group crosses partitions; each
    partition then keeps a seeded sample of at most its quota. Rows without a key go."""
    if not quotas:
        raise ValueError("group_split needs partitions")
    total, upto, part = sum(quotas.values()), 0, None
    bucket = F.col("_bucket")
    for name, quota in quotas.items():
        upto += quota
        hit = bucket < upto * 1000 // total
        part = F.when(hit, name) if part is None else part.when(hit, name)
    keyed = df.withColumn("_key", coerced(key)).where("_key <> ''").withColumn("_bucket", sha256_bucket("_key"))
    keyed = keyed.withColumn("partition", part).drop("_key", "_bucket")
    ranked = shuffled_rank(keyed, seed, ord_col, by=["partition"])
    allowed = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    return ranked.where(F.col("rank") <= allowed[F.col("partition")])


def token_cap(df: DataFrame, tokens: Column, cap: int, order_col: str = "ord") -> DataFrame:
    """The longest prefix in order whose tokens sum to ``cap`` at most."""
    out = running(df, [order_col], ordered_bucket(df, order_col), tokens, "running_tokens")
    return out.where(F.col("running_tokens") <= cap)


def split_by_groups(df: DataFrame, key: Column, val_frac: float, seed: int) -> DataFrame:
    """``df`` with partition train or validation, whole groups at a time: of the groups in seeded order
    the first int(n * (1 - val_frac)) train."""
    keyed = df.withColumn("_group", key)
    groups = keyed.select("_group").distinct()
    ranked = shuffled_rank(groups, seed, "_group", total="_n")
    cut = F.floor(F.col("_n") * F.lit(1 - val_frac))
    part = ranked.select(F.col("_group").alias("_g"), F.when(F.col("rank") <= cut, "train").otherwise("validation").alias("partition"))
    return keyed.join(part, F.col("_group") == F.col("_g")).drop("_g", "_group")


def split_by_prompt(df: DataFrame, val_frac: float, seed: int, messages: str = "messages") -> DataFrame:
    """Conversations with one prompt stay together."""
    return split_by_groups(df, prompt_of(messages), val_frac, seed)


def prompt_set(df: DataFrame, k: int = 50, seed: int = 2026, ord_col: str = "ord", messages: str = "messages") -> DataFrame:
    """(prompt_index, prompt): k distinct prompts in seeded order of their first appearance."""
    firsts = df.groupBy(prompt_of(messages).alias("prompt")).agg(F.min(ord_col).alias("ord"))
    ranked = shuffled_rank(firsts, seed, "ord").where(F.col("rank") <= k)
    return ranked.select((F.col("rank") - 1).cast("int").alias("prompt_index"), "prompt")


def first_rows(df: DataFrame, k: int, ord_col: str = "ord") -> DataFrame:
    """The first k rows in order."""
    return df.orderBy(ord_col).limit(k)


def leaks(df: DataFrame, key: Column, partition: str = "partition") -> DataFrame:
    """Keys that occur in more than one partition (there should be none)."""
    out = df.groupBy(key.alias("key")).agg(F.min(partition).alias("_a"), F.max(partition).alias("_b"))
    return out.where("_a <> _b").select("key")
