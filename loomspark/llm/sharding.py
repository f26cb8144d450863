"""Sharding: a two-pass external shuffle that leaves the documents in shards, in seeded random order.

Pass 1 scatters every record by seeded hashes: to the shard that wins a rendezvous of
hashes of (doc_id, shard), then to one of the shard's memory-sized buckets by the id and the text. Copies of
one row (of one id, or of none, and one text) that are too many for a bucket get buckets of their own, to which
they are dealt by their place; as they are alike, the result doesn't depend on that. Pass 2
Fisher-Yates shuffles each bucket (``shuffle(array, seed)``) and emits it; a record's slot is
its bucket's offset in the shard plus its place in the shuffled bucket. A shard more takes
records only into itself, as a record moves only if the new shard's hash beats its old winner.

Nulls: a null text has size 8 and the CRC of the empty text; null ids hash as one id. Repeated
rows are kept, each with a slot of its own. An empty table gives no rows. All input columns are
kept; those named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, load, materialize

LAW = "key"
_OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def placed(df: DataFrame, shards: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``df`` with size, text_crc32, law, shard and grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    contest = f"struct(xxhash64({seed}L, `{id_col}`, s) AS h, s AS s)"
    best = f"array_max(transform(sequence(0, {shards - 1}), s -> {contest}))"
    df = df.drop(*[c for c in _OWN if c not in (id_col, text_col)])
    df = df.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "law": F.lit(LAW), "_best": F.expr(best)})
    grown = F.expr(f"if(xxhash64({seed}L, `{id_col}`, {shards}) > _best.h, {shards}, _best.s)")
    return df.withColumns({"shard": F.col("_best.s"), "grown_shard": grown}).drop("_best")


def shard(df: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``df`` with its shard and its slot there, numbered from 0 without gaps.

    bucket_bytes: the mean size of a bucket, which one task holds at a time.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = placed(df, shards, seed, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    rows = rows.withColumn("_who", F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("text_crc32"), F.col("size")))
    rows = rows.withColumn("_bucket", F.pmod("_who", F.lit(buckets).cast("long")).cast("int"))
    keys = ["shard", "_bucket", "_copies", "_part"]
    large = rows.groupBy(*keys[:2]).agg((F.sum("size") - F.max("size")).alias("_bytes")).where(F.col("_bytes") > 4 * bucket_bytes).drop("_bytes")
    if large.limit(1).count():
        inside = join_small(rows, large.withColumn("_large", F.lit(True)), keys[:2]).where("_large")
        copies = inside.groupBy(*keys[:2], "_who").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")).where((F.col("_n") > 1) & (F.col("_bytes") > 4 * bucket_bytes))
        cut = copies.select(*keys[:2], "_who", F.ceil(F.col("_bytes") / F.lit(bucket_bytes)).alias("_parts"))
        part = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")) + 1, F.lit(0)).cast("int")
        apart = F.when(F.col("_parts").isNotNull(), F.col("_who")).otherwise(F.lit(0))
        # Places of rows are fixed by writing them, so that both passes see the same ones.
        rows = materialize(join_small(rows, cut, [*keys[:2], "_who"]).withColumns({"_part": part, "_copies": apart}).drop("_parts"))
    else:
        keys = keys[:2]  # constant keys would hide that the rows are dealt already
    rows = rows.drop("_who")
    payload = [c for c in rows.columns if c not in keys]

    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_from", F.expr(f"coalesce(sum(_n) OVER (PARTITION BY shard ORDER BY {', '.join(keys[1:])} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")).drop("_n")
    # A fixed number of partitions and sorted keys fix the generator's state at each bucket.
    parts = max(1, min(shards * buckets, 20_000))
    held = (
        rows.repartition(parts, *keys)
        .sortWithinPartitions(*keys, id_col, "text_crc32")
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in payload])).alias("_rows"))
        .sortWithinPartitions(*keys)
        .withColumn("_rows", F.expr(f"shuffle(_rows, {seed}L)"))
    )
    # Dealt alike, the offsets meet the buckets where these are.
    out = held.join(offsets.repartition(parts, *keys), keys).select("shard", "_from", F.posexplode("_rows").alias("_at", "_row"))
    return out.select(*[F.col(f"_row.`{c}`") for c in payload], "shard", (F.col("_from") + F.col("_at")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the shards below ``path``, one folder each, a file for what a task holds of a shard; rows are in the
    order of their slots within a file, and no file's slots lie among another's of the same bucket."""
    shard(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to shards 0 to 23 under the law ``key``, and read back from there."""
    written = materialize(shard(load(spark, sf_dir, "documents")).sortWithinPartitions("shard", "slot"), "shard")
    return written.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
