"""Token streams: framed documents, offsets, fixed blocks, shifted labels and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ordered_bucket, running


def framed(ids: Column | str, bos: int, eos: int) -> Column:
    """[bos, ids, eos]."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def stream_offsets(df: DataFrame, ids_col: str = "ids", ord_col: str = "ord") -> DataFrame:
    """``df`` with start and end of each document in the stream in order (end is exclusive)."""
    size = F.size(ids_col).cast("long")
    out = running(df, [ord_col], ordered_bucket(df, ord_col), size, "stream_end")
    return out.withColumn("stream_start", F.col("stream_end") - size)


def block_offsets(df_spark, stream_length: int, block: int, n: int, seed: int) -> DataFrame:
    """(block_id, offset): n seeded offsets in [0, length - block - 1], with repetition, the same in each run."""
    rows = list(enumerate(BlockSampler(stream_length, block, seed).offsets(n)))
    return df_spark.createDataFrame(rows, "block_id long, offset long")


class BlockSampler:
    """Seeded block offsets in [0, length - block - 1], with repetition, whose state can be saved and restored."""

    def __init__(self, stream_length: int, block: int, seed: int):
        import random

        if stream_length <= block:
            raise ValueError("the stream must be longer than a block")
        self.last, self.rng = stream_length - block - 1, random.Random(seed)

    def offsets(self, n: int) -> list[int]:
        return [self.rng.randint(0, self.last) for _ in range(n)]

    def state(self) -> list:
        """Plain lists, fit for JSON."""
        kind, numbers, gauss = self.rng.getstate()
        return [kind, list(numbers), gauss]

    def restore(self, state: list) -> None:
        kind, numbers, gauss = state
        self.rng.setstate((kind, tuple(numbers), gauss))


def spread_offsets(df_spark, stream_length: int, block: int, every: int, seed: int) -> DataFrame:
    """(block_id, offset): an offset for each ``every`` tokens of the stream, uniform in [0, length - block - 1]
    with repetition, by SHA-256 of seed and block_id; made in parallel, so their number may grow with the stream."""
    if stream_length <= block:
        raise ValueError("the stream must be longer than a block")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")), 256), 1, 15), 16, 10).cast("long")
    return df_spark.range((stream_length - 1) // every + 1).select(F.col("id").alias("block_id"), (drawn % F.lit(stream_length - block)).alias("offset"))


def blocks(docs: DataFrame, offsets: DataFrame, block: int, ids_col: str = "ids", mask_col: str | None = None, cell: int = 4096) -> DataFrame:
    """(block_id, input, label): slices of the stream at the offsets, labels one token further.

    Documents (with stream_start, stream_end) and blocks meet in cells of the stream, an equi-join;
    a block that spans documents gathers their pieces, block + 1 tokens at most. With a mask,
    labels under a 0 become -100.
    """
    doc_cells = F.explode(F.sequence(F.floor(F.col("stream_start") / cell), F.floor((F.col("stream_end") - 1) / cell)))
    d = docs.where("stream_end > stream_start").select("stream_start", "stream_end", ids_col, *([mask_col] if mask_col else []), doc_cells.alias("_cell"))
    o = offsets.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("offset") / cell), F.floor((F.col("offset") + block) / cell))))
    met = d.join(o, "_cell").where((F.col("offset") < F.col("stream_end")) & (F.col("offset") + block >= F.col("stream_start")))
    # A pair that meets in several cells counts in the first common one.
    met = met.where(F.col("_cell") == F.greatest(F.floor(F.col("offset") / cell), F.floor(F.col("stream_start") / cell)))
    begin = F.greatest(F.col("offset"), F.col("stream_start"))
    until = F.least(F.col("offset") + block + 1, F.col("stream_end"))
    at, n = (begin - F.col("stream_start") + 1).cast("int"), (until - begin).cast("int")
    piece = [begin.alias("at"), F.slice(ids_col, at, n).alias("ids")] + ([F.slice(mask_col, at, n).alias("mask")] if mask_col else [])
    whole = met.select("block_id", "offset", F.struct(*piece).alias("p")).groupBy("block_id", "offset").agg(F.sort_array(F.collect_list("p")).alias("p"))
    tokens = F.flatten(F.transform("p", lambda x: x.ids))
    out = whole.withColumn("_t", tokens)
    label = F.slice("_t", 2, block)
    if mask_col:
        mask = F.slice(F.flatten(F.transform("p", lambda x: x.mask)), 2, block)
        label = F.zip_with(label, mask, lambda t, m: F.when(m == 0, F.lit(-100)).otherwise(t))
    return out.select("block_id", "offset", F.slice("_t", 1, block).alias("input"), label.alias("label"))


def stream_stats(docs: DataFrame, ids_col: str = "ids", mask_col: str = "mask") -> DataFrame:
    """One row: docs, tokens and, with a mask, assistant_tokens."""
    masked = [F.coalesce(F.sum(F.aggregate(mask_col, F.lit(0).cast("long"), lambda n, m: n + m)), F.lit(0)).alias("assistant_tokens")] if mask_col in docs.columns else []
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(ids_col)), F.lit(0)).alias("tokens"), *masked)


def flat_stream(docs: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(position, token): the stream one token a row."""
    return docs.select("stream_start", F.posexplode(ids_col).alias("_i", "token")).select((F.col("stream_start") + F.col("_i")).alias("position"), "token")
