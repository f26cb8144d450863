"""Sinks: record tables, manifests, logs and flat token streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.packing import stream_stats
from . import flatstream


def write_records(df: DataFrame, path: str, order: str | None = "ord") -> str:
    """Records in order within files, as Parquet, or as JSON lines where Parquet has no type for a column; returns
    the format. JSON lines go to the path with the suffix .jsonl in place of .parquet."""
    out = df.sortWithinPartitions(order) if order and order in df.columns else df
    if any(_untyped(f.dataType) for f in df.schema.fields):
        out.write.mode("overwrite").json(path.removesuffix(".parquet") + ".jsonl")
        return "jsonl"
    out.write.mode("overwrite").parquet(path)
    return "parquet"


def _untyped(kind: T.DataType) -> bool:
    """Whether Parquet can't store a type: void, structs without fields, and what holds them."""
    if isinstance(kind, T.StructType):
        return not kind.fields or any(_untyped(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _untyped(kind.elementType)
    return isinstance(kind, T.NullType | T.CalendarIntervalType) if not isinstance(kind, T.MapType) else _untyped(kind.valueType)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document as a file, in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows behind those of a JSON-lines log."""
    df.write.mode("append").json(path)


def write_stream(docs: DataFrame, path: str, ids_col: str = "ids", item: str = "i4", ord_col: str = "ord", layout: str = "file") -> int:
    """The documents' ids in order as one flat stream, committed when all of it is written (see ``flatstream``); returns
    the number of items that the stream then holds."""
    spark = docs.sparkSession
    flatstream.register(spark)
    ranges = docs.repartitionByRange(ord_col).sortWithinPartitions(ord_col).select(F.col("stream_start").cast("long").alias("stream_start"), F.col(ids_col).alias("ids"))
    ranges.write.format(flatstream.NAME).options(path=path, item=item, layout=layout).mode("overwrite").save()
    return sum(n for _, n in flatstream.layout_of(path, item))


def stream_meta(docs: DataFrame, source: dict, **more) -> dict:
    """What a stream was made of: counts of the documents (ids and, if there, mask) and the source's provenance."""
    row = stream_stats(docs).first().asDict()
    return {k: source.get(k) for k in ("license", "revision", "upstream")} | row | more


def dataset_index(manifests: list[dict]) -> dict:
    """Name to licence, revision and counts."""
    keep = ("license", "revision", "raw_records", "dedup_removed", "partitions")
    return {m["dataset"]: {k: m[k] for k in keep} for m in manifests}


def resume_guard(saved: dict, current: dict, keys: tuple[str, ...] = ("config", "stream")) -> None:
    """A run resumes only with the configuration and streams that it was saved with."""
    for key in keys:
        if saved.get(key) != current.get(key):
            raise ValueError(f"cannot resume: {key} differs from the saved one")

