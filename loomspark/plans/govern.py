"""Governing a dataset: scan, transform, dedupe, split, write, manifest."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chars_of, texts_of
from ..operators.dedup import dedupe_records
from ..operators.metrics import partition_stats
from ..operators.splits import token_cap
from ..operators.transforms import TRANSFORMS
from ..sources.readers import files_below, load_raw, matching
from ..sources.sinks import dataset_index, write_json, write_records
from ..storage import shared_dir
from .journal import Journal, inputs
from .specs import Dataset

#: Columns that carry a row through; they are no part of the record.
OWN = ("split", "ord", "partition", "rank")


def payload(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in OWN])


def assign(df: DataFrame, spec: Dataset, counter: Column | None = None, order: str = "portable") -> DataFrame:
    """Partition and rank of each record under the spec; ``counter`` counts a record's tokens."""
    split, cap = spec.split, spec.limit("tokens")
    out = split.deal(df, spec.limit("records"), order)
    if cap is None or counter is None or not split.capped:
        return out
    train = token_cap(out.where("partition = 'train'"), counter, cap, "rank").drop("running_tokens")
    return train.unionByName(out.where("partition <> 'train'"))


def govern(spark: SparkSession, spec: Dataset, raw_root: str, out_root: str, manifest_dir: str, counter=None, order: str = "portable", journal: str | None = None) -> dict:
    """Run one dataset; returns its manifest. ``counter``: array of texts to a column of token counts.

    What is clean is written once, and once more by partition, in a journal's folder; raw rows are counted on the way. A run that
    breaks off is taken up by the next one with the same ``journal`` where it stopped.
    """
    source, split = spec.told["source"], spec.split
    files = [f for globs in spec.files.values() for g in globs for p in matching(spark, f"{raw_root}/{g}") for f in files_below(spark, p)]
    identity = {"dataset": spec.name, "told": spec.told, "order": order, "counted": counter is not None, "out": out_root, "inputs": inputs(spark, files)}
    job = Journal(spark, journal or f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}", identity)
    seen = Observation()
    records = lambda: TRANSFORMS[source["transform"]](load_raw(spark, raw_root, spec.files, source["schema"], source["columns"]))

    def cleaned() -> DataFrame:
        rows = records()
        return dedupe_records(rows.observe(seen, F.count(F.lit(1)).alias("n")), payload(rows).names, ["ord"])

    clean, counts = job.table("clean", cleaned, found=lambda: {"raw": seen.get["n"]})
    fields = payload(clean)
    texts = texts_of(fields)
    tokens = None if counter is None else counter(texts)
    raw_count, clean_count = counts["raw"], clean.count()
    parts, _ = job.table("parts", lambda: assign(clean, spec, tokens, order), "partition")
    stats = [Row(**r) for r in job.value("stats", lambda: [r.asDict() for r in partition_stats(parts, split.partitions(spec), tokens, chars_of(texts)).collect()])]
    partitions = {}
    for row in stats:
        if not row.records:
            partitions[row.partition] = {"records": 0, "tokens": None, "chars": 0}
            continue
        some = parts.where(F.col("partition") == row.partition).select(*fields.names)
        kind = job.value(f"written-{row.partition}", lambda: write_records(some, f"{out_root}/{spec.name}/{row.partition}.parquet", None))  # noqa: B023
        partitions[row.partition] = {"records": row.records, "tokens": row.tokens, "chars": row.chars, "format": kind}
    told, cap = spec.told, spec.limit("tokens")
    out = {
        "dataset": spec.name,
        **{k: told["provenance"][k] for k in ("license", "revision", "upstream")},
        "seed": told["split"]["seed"],
        "split_strategy": told["split"]["by"],
        "processed_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "input_files": spec.input_files(),
        "raw_records": raw_count,
        "dedup_removed": raw_count - clean_count,
        "records_after_clean": clean_count,
        "budget": spec.limit("records"),
        "token_cap": cap,
        # A cap counts tokens, so without a counter it has no effect.
        "token_cap_applied": cap is not None and counter is not None and split.capped,
        "partitions": partitions,
        "notes": told["provenance"]["notes"],
    }
    write_json(spark, out, f"{manifest_dir}/{spec.name}.json")
    job.finish()
    return out


def govern_all(spark: SparkSession, specs: list[Dataset], raw_root: str, out_root: str, manifest_dir: str, counter=None) -> dict:
    """Run datasets one after the other; returns and writes the index."""
    index = dataset_index([govern(spark, s, raw_root, out_root, manifest_dir, counter) for s in specs])
    write_json(spark, index, f"{manifest_dir}/index.json")
    return index
