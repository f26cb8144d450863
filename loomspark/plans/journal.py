"""A journal of a job: what a stage has written is committed by a record, and a rerun goes on behind the last record.

A record holds the job's identity (what it was asked for, and its input files with sizes and times), where the stage's table
lies, its schema and what else the stage found. It is written beside and renamed, so there is a whole one or none. A rerun
with the same identity takes committed tables as they are; tables without a record, and all records of
another identity, are deleted. The tables belong to the journal, which ``finish`` deletes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources import readers, sinks


class Journal:
    def __init__(self, spark: SparkSession, folder: str, identity: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.identity = json.loads(json.dumps(identity, sort_keys=True, default=str))
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.store = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.store.mkdirs(self._path(self.folder))
        self._clean()

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self.store.listStatus(self._path(self.folder))]

    def _clean(self) -> None:
        """Delete what no record of this identity vouches for."""
        names = self._names()
        records = {n: r for n in names if n.endswith(".json") if (r := self.record(n.removesuffix(".json")))}
        kept = set(records) | {r["table"].rsplit("/", 1)[-1] for r in records.values() if r["table"]}
        for n in set(names) - kept:
            self.store.delete(self._path(f"{self.folder}/{n}"), True)

    def record(self, stage: str) -> dict | None:
        """A stage's record, if it is committed under this identity."""
        path = f"{self.folder}/{stage}.json"
        if not self.store.exists(self._path(path)):
            return None
        out = readers.manifest(self.spark, path)
        return out if out["identity"] == self.identity else None

    def _commit(self, stage: str, record: dict) -> None:
        beside = f"{self.folder}/{stage}-{uuid.uuid4().hex}.tmp"
        sinks.write_json(self.spark, {"identity": self.identity, **record}, beside)
        if not self.store.rename(self._path(beside), self._path(f"{self.folder}/{stage}.json")):
            raise RuntimeError(f"the record of {stage} could not be put in place")

    def table(self, stage: str, make: Callable[[], DataFrame], *by: str, found: Callable[[], dict] = dict) -> tuple[DataFrame, dict]:
        """A stage's table, made unless it is committed, and what ``found`` tells once it is written. by: one folder for
        each value of these columns."""
        record = self.record(stage)
        if record is None:
            df, path = make(), f"{self.folder}/{stage}-{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
            record = {"table": path, "schema": df.schema.jsonValue(), "found": found()}
            self._commit(stage, record)
        out = self.spark.read.schema(T.StructType.fromJson(record["schema"])).parquet(record["table"])
        return out, record["found"]

    def value(self, stage: str, make: Callable[[], object]):
        """A stage that comes to a value (as JSON has it), made unless it is committed."""
        record = self.record(stage)
        if record is None:
            record = {"table": None, "found": make()}
            self._commit(stage, record)
        return record["found"]

    def finish(self) -> None:
        self.store.delete(self._path(self.folder), True)


def inputs(spark: SparkSession, paths: list[str]) -> list[list]:
    """(path, bytes, time of change) of input files, as part of an identity."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append([path, status.getLen(), status.getModificationTime()])
    return out
