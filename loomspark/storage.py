"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[Tables | None] = ContextVar("loomspark-tables", default=None)


class Tables:
    """Owns the tables that ``materialize`` makes in its block, in the caller's thread: what it still owns at the
    block's end, by an error too, is deleted. Blocks may lie within each other; other callers' tables are never touched.

        with Tables(spark) as own:
            result = own.release(materialize(...))
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        self._token = _owner.set(self)
        return self

    def __exit__(self, *error) -> None:
        _owner.reset(self._token)
        for path in list(self.paths):
            _delete(self.spark, path)
        self.paths.clear()

    def release(self, df: DataFrame) -> DataFrame:
        """Leave a table to whoever is around the block, or to nobody."""
        path = getattr(df, "_loom_path", None)
        if path in self.paths:
            self.paths.remove(path)
            outer = self._token.old_value
            if isinstance(outer, Tables):
                outer.paths.append(path)
        return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder of its own; on a cluster that is an error, as no folder of one machine is seen by the others.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc = spark.sparkContext
    if not hasattr(sc, "_loom_dir"):
        sc._loom_dir = tempfile.mkdtemp(prefix="loomspark-")
    return sc._loom_dir


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, cutting its lineage; by: one folder for
    each value of these columns.

    The table survives the loss of any executor; its schema is the written one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return adopted(spark.read.schema(df.schema).parquet(path), path)


def adopted(df: DataFrame, path: str) -> DataFrame:
    """A table that lies at ``path``, known to its owner and to ``drop_table``."""
    if owner := _owner.get():
        owner.paths.append(path)
    df._loom_path = path
    return df


def drop_table(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` made and that nothing reads any more; None and others are left alone."""
    for df in tables:
        path = getattr(df, "_loom_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    owner = _owner.get()
    if owner and path in owner.paths:
        owner.paths.remove(path)
