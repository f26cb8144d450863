"""Structured Streaming forms: logs that grow and documents that arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import pystrip
from ..operators.metrics import run_summary


def metrics_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Rows of JSON-lines logs as they are written."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def summarised(stream: DataFrame, run: str, ord_col: str) -> DataFrame:
    """The run summary of all rows so far; write it in mode ``complete``."""
    return run_summary(stream, run, ord_col)


def new_texts(stream: DataFrame, ts: str, text: str = "text", late: str = "1 hour") -> DataFrame:
    """Texts not seen within the watermark, by hash; state older than it is let go."""
    keyed = stream.withWatermark(ts, late).withColumn("_hash", F.sha2(pystrip(F.coalesce(text, F.lit(""))), 256))
    return keyed.dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind, with late ones up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


#: The state store that keeps custom state; set it before a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_PROGRESS = "rows long, first_loss double, best_loss double, best_step long, last_loss double, last_step long, gaps long, repeats long"


class _Progress(StatefulProcessor):
    """What is known of a run, brought up to date by each batch's rows in order; after a while without rows it is told once as stalled."""

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("progress", _PROGRESS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values("ord")
        n, first, best, best_step, last, step, gaps, repeats = self.known.get() if self.known.exists() else (0, None, None, None, None, None, 0, 0)
        for now, loss in zip(some["global_step"].tolist(), some["train_loss"].tolist()):
            loss = None if loss is None or loss != loss else float(loss)
            if step is not None:
                gaps, repeats = gaps + max(0, now - step - 1), repeats + (now <= step)
            if loss is not None:
                first = loss if first is None else first
                if best is None or loss < best:
                    best, best_step = loss, int(now)
                last = loss
            n, step = n + 1, int(now)
        self.known.update((n, first, best, best_step, last, step, int(gaps), int(repeats)))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._told(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, True)

    def _told(self, key, stalled: bool) -> pd.DataFrame:
        names = ["run", *[c.split()[0] for c in _PROGRESS.split(", ")], "stalled"]
        return pd.DataFrame([(key[0], *self.known.get(), stalled)], columns=names)

    def close(self) -> None:
        pass


def progress(stream: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """A row for each run that a batch touches, from a stream of (run string, ord, global_step, train_loss): its rows so far, first,
    best and last loss, steps that were skipped and steps that went back. Rows of a run must arrive in order from batch to
    batch. quiet_ms: after so long without rows a run is told as stalled. Needs the state store ``STATE_STORE``; state is
    kept by run, in the query's checkpoint, so a restart goes on where it stopped."""
    rows = stream.select("run", F.col("ord").cast("long").alias("ord"), F.col("global_step").cast("long").alias("global_step"), F.col("train_loss").cast("double").alias("train_loss"))
    mode = "none" if quiet_ms is None else "processingTime"
    return rows.groupBy("run").transformWithStateInPandas(_Progress(quiet_ms), f"run string, {_PROGRESS}, stalled boolean", "Update", mode)


def progress_of(log: DataFrame) -> DataFrame:
    """What ``progress`` comes to, of a whole log."""
    order = Window.partitionBy("run").orderBy("ord")
    rows = log.withColumn("_before", F.lag("global_step").over(order))
    loss = F.col("train_loss").isNotNull() & ~F.isnan("train_loss")
    at = lambda f, c: f(F.when(loss, F.struct("ord", c))).getField(c)
    best = F.min(F.when(loss, F.struct("train_loss", "ord", "global_step")))
    return rows.groupBy("run").agg(
        F.count("*").alias("rows"),
        at(F.min, "train_loss").alias("first_loss"),
        best.getField("train_loss").alias("best_loss"),
        best.getField("global_step").alias("best_step"),
        at(F.max, "train_loss").alias("last_loss"),
        F.max(F.struct("ord", "global_step")).getField("global_step").alias("last_step"),
        F.sum(F.greatest(F.lit(0), F.coalesce(F.col("global_step") - F.col("_before") - 1, F.lit(0)))).alias("gaps"),
        F.count(F.when(F.col("global_step") <= F.col("_before"), 1)).alias("repeats"),
    )
