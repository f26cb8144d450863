"""State of runs in a stream, across a restart, against the batch form."""

import json
import time

from pyspark.sql import functions as F

from loomspark.streaming import logs

SCHEMA = "run string, ord long, global_step long, train_loss double"


def rows_of():
    out, order = [], 0
    for step, loss in [(0, 5.0), (1, 4.0), (2, None), (5, 3.0), (6, 3.5), (4, 3.0), (5, 2.5), (6, 2.5), (9, 2.75)]:
        for run in ("a", "b") if step != 5 else ("a",):
            out.append({"run": run, "ord": order, "global_step": step, "train_loss": None if loss is None else loss + (run == "b")})
            order += 1
    return out


def test_restart_in_the_middle(spark, tmp_path):
    spark.conf.set(*logs.STATE_STORE)
    rows, seen = rows_of(), {}
    (tmp_path / "log").mkdir()

    def run():
        stream = logs.metrics_stream(spark, str(tmp_path / "log"), SCHEMA, 1)
        keep = lambda df, _: seen.update({r.run: r for r in df.collect()})
        q = logs.progress(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    for k, (a, b) in enumerate([(0, 3), (3, 7), (7, 12), (12, len(rows))]):
        part = rows[a:b][::-1]  # within a batch, order is made
        (tmp_path / f"log/{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        if k in (1, 3):
            run()
    batch = {r.run: r for r in logs.progress_of(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).collect()}
    assert {k: tuple(v)[:-1] for k, v in seen.items()} == {k: tuple(v) for k, v in batch.items()} and not any(r.stalled for r in seen.values())
    assert (batch["a"].gaps, batch["a"].repeats, batch["a"].best_loss, batch["a"].best_step) == (4, 1, 2.5, 5)
    spark.conf.unset(logs.STATE_STORE[0])


def test_stalled_runs_are_told_once(spark, tmp_path):
    spark.conf.set(*logs.STATE_STORE)
    (tmp_path / "log").mkdir()
    (tmp_path / "log/0.json").write_text(json.dumps(rows_of()[0]) + "\n")
    told = []
    q = logs.progress(logs.metrics_stream(spark, str(tmp_path / "log"), SCHEMA, 1), quiet_ms=1000).writeStream.outputMode("update").foreachBatch(lambda df, _: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    until = time.monotonic() + 90
    while time.monotonic() < until and not any(r.stalled for r in told):
        time.sleep(1)
    time.sleep(3)
    q.stop()
    assert [(r.run, r.rows, r.stalled) for r in told] == [("a", 1, False), ("a", 1, True)]
    spark.conf.unset(logs.STATE_STORE[0])
    assert logs.progress_of(spark.createDataFrame([], SCHEMA)).agg(F.count("*")).first()[0] == 0
