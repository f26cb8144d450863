"""Committed flat streams: empty documents, broken runs, retried attempts, both layouts."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.operators.packing import stream_offsets
from loomspark.sources import flatstream, readers, sinks


def stream(spark, sizes, parts=4):
    rows = [(i, list(range(100 * i, 100 * i + n))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "ord long, ids array<int>").repartition(parts)
    return stream_offsets(df), [x for _, ids in rows for x in ids]


def held(path):
    return np.fromfile(path, "<i4").tolist()


@pytest.mark.parametrize("layout", ["file", "parts"])
def test_empty_documents_in_many_partitions(spark, tmp_path, layout):
    path = str(tmp_path / "s.bin")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs, want = stream(spark, [0] * 20 + [3] * 20 + [0] * 21 + [1, 2, 3] * 6 + [0])
        assert sinks.write_stream(docs, path, layout=layout) == len(want) == 96
        none, _ = stream(spark, [0, 0, 0])
        assert sinks.write_stream(none, str(tmp_path / "none"), layout=layout) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for n in (1, 7, 1000):
        rows = readers.binary_stream(spark, path, range_items=n).orderBy("position").collect()
        assert [tuple(r) for r in rows] == list(enumerate(want))
    assert readers.binary_stream(spark, str(tmp_path / "none")).count() == 0
    blocks = readers.stream_blocks(spark, path, spark.createDataFrame([(k, k) for k in range(0, 91)], "block_id long, offset long"), 5).collect()
    assert len(blocks) == 91 and all(b.input == want[b.offset : b.offset + 5] and b.label == want[b.offset + 1 : b.offset + 6] for b in blocks)
    with pytest.raises(Exception, match="beyond the stream"):
        readers.stream_blocks(spark, path, spark.createDataFrame([(0, 91)], "block_id long, offset long"), 5).collect()
    if layout == "file":
        assert os.path.getsize(path) == 4 * 96 and held(path) == want
        assert os.listdir(tmp_path) == ["none", "s.bin"] or sorted(x for x in os.listdir(tmp_path) if not x.endswith(".crc")) == ["none", "s.bin"]


def test_a_broken_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s.bin")
    docs, want = stream(spark, [2] * 30)
    assert sinks.write_stream(docs, path) == 60
    breaks = docs.withColumn("ids", F.when(F.col("ord") == 25, F.raise_error(F.lit("lost")).cast("array<int>")).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_stream(breaks, path)
    assert held(path) == want
    os.makedirs(tmp_path / "s.bin.run-of-another", exist_ok=True)
    (tmp_path / "s.bin.run-of-another/0000").write_bytes(b"\1\2\3\4" * 5)
    shorter, less = stream(spark, [1] * 7)
    assert sinks.write_stream(shorter, path) == 7 and held(path) == less


def test_attempts_and_commits(tmp_path):
    """A retried attempt, one that failed half-way and a task without rows: only what was told is committed."""
    path = str(tmp_path / "s.bin")
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["stream_start", "ids"])
    w = flatstream.Writer(path, "i4", "file")

    def breaks():
        yield batch((3, [4, 5]))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        w.write(breaks())
    first = w.write(iter([batch((0, [1, 2, 3]), (3, []))]))
    w.write(iter([batch((3, [4, 5]))]))  # a speculative attempt that is not told
    second = w.write(iter([batch((3, [4, 5])), batch((5, []), (5, [6]))]))
    w.commit([second, w.write(iter([])), first, w.write(iter([batch((6, []))])), None])
    assert held(path) == [1, 2, 3, 4, 5, 6] and sorted(os.listdir(tmp_path)) == ["s.bin"]
    for faulty in ([second], [first, first, second]):
        again = flatstream.Writer(path, "i4", "file")
        with pytest.raises(ValueError):
            again.commit(faulty)
        again.abort(faulty)
    with pytest.raises(ValueError):
        w.write(iter([batch((0, [1]), (2, [1]))]))
    with pytest.raises(ValueError):
        flatstream.Writer(path, "i1", "file").write(iter([batch((0, [300]))]))
    assert held(path) == [1, 2, 3, 4, 5, 6]


def test_index_is_checked(spark, tmp_path):
    path = str(tmp_path / "s")
    docs, want = stream(spark, [5] * 8)
    assert sinks.write_stream(docs, path, layout="parts") == len(want)
    index = json.loads((tmp_path / "s/index.json").read_text())
    assert sorted(os.listdir(path)) == sorted(["index.json", *(p["file"] for p in index["parts"])])
    with pytest.raises(ValueError):
        readers.stream_length(spark, path, "i1")
    with open(f"{path}/{index['parts'][0]['file']}", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        readers.stream_length(spark, path)
    with pytest.raises(FileNotFoundError):
        readers.stream_length(spark, str(tmp_path / "no"))
