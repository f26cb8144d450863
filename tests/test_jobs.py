import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspark.functions.text import record_counter
from loomspark.operators import tokenizer
from loomspark.plans import configs, prepare, specs
from loomspark.plans.govern import govern, govern_all
from loomspark.sources import readers, sinks
from loomspark.streaming import logs


def spec(name="d", limits=None, split=None, **source):
    source = {"files": "d.jsonl", "transform": "tinystories", "schema": "text string", **source}
    return specs.dataset(name, {"provenance": {"license": "l", "revision": "r", "upstream": "u"}, "source": source, "split": split or {"by": "shuffle"}, "limits": limits})


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "b"}\n\n{"text": "a"}\n')
    assert [tuple(r) for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "text string").orderBy("ord").collect()] == [("b", 0), ("a", 1)]
    (tmp_path / "bad.jsonl").write_text('{"text": "b"}\n{broken\n')
    # Spark wraps the error of a file read in one of py4j's.
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "text string").collect()
    (tmp_path / "a.json").write_text('[{"text": "x"}, 5, {"text": "y"}]')
    assert [r.text for r in readers.json_array(spark, str(tmp_path / "a.json"), "text string").orderBy("ord").collect()] == ["x", "y"]
    (tmp_path / "o.json").write_text('{"text": "x"}')
    with pytest.raises(PySparkException):
        readers.json_array(spark, str(tmp_path / "o.json"), "text string").collect()
    (tmp_path / "a.csv").write_text('id,t\n1,"two\nlines, ""q"""\n2,\n')
    assert [(r.id, r.t) for r in readers.csv(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()] == [("1", 'two\nlines, "q"'), ("2", "")]
    (tmp_path / "w.tokens").write_text("one\n two \n")
    assert [r.text for r in readers.text_lines(spark, str(tmp_path / "w.tokens")).orderBy("ord").collect()] == ["one", " two "]
    with pytest.raises(FileNotFoundError):
        readers.matching(spark, str(tmp_path / "none*"))


def test_govern(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"text": f"t{i % 18}"}) + "\n" for i in range(20)) + '{"text": " "}\n')
    out = govern(spark, spec(limits={"records": 15}), str(tmp_path), str(tmp_path / "out"), str(tmp_path / "m"), lambda t: record_counter(t))
    assert (out["raw_records"], out["dedup_removed"], out["records_after_clean"]) == (20, 2, 18)
    assert {k: v["records"] for k, v in out["partitions"].items()} == {"train": 12, "validation": 1, "test": 2}
    assert json.loads((tmp_path / "m/d.json").read_text())["partitions"] == out["partitions"]
    assert spark.read.parquet(str(tmp_path / "out/d/train.parquet")).columns == ["text"]
    assert out["partitions"]["train"]["tokens"] == 12


def test_govern_official_with_cap_and_index(spark, tmp_path):
    (tmp_path / "a.tokens").write_text("".join(f"line number {i:02}\n" for i in range(10)))
    (tmp_path / "b.tokens").write_text("line number 03\nanother line\n")
    s = spec("o", {"tokens": 21}, {"by": "official"}, transform="wikitext", files={"train": ["a.tokens"], "validation": "b.tokens"})
    index = govern_all(spark, [s], str(tmp_path), str(tmp_path / "out"), str(tmp_path / "m"), lambda t: record_counter(t))
    assert index["o"]["partitions"]["train"]["records"] == 3  # 7 tokens a line
    assert index["o"]["partitions"]["validation"]["records"] == 1  # its copy of a train line goes
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out/o/train.parquet")).orderBy("text").collect()] == [f"line number 0{i}" for i in range(3)]


def test_specs_are_strict(tmp_path):
    for split in ({"by": "no"}, {"by": "group_by"}, {"by": "shuffle", "fractions": [0.5, 0.4, 0.3]}, {"by": "official"}, {"by": "shuffle", "x": 1}):
        with pytest.raises(configs.ConfigError):
            spec(split=split)
    for files in ([], {}, 3, {"train": 3}):
        with pytest.raises(configs.ConfigError):
            spec(files=files)
    with pytest.raises(configs.ConfigError):
        configs.checked(configs.PREPARATION, {"corpus": "c", "splits": ["train", "test"]})
    good = {"provenance": {"license": "l", "revision": "r", "upstream": "u"}, "source": {"files": ["b*.csv", "a.csv"], "transform": "ceval"}, "split": {"by": "shuffle"}}
    (tmp_path / "s.json").write_text(json.dumps({"x": good, "y": {**good, "split": {"by": "group_by", "key": "k", "quotas": {"a": 1, "b": 2}}}}))
    found = specs.load_specs(str(tmp_path / "s.json"))
    assert found["x"].split == specs.Shuffled(42, (0.8, 0.1, 0.1)) and found["x"].input_files() == ["a.csv", "b*.csv"] and found["x"].limit("tokens") is None
    assert found["y"].split.partitions(found["y"]) == ["a", "b"]
    (tmp_path / "s.json").write_text(json.dumps({"x": {**good, "more": 1}, "y": {"split": {}}}))
    with pytest.raises(configs.ConfigError) as faults:
        specs.load_specs(str(tmp_path / "s.json"))
    assert len(faults.value.faults) == 4 and "x.more is unknown" in faults.value.faults


def test_prepare(spark, tmp_path):
    rows = [(f"text {i}", f"t{i % 6}") for i in range(22)] + [("text 0", "t0"), ("  ", "t1")]
    spark.createDataFrame(rows, "text string, title string").coalesce(1).write.parquet(str(tmp_path / "law/train.parquet"))
    spark.createDataFrame([("held out",)], "text string").write.parquet(str(tmp_path / "wiki/validation.parquet"))
    vocab = tokenizer.train([("text", 3), (" text", 2)], 262)
    out = prepare.prepare_domain(spark, str(tmp_path), "law", ["train"], "title", 0.2, 1, vocab, {"license": "l"})
    docs = {k: m["docs"] for k, (_, m) in out.items()}
    assert sum(docs.values()) == 22 and docs["train"] > docs["validation"] > 0
    stream, meta = out["train"]
    assert stream.agg(F.max("stream_end")).first()[0] == meta["tokens"]
    n = sinks.write_stream(stream, str(tmp_path / "s.bin"))
    assert n == meta["tokens"] and (tmp_path / "s.bin").stat().st_size == 4 * n
    back = [r.token for r in readers.binary_stream(spark, str(tmp_path / "s.bin")).orderBy("position").collect()]
    assert back == [t for r in stream.orderBy("ord").collect() for t in r.ids]
    (tmp_path / "s.bin").write_bytes(b"12345")
    with pytest.raises(ValueError):
        readers.binary_stream(spark, str(tmp_path / "s.bin")).collect()
    general = prepare.prepare_general(spark, str(tmp_path), ["wiki"], vocab, {"wiki": {"seed": 9}})
    assert general["wiki"][1]["docs"] == 1 and general["wiki"][1]["seed"] == 9
    c = spark.sql("SELECT id AS ord, array(named_struct('role','user','content', concat('p', id % 9)), named_struct('role','assistant','content','text')) AS messages FROM range(20)")
    parts, prompts = prepare.prepare_conversations(c, vocab, 0.3, 1, {})
    assert parts["train"][1]["docs"] + parts["validation"][1]["docs"] == 20 and prompts.count() == 3
    for r in parts["train"][0].collect():
        assert len(r.ids) == len(r.mask) and r.mask[0] == 0 and r.mask[-1] == 1


def test_streaming(spark, tmp_path):
    schema = "run string, ord int, global_step long, train_loss double, tokens_s double, step_time_s double, val_loss double, peak_mem_gb double"
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text('{"run":"a","ord":0,"global_step":0,"train_loss":3.0}\n')
    (tmp_path / "log/2.json").write_text('{"run":"a","ord":1,"global_step":1,"train_loss":2.0,"val_loss":2.5}\n')
    out = logs.summarised(logs.metrics_stream(spark, str(tmp_path / "log"), schema, 1), "run", "ord")
    q = out.writeStream.outputMode("complete").format("memory").queryName("summary").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.table("summary").first()
    assert (row.steps, row.last_train_loss, row.val_train_gap) == (2, 2.0, 0.5)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/1.json").write_text('{"ts":"2024-01-01T00:00:00Z","text":"x"}\n{"ts":"2024-01-01T00:00:01Z","text":" x"}\n{"ts":"2024-01-01T00:00:02Z","text":"y"}\n')
    s = spark.readStream.schema("ts timestamp, text string").json(str(tmp_path / "docs"))
    q = logs.new_texts(s, "ts").writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("texts").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    sinks.append_jsonl(df, str(tmp_path / "l"))
    sinks.append_jsonl(df, str(tmp_path / "l"))
    assert readers.metrics_log(spark, str(tmp_path / "l"), "a int").count() == 2
    sinks.write_json(spark, {"a": "é"}, str(tmp_path / "m.json"))
    assert readers.manifest(spark, str(tmp_path / "m.json")) == {"a": "é"}


def test_resume_guard():
    sinks.resume_guard({"config": 1, "stream": 2}, {"config": 1, "stream": 2})
    with pytest.raises(ValueError):
        sinks.resume_guard({"config": 1}, {"config": 2})
