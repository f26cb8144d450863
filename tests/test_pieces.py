"""JSON arrays and CSV files cut into ranges at every place, and one scan for all files."""

import csv
import json
import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from loomspark.sources import pieces, readers


@pytest.fixture
def small_ranges(spark):
    """Ranges of so many bytes that they cut strings, escapes and fields."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def put(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], str(n))
        spark.conf.set(keys[2], "100000")

    yield put
    for k in keys:
        spark.conf.unset(k)


ITEMS = [{"text": 'a "quoted" } { brace', "n": [1, {"deep": "}"}]}, 5, "str }", {"text": "back\\slash\\\\"}, [{"text": "inner"}], None, {"text": "é漢😀\n tab\t"}, {"text": "", "n": [{"x": "[{"}]}, {}]


@pytest.mark.parametrize("n", [5, 33])
def test_json_arrays_at_every_cut(spark, tmp_path, small_ranges, n):
    texts = [json.dumps(ITEMS), json.dumps(ITEMS, indent=1, ensure_ascii=False), " [ ] ", '[{"text": "one"}]', "[1, 2]", '[ 3 , {"text":"x"} , 4 ]\n']
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    small_ranges(n)
    got = [tuple(r) for r in readers.json_array(spark, str(tmp_path / "*.json"), "text string").orderBy("ord").select("ord", "text").collect()]
    want = [x.get("text") for t in texts for x in json.loads(t) if isinstance(x, dict)]
    assert got == list(enumerate(want))


@pytest.mark.parametrize("bad", ['{"text": "x"}', '[{"text": "x"}', '[{"text": "x"} {"text": "y"}]', '[{"text": "x"}] 5', '[{"text": x}]', "[1 2]", '[{"a": 1},]', "5", '["{"a": 1}]'])
def test_faulty_json_raises(spark, tmp_path, bad):
    (tmp_path / "x.json").write_text(bad)
    with pytest.raises(Exception, match="Error"):
        readers.json_array(spark, str(tmp_path / "x.json"), "text string").collect()


def test_csv_at_every_cut(spark, tmp_path, small_ranges):
    rnd = random.Random(6)
    alphabet = ["a", ",", '"', "\n", "\r\n", "é", " ", "", "x,y", '""', "\n\n"]
    rows = [["".join(rnd.choices(alphabet, k=rnd.randint(0, 5))) for _ in range(3)] for _ in range(10)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, quoting=csv.QUOTE_ALL).writerows([["p", "q", "r"], *rows])
    odd = 'q,z\n1,st"ray "quo"tes\n\n"a"b,"c\nd"e\n2\n3,4,5\n\r\n"last","no\nend of line"'
    (tmp_path / "b.csv").write_bytes(odd.encode())
    want = [dict(zip("pqr", r)) for r in rows]
    with open(tmp_path / "b.csv", newline="", encoding="utf-8") as f:
        want += [{k: v or "" for k, v in r.items() if k} for r in csv.DictReader(f)]
    for n in (6, 4000):
        small_ranges(n)
        got = [r.asDict() for r in readers.csv(spark, str(tmp_path)).orderBy("ord").collect()]
        assert [r.pop("ord") for r in got] == list(range(len(want))) and [{k: v for k, v in r.items()} for r in got] == [{**dict.fromkeys("pqrz", ""), **w} for w in want], n
    some = readers.csv(spark, str(tmp_path), ["z", "p", "none"], ordered=False)
    assert some.columns == ["z", "p", "none"] and some.count() == len(want) and some.where("none <> ''").count() == 0
    (tmp_path / "c.csv").write_text('h\n"never ends\nx\n')
    with pytest.raises(Exception, match="never ends"):
        readers.csv(spark, str(tmp_path / "c.csv")).collect()


def test_walks_agree_with_parsers():
    rnd = random.Random(9)
    for _ in range(2000):
        line = "".join(rnd.choices('ab,"', k=rnd.randint(0, 8)))
        for inside in (False, True):
            rest = list(csv.reader([('"' if inside else "") + line + "\n", 'z"\n']))
            assert pieces.CsvRows.walk(line, inside) == (len(rest) == 1), (line, inside)
    whole = json.dumps(ITEMS)
    for i in range(len(whole)):
        a, d = pieces.JsonObjects.walk(whole[:i], 0)
        b, e = pieces.JsonObjects.walk(whole[i:], a)
        assert (b, d + e) == (0, 0)


def test_one_scan_for_all_files(spark, tmp_path):
    (tmp_path / "b two.jsonl").write_text('{"text": "b0"}\n{"text": "b1"}\n')
    (tmp_path / "a+1%20.jsonl").write_text('{"text": "a0"}\n')
    (tmp_path / "c.json").write_text('[{"text": "c0"}, 4, {"text": "c1"}]')
    (tmp_path / "d.csv").write_text('text,more\n"d\n0",1\nd1,2\n')
    (tmp_path / "e.tokens").write_text("e0\ne1\n")
    spark.createDataFrame([("f0", 1)], "text string, more2 int").write.parquet(str(tmp_path / "f.parquet"))
    patterns = {"train": ("*.jsonl", "c.json"), "test": ("d.csv", "e.tokens", "f.parquet", "a*.jsonl")}
    got = readers.load_raw(spark, str(tmp_path), patterns, "text string", None).orderBy("ord")
    want = [("train", t) for t in ("a0", "b0", "b1", "c0", "c1")] + [("test", t) for t in ("d\n0", "d1", "e0", "e1", "f0", "a0")]
    assert [(r.split, r.text) for r in got.collect()] == want and [r.ord for r in got.collect()] == list(range(11))
    with pytest.raises(FileNotFoundError):
        readers.load_raw(spark, str(tmp_path), {None: ("none*",)}, "text string")


def test_many_files_plan_like_one(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i in range(1000):
        (tmp_path / f"many/{i:04}.jsonl").write_text(json.dumps({"text": f"t{i}"}) + "\n")
    (tmp_path / "one.jsonl").write_text('{"text": "x"}\n')
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    began = time.monotonic()
    many = readers.load_raw(spark, str(tmp_path), {None: ("many/*.jsonl",)}, "text string")
    planned = joins(many)
    assert time.monotonic() - began < 20  # 3 s on a machine of its own
    assert planned == joins(readers.load_raw(spark, str(tmp_path), {None: ("one.jsonl",)}, "text string"))
    assert [r.text for r in many.orderBy("ord").collect()] == [f"t{i}" for i in range(1000)]


@pytest.mark.parametrize("rows,each", [(10_000, 3000), (3, 400_000)])
def test_python_holds_few_pieces(rows, each):
    """Of a batch of pieces, however many and long, few are objects at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array(["file:/x"] * rows), pa.array([0] * rows), pa.array(["x" * each] * rows)], names=["path", "block", "value"])
    tracemalloc.start()
    try:
        for _, _, some in pieces._ranges_of(iter([batch])):
            assert sum(len(x) for x in some) == rows * each
        assert tracemalloc.get_traced_memory()[1] < 3_000_000  # all at once: 30 MB and more
    finally:
        tracemalloc.stop()


def test_slices_lose_nothing():
    rnd = random.Random(2)
    texts = [rnd.choice([None, "", "é" * rnd.randint(0, 30), "x" * 90]) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["i", "text"])
    some = list(pieces.few(iter([batch.slice(0, 0), batch.slice(7), batch.slice(0, 1)]), 1, 64))
    assert [x for s in some for x in s.column(1).to_pylist()] == [*texts[7:], texts[0]]
    assert all(s.num_rows == 1 or sum(len((x or "").encode()) for x in s.column(1).to_pylist()) <= 64 for s in some)
    assert max(s.num_rows for s in pieces.few(iter([batch]), 1)) == 1000
