import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import numeric, text
from loomspark.operators import metrics

SPACES = ["", "  a b ", "　x ", "\x1ca\x1f", "\xa0\n\t", "a​b", "\x85z "]


def one(spark, column, **values):
    rows = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return rows.select(column.alias("x")).first().x


def test_strip_and_split_follow_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SPACES)], "i int, s string")
    for row in df.select("s", text.pystrip("s").alias("a"), text.pysplit("s").alias("b")).collect():
        assert row.a == row.s.strip() and row.b == row.s.split()


def test_falsy_coercion(spark):
    df = spark.createDataFrame([(0, "0"), (7, None), (None, " x ")], "n int, s string")
    assert [tuple(r) for r in df.select(text.coerced("n", True), text.coerced("s")).collect()] == [("", "0"), ("7", ""), ("", "x")]


def test_hash_bucket(spark):
    keys = [f"k{i}é" for i in range(60)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", text.sha256_bucket("k").alias("b")).collect()
    assert all(r.b == int(hashlib.sha256(r.k.encode()).hexdigest(), 16) % 1000 for r in got)


@pytest.mark.parametrize("words,want", [(" ".join(["a"] * 15), 1 / 12), (" ".join(f"w{i}" for i in range(14)), 1.0), ("one two", 0.0)])
def test_ngram_ratio(spark, words, want):
    assert one(spark, text.ngram_ratio("t"), t=words) == pytest.approx(want)


def test_texts_of_nested_records(spark):
    df = spark.sql("SELECT array(named_struct('role', 'user', 'content', '你好'), named_struct('role', 'assistant', 'content', '世界')) AS messages, 5 AS n")
    got = df.select(text.texts_of(df.schema).alias("t"), text.chars_of(text.texts_of(df.schema)).alias("n")).first()
    assert got.t == ["user", "你好", "assistant", "世界"] and got.n == 17


def test_softmax_and_top_k(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 3.0],)], "l array<double>")
    p = df.select(numeric.softmax("l", 0.5).alias("p")).first().p
    e = [math.exp((x - 3) / 0.5) for x in (1, 2, 3, 3)]
    assert p == pytest.approx([x / sum(e) for x in e])
    tied = df.select(numeric.top_k_filter(numeric.softmax("l"), 1).alias("p")).first().p
    assert tied == pytest.approx([0, 0, 0.5, 0.5])  # ties at the threshold stay
    assert df.select(numeric.top_k_filter(numeric.softmax("l"), 9).alias("p")).first().p == pytest.approx(df.select(numeric.softmax("l").alias("p")).first().p)
    with pytest.raises(ValueError):
        numeric.top_k_filter("l", 0)
    with pytest.raises(ValueError):
        numeric.softmax("l", 0)


def test_sample_next(spark):
    df = spark.createDataFrame([([0.0, 0.0, 5.0, 5.0], 0.999999)], "l array<double>, d double")
    assert df.select(numeric.sample_next("l", "d", 0).alias("i")).first().i == 2
    assert df.select(numeric.sample_next("l", "d", 1.0).alias("i")).first().i == 3
    assert df.select(numeric.sample_next("l", F.lit(0.0), 1.0, top_k=2).alias("i")).first().i == 0  # 0 <= 0 at once
    assert df.select(numeric.sample_next("l", F.lit(0.3), 1.0, top_k=2).alias("i")).first().i == 2


def test_schedule(spark):
    at = {r.id: r.lr for r in spark.range(1100).select("id", numeric.warmup_cosine("id", 1000, 100, 1.0, 0.1).alias("lr")).collect()}
    assert at[0] == pytest.approx(0.01) and at[99] == pytest.approx(1.0) and at[100] == pytest.approx(1.0)
    assert at[550] == pytest.approx(0.55) and at[1000] == at[1099] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        numeric.warmup_cosine("id", 10, 10, 1.0, 0.1)


def test_mfu_and_counts(spark):
    assert one(spark, numeric.mfu(F.lit(38e12), F.lit(380e12), F.lit(1.0))) == pytest.approx(0.1)
    assert one(spark, numeric.mfu(F.lit(0.0), F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, numeric.scaled_tokens(F.lit(5), F.lit(1), F.lit(2))) == 2  # 2.5 rounds to even
    assert one(spark, numeric.scaled_tokens(F.lit(5), F.lit(1), F.lit(0))) == 0
    assert one(spark, numeric.sequences_for(F.lit(1025), F.lit(512))) == 3


def test_adapter_sizing(spark):
    shapes = [("q_proj", 1024, 2048), ("k_proj", 1024, 1024), ("v_proj", 1024, 1024), ("o_proj", 2048, 1024)]
    dims = spark.createDataFrame(shapes, "module string, d_in int, d_out int")
    assert metrics.adapter_params(dims, 28, 1).first().lora_params == 286_720
    best = metrics.recommend_rank(dims, 28, 5_000_000).where("chosen").first()
    assert (best["rank"], best.target) == (1, 250_000)
