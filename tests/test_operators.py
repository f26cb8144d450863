import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspark import queries
from loomspark.operators import chat, dedup, metrics, packing, splits, tokenizer, transforms
from loomspark.operators.order import running
from loomspark.operators.overlap import overlap


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("text "), "id").alias("text"))


def test_transforms(spark):
    a = spark.createDataFrame([(" do ", "", "done"), ("do", "this", "done"), ("", "x", "y"), ("x", None, " ")], "instruction string, input string, output string")
    got = [[(m.role, m.content) for m in r.messages] for r in transforms.alpaca(a).collect()]
    assert got == [[("user", "do"), ("assistant", "done")], [("user", "do\n\nthis"), ("assistant", "done")]]
    g = spark.createDataFrame([("q", "1 #### 1"), ("q", "1")], "question string, answer string")
    assert rows(transforms.worked_answer(g)) == [("q", "1 #### 1")]
    c = spark.createDataFrame([("q?", [" a ", "", "b"], 1), (None, ["z"], 0)], "query string, label array<string>, human_or_machine int")
    assert rows(transforms.chart_question(c)) == [("q?", "a, b", "swift", 1)]
    h = spark.createDataFrame([("act", "ctx", ["e"], 0), ("act", "ctx", None, 2)], "activity_label string, ctx string, endings array<string>, label int")
    assert rows(transforms.completion(h)) == [("act", "ctx", ["e"], ""), ("act", "ctx", [], "2")]
    t = spark.createDataFrame([("123456789",), (" 1234567890\n",), (None,)], "text string")
    assert rows(transforms.long_text(t)) == [("1234567890",)]
    p = spark.createDataFrame([("i", "c", "r"), ("i", "", "r")], "instruction string, chosen string, rejected string")
    assert rows(transforms.preference(p)) == [("i", "c", "r")]
    assert rows(transforms.exam(spark.createDataFrame([("q", "1")], "question string, A string"))) == [("", "q", "1", "", "", "", "", "")]
    assert rows(transforms.titled_text(spark.createDataFrame([("x", None)], "content string, title string"))) == [("x", "")]


def test_first_wins(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None), (4, None)], "ord long, text string").repartition(3)
    assert sorted(rows(dedup.dedupe_records(df, ["text"], ["ord"]), "ord")) == [(0,), (1,), (3,)]
    g = spark.createDataFrame([(0, "t", "x"), (1, "t", "x"), (2, "", "x"), (3, "", "x"), (4, "u", "x")], "ord long, title string, text string")
    assert sorted(rows(dedup.dedupe_grouped(g, "title", "text", ["ord"]), "ord")) == [(0,), (2,), (4,)]


def test_running_sums_cross_buckets(spark):
    df = spark.range(1000).repartition(5)
    out = running(df, ["id"], F.floor(F.col("id") / 7), F.col("id"), "s")
    assert all(s == i * (i + 1) // 2 for i, s in rows(out, "id", "s"))


@pytest.mark.parametrize("order", ["portable", "permutation"])
def test_shuffle_split(spark, order):
    out = splits.shuffle_split(numbered(spark, 100), (0.8, 0.1, 0.1), 42, 30, order=order)
    assert {r.partition: r["count"] for r in out.groupBy("partition").count().collect()} == {"train": 24, "validation": 3, "test": 3}
    again = splits.shuffle_split(numbered(spark, 100).repartition(3), (0.8, 0.1, 0.1), 42, 30, order=order)
    assert sorted(rows(out, "ord", "partition")) == sorted(rows(again, "ord", "partition"))
    if order == "permutation":
        import random

        want = list(range(100))
        random.Random(42).shuffle(want)
        assert [r.ord for r in out.orderBy("rank").collect()] == want[:30]


def test_zero_test_fraction_and_truncation(spark):
    count = lambda n, f: {r.partition: r["count"] for r in splits.shuffle_split(numbered(spark, n), f).groupBy("partition").count().collect()}
    assert count(100, (0.95, 0.05, 0.0)) == {"train": 95, "validation": 5}
    assert count(200, (0.98, 0.02, 0.0)) == {"train": 196, "validation": 4}


def test_token_cap(spark):
    df = spark.range(50).select(F.col("id").alias("ord"), F.lit(13).alias("n"))
    out = splits.token_cap(df, F.col("n"), 30)
    assert sorted(rows(out, "ord")) == [(0,), (1,)]
    assert splits.token_cap(df, F.col("n"), 26).count() == 2  # equality stays


def test_group_split_quotas(spark):
    base = spark.range(120).select(F.col("id").alias("ord"), F.concat(F.lit("prompt "), "id").alias("instruction"))
    df = base.union(base.where("ord < 5").withColumn("ord", F.col("ord") + 120)).union(spark.createDataFrame([(999, " ")], "ord long, instruction string"))
    out = splits.group_split(df, F.col("instruction"), {"a": 40, "b": 10, "c": 20})
    n = {r.partition: r["count"] for r in out.groupBy("partition").count().collect()}
    assert n["a"] == 40 and n["b"] == 10 and n["c"] == 20
    assert splits.leaks(out, F.col("instruction")).count() == 0 and out.where("ord = 999").count() == 0


def test_group_and_prompt_splits(spark):
    df = spark.range(22).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id") % 6).alias("title"))
    out = splits.split_by_groups(df, F.col("title"), 0.2, 3)
    assert splits.leaks(out, F.col("title")).count() == 0 and out.where("partition = 'train'").select("title").distinct().count() == 4
    c = spark.sql("SELECT id AS ord, array(named_struct('role','user','content', concat('p', id % 7)), named_struct('role','assistant','content','x')) AS messages FROM range(20)")
    assert splits.leaks(splits.split_by_prompt(c, 0.3, 1), F.col("messages")[0].content).count() == 0
    got = splits.prompt_set(c, 5)
    assert got.count() == 5 and sorted(r.prompt_index for r in got.collect()) == [0, 1, 2, 3, 4]


def test_overlap(spark):
    main = spark.range(50).select(F.concat(F.lit("m"), "id").alias("text"))
    mini = spark.createDataFrame([(f" m{i} ",) for i in range(10)] + [("new",), ("",), (None,)], "text string")
    assert rows(overlap(main, mini)) == [(11, 10, 0.9091, "exclude")]
    assert rows(overlap(main, mini.where("text = ''"))) == [(0, 0, 0.0, "include")]


def test_blocks_span_documents(spark):
    docs = spark.createDataFrame([(0, [0, 5, 7, 9, 1]), (1, [0, 6]), (2, []), (3, [8, 2, 1])], "ord long, ids array<int>")
    stream = packing.stream_offsets(docs)
    offsets = spark.createDataFrame([(0, 0), (1, 4)], "block_id long, offset long")
    for cell in (2, 3, 4096):
        out = packing.blocks(stream, offsets, 4, cell=cell).orderBy("block_id")
        assert rows(out, "input", "label") == [([0, 5, 7, 9], [5, 7, 9, 1]), ([1, 0, 6, 8], [0, 6, 8, 2])]
    masked = stream.withColumn("mask", F.transform("ids", lambda x: (x > 5).cast("int")))
    assert rows(packing.blocks(masked, offsets, 4, mask_col="mask").orderBy("block_id"), "label") == [([-100, 7, 9, -100],), ([-100, 6, 8, -100],)]
    with pytest.raises(ValueError):
        packing.block_offsets(spark, 4, 4, 1, 0)
    assert all(0 <= o <= 95 for _, o in rows(packing.block_offsets(spark, 100, 4, 50, 1)))
    assert [t for _, t in sorted(rows(packing.flat_stream(stream)))] == [0, 5, 7, 9, 1, 0, 6, 8, 2, 1]


def test_answered_turns_go_by_role(spark):
    turns = [(0, "system", "s"), (1, "user", "u1"), (2, "assistant", "a1"), (3, "user", "u2"), (4, "assistant", "a2"), (5, "user", "u3")]
    odd = [(0, "user", "x"), (1, "user", "y"), (2, "assistant", "z"), (3, "assistant", "w"), (4, "user", ""), (5, "assistant", "v"), (6, "user", "q"), (7, "assistant", None)]
    df = spark.createDataFrame([(c, *t) for c, some in ((1, turns), (2, odd), (3, turns[:1])) for t in some], "conv_id long, turn int, role string, text string")
    got = chat.answered_turns(chat.to_messages(df)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, [m.content for m in r.messages]) for r in got] == [(1, 1, ["u1", "a1"]), (1, 3, ["u2", "a2"]), (2, 1, ["y", "z"])]
    sf = "/root/testdata/sf0.001"
    every = spark.read.parquet(f"{sf}/conversations.parquet")
    out = queries.QUERIES["assistant_pairs"](spark, sf)
    assert out.count() == every.where("role = 'assistant'").count() and out.agg(F.sum(F.col("assistant_tokens") - 2)).first() == every.where("role = 'assistant'").agg(F.sum(F.length("text"))).first()


def test_stream_blocks_reach_the_whole_stream(spark):
    n = 400_000
    offsets = [r.offset for r in packing.spread_offsets(spark, n, 64, 997, 42).collect()]
    assert len(offsets) == 402 and 0 <= min(offsets) and max(offsets) <= n - 65
    assert all(any(k * n // 10 <= x < (k + 1) * n // 10 for x in offsets) for k in range(10))
    assert rows(packing.spread_offsets(spark, 65, 64, 997, 1), "offset") == [(0,)]
    with pytest.raises(ValueError):
        packing.spread_offsets(spark, 64, 64, 997, 1)
    sf = "/root/testdata/sf0.01"  # longer than the hundred offsets of blocks reach
    end = queries.QUERIES["doc_offsets"](spark, sf).agg(F.max("stream_end")).first()[0]
    out = queries.QUERIES["stream_blocks"](spark, sf).cache()
    assert end > 99 * 997 + 65 and out.count() == -(-end // 997) and out.agg(F.max("offset")).first()[0] > end - end // 20
    assert out.where((F.size(F.split("input", " ")) != 64) | (F.size(F.split("label", " ")) != 64)).count() == 0


def test_chat(spark):
    kind = "ord long, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(0, [("user", "q"), ("assistant", "a")]), (1, []), (2, [("user", "q")]), (3, [("user", ""), ("user", "x"), ("assistant", "y")]), (4, None)], kind)
    assert sorted(rows(chat.valid_conversations(df), "ord")) == [(0,), (3,)]
    assert rows(df.where("ord = 0").select(chat.render_pair("messages"))) == [("user: q\nassistant: a",)]
    with pytest.raises(PySparkException):
        df.where("ord = 2").select(chat.render_pair("messages")).collect()
    ids, mask = chat.pair_ids(F.array(F.lit(7), F.lit(8)), F.array(F.lit(9)), 0, 1)
    assert rows(spark.range(1).select(ids, mask)) == [([0, 7, 8, 1, 9, 1], [0, 0, 0, 1, 1, 1])]
    p = spark.createDataFrame([([1, 2], [1, 2, 3])], "p array<int>, f array<int>")
    assert rows(p.select(chat.prefix_mask("p", "f"))) == [([0, 0, 1],)]
    for bad in ("f", "p"):
        with pytest.raises(PySparkException):
            p.select(chat.prefix_mask(bad, "p")).collect()
    made = chat.rendered(df.where("ord = 0"), lambda turns, go: "|".join(t["content"] for t in turns) + (">" if go else ""))
    assert rows(made, "rendered", "prompt") == [("q|a", "q>")]


def test_tokenizer_matches_the_library(spark):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    texts = ["low lower lowest it's  newer wider", "def f(x):\n    return x + 1", "机器学习 模型 emoji 😀", "new newer newest low low"] * 4
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = tokenizer.train_on(df, 300)
    tokenizer.check_specials(vocab)
    lib = Tokenizer(models.BPE())
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    lib.decoder = decoders.ByteLevel()
    lib.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=300, min_frequency=2, special_tokens=list(tokenizer.SPECIALS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    assert [len(vocab.encode(t)) for t in texts] == [len(lib.encode(t).ids) for t in texts]
    assert all(vocab.decode(vocab.encode(t)) == t for t in texts)
    import regex

    want = {}
    for t in texts:
        for m in regex.findall(tokenizer.PATTERN, t):
            want[m] = want.get(m, 0) + 1
    assert dict(rows(tokenizer.pretoken_counts(df))) == want
    out = tokenizer.round_trip(df, vocab).first()
    assert (out.checked, out.ok, out.failures) == (16, True, [])


def test_round_trip_counts_every_failure(spark, monkeypatch):
    vocab = tokenizer.train([("ab", 2)], 300)
    wrong = vocab.encode("q")[0]
    vocab.tokens[wrong] = b"x"
    texts = ["q" * 100 + str(i) for i in range(30)] + [f"q{i}" for i in range(25)] + ["fine"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = tokenizer.round_trip(df, vocab).first()
    assert (out.checked, out.ok, out.failed, len(out.failures)) == (60, False, 55, 20)
    monkeypatch.setattr(queries, "_docs", lambda *a: df)
    monkeypatch.setattr(tokenizer, "train_on", lambda *a: vocab)
    assert rows(queries.QUERIES["bpe_round_trip"](spark, "")) == [(60, False, 55)]


def test_metrics(spark):
    log = spark.createDataFrame([("r", 0, 1, 5.0, 10.0, 1.0, None, None), ("r", 1, 2, 4.0, 20.0, 1.0, 4.5, 2.0), ("r", 2, 3, 3.0, 30.0, 1.0, 4.5, 1.0), ("r", 3, 3, 2.0, 40.0, 1.0, None, None)], "run string, ord int, global_step long, train_loss double, tokens_s double, step_time_s double, val_loss double, peak_mem_gb double")
    s = metrics.run_summary(log, "run", "ord").first()
    assert (s.steps, s.first_train_loss, s.last_train_loss, s.best_val_loss, s.best_step, s.last_val_loss, s.val_train_gap, s.peak_mem_gb) == (4, 5, 2, 4.5, 2, 4.5, 1.5, 2)
    assert metrics.run_summary(log, "run", "ord", "last").first().val_train_gap == 2.5
    assert rows(metrics.resume_continuity(log, "run", "global_step", "ord", 2)) == [("r", 4.0, 2.0)]
    assert rows(metrics.resume_continuity(log, "run", "global_step", "ord", 3)) == [("r", 2.0, None)]
    kind = "eval_name string, val_loss double, val_ppl double"
    base = spark.createDataFrame([("domain_val", 2.0, 7.0), ("a", 1.0, 4.0), ("only", 1.0, 1.0)], kind)
    tuned = spark.createDataFrame([("domain_val", 1.5, 5.0), ("a", 1.0, 5.0)], kind)
    c = metrics.compare_models(base, tuned)
    assert {r.eval_name: (r.delta_ppl, r.kind) for r in c.collect()} == {"domain_val": (-2.0, "domain"), "a": (1.0, "general")}
    assert rows(metrics.compare_summary(c)) == [(True, -2.0, 1.0, 1.0, True)]
    assert rows(metrics.compare_summary(c.where("false"))) == [(False, None, 0.0, None, False)]


def test_power_law(spark):
    pts = spark.createDataFrame([(n, 3.0 * n**-0.1) for n in (1e6, 1e7, 1e8)], "n_params double, loss double")
    fit = metrics.power_law(pts).first()
    assert (round(fit.alpha, 9), round(fit.c, 9), round(fit.r2, 9), fit.in_literature_range) == (0.1, 3.0, 1.0, True)
    for bad in (pts.limit(1), pts.withColumn("n_params", F.lit(1.0)), pts.withColumn("loss", -F.col("loss"))):
        with pytest.raises(PySparkException):
            metrics.power_law(bad).collect()


def test_offsets_of_no_documents(spark):
    df = spark.createDataFrame([], "ord long, ids array<int>")
    assert packing.stream_offsets(df).count() == 0
    nulls = spark.createDataFrame([(None, [1, 2]), (3, [1])], "ord long, ids array<int>")
    assert sorted(r.stream_end for r in packing.stream_offsets(nulls).collect()) == [2, 3]


def test_ranks_on_keys_in_buckets_that_follow_the_rows(spark):
    from loomspark.operators import order

    assert [order.hash_digits(n) for n in (0, 1_600_000, 1_600_001, 100_000_000, 10**12)] == [1, 1, 2, 3, 6]
    df = spark.range(3000).select(F.col("id").alias("ord"), F.repeat(F.lit("x"), 100).alias("text"), (F.col("id") % 2).alias("g"))
    want = {r.ord: i + 1 for i, r in enumerate(sorted(df.select("ord").collect(), key=lambda r: (hashlib.sha256(f"5|{r.ord}".encode()).hexdigest(), r.ord)))}
    out = order.shuffled_rank(df, 5, total="n", bucket_rows=10)
    assert {r.ord: r["rank"] for r in out.collect()} == want and {r.n for r in out.collect()} == {3000}
    # No window of the plan sees a text.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "Window" in line)
    keys = order.hash_digits(100_000_000)
    sizes = spark.range(2_000_000).groupBy(F.substring(order.shuffle_hash(1, "id"), 1, keys - 1)).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * 2_000_000 / 16 ** (keys - 1)  # hashes fill buckets evenly
    twice = df.unionByName(df.where("ord < 50"))
    ranks = sorted(r["rank"] for r in order.shuffled_rank(twice, 5, bucket_rows=10).collect())
    assert ranks == list(range(1, 3051))
    parted = order.shuffled_rank(df, 5, by=["g"], total="n").groupBy("g").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("d"), F.max("n").alias("n")).collect()
    assert [(r.m, r.d, r.n) for r in parted] == [(1500, 1500, 1500)] * 2
    assert order.shuffled_rank(df.where("false"), 5).count() == 0
