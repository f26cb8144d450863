"""Artifacts, prepared streams, configurations, commands, and orders over many files."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark import cli
from loomspark.functions import numeric
from loomspark.operators import order, packing, probes, tokenizer
from loomspark.plans import artifacts, configs, prepare
from loomspark.sources import readers, sinks
from loomspark.sources.sinks import write_json

TEXTS = ["low lower lowest it's  newer wider", "def f(x):\n    return x + 1", "机器学习 模型 emoji 😀", "new newer newest low low"]


@pytest.fixture(scope="module")
def vocab(spark):
    return tokenizer.train_on(spark.createDataFrame([(t,) for t in TEXTS * 3], "text string"), 290)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A governed corpus of documents, one of conversations, and their manifests."""
    out = tmp_path_factory.mktemp("root")
    law = [(f"{TEXTS[i % 4]} {i}", f"t{i % 6}") for i in range(22)]
    spark.createDataFrame(law, "text string, title string").coalesce(1).write.parquet(str(out / "law/train.parquet"))
    spark.createDataFrame([(t, "x") for t in TEXTS], "text string, title string").write.parquet(str(out / "law/validation.parquet"))
    chat = "SELECT array(named_struct('role','user','content', concat('prompt ', id % 9)), named_struct('role','assistant','content', concat('answer ', id))) AS messages FROM range(20)"
    spark.sql(chat).write.parquet(str(out / "chat/train.parquet"))
    for name in ("law", "chat"):
        write_json(spark, {"dataset": name, "license": "l", "revision": "r1", "upstream": "u", "seed": 42, "partitions": {"train": {"chars": 700}, "validation": {"chars": 100}}}, str(out / f"m/{name}.json"))
    return str(out)


def test_tokenizer_artifact(spark, vocab, tmp_path):
    from tokenizers import Tokenizer

    meta = artifacts.tokenizer_meta("own", vocab, {"dataset": "d", "license": "l", "revision": "r"}, "train")
    artifacts.publish_tokenizer(spark, vocab, str(tmp_path / "t"), str(tmp_path / "m"), meta)
    assert readers.manifest(spark, str(tmp_path / "m/tokenizer-own.json"))["corpus"]["revision"] == "r"
    again, found = artifacts.load_tokenizer(spark, str(tmp_path / "t/own"))
    assert (again.ids, again.merges, again.specials) == (vocab.ids, vocab.merges, vocab.specials) and found["special_ids"] == {"bos": 0, "eos": 1, "pad": 2, "unk": 3}
    lib = Tokenizer.from_file(str(tmp_path / "t/own/tokenizer.json"))
    assert lib.get_vocab_size() == vocab.size
    library = (lambda t: lib.encode(t, add_special_tokens=False).ids, lambda ids: lib.decode(ids, skip_special_tokens=False))
    for t in [*TEXTS, "unseen words, ÄÖ\u0000\t!", "x" * 500]:
        assert vocab.encode(t) == lib.encode(t).ids and library[1](library[0](t)) == t
    report = {(r.tokenizer, r.category): r for r in probes.probe_report(probes.probe_texts(spark), {"own": (again.encode, again.decode), "library": library}).collect()}
    assert len(report) == 8 and report["own", "zh"].n_tokens == report["library", "zh"].n_tokens and report["own", "overall"].failed == 0
    with pytest.raises(FileNotFoundError):
        artifacts.load_tokenizer(spark, str(tmp_path / "none"))


def test_batch_counter(spark, vocab):
    df = spark.createDataFrame([(TEXTS[:2],), ([],), (None,)], "t array<string>")
    got = [r.n for r in df.select(tokenizer.batch_counter(vocab)("t").alias("n")).collect()]
    assert got == [sum(len(vocab.encode(t)) for t in TEXTS[:2]), 0, 0]


def test_prepared_domain(spark, vocab, root):
    out = prepare.prepare_domain_job(spark, root, f"{root}/m", "law-prepared", "law", ["train"], "title", 0.3, 7, vocab, "own", ("law",))
    assert out["total_tokens"] == sum(p["tokens"] for p in out["partitions"].values()) and out["source"]["revision"] == "r1" and out["source"]["test_excluded"]
    folder = artifacts.stream_folder(root, "law-prepared", "own")
    train = artifacts.load_stream(spark, folder, "train")
    assert train["length"] == out["partitions"]["train"]["tokens"] == train["meta"]["tokens"]
    flat = [r.token for r in readers.binary_stream(spark, train["path"], range_items=7).orderBy("position").collect()]
    assert len(flat) == train["length"] and flat[0] == 0 and flat[-1] == 1
    sampler = packing.BlockSampler(train["length"], 5, 3)
    sampler.offsets(4)
    state = json.loads(json.dumps(sampler.state()))
    offsets = sampler.offsets(6)
    other = packing.BlockSampler(train["length"], 5, 99)
    other.restore(state)
    assert other.offsets(6) == offsets
    rows = readers.stream_blocks(spark, train["path"], spark.createDataFrame(list(enumerate(offsets)), "block_id int, offset int"), 5).collect()
    assert {(r.block_id, tuple(r.input), tuple(r.label)) for r in rows} == {(i, tuple(flat[o : o + 5]), tuple(flat[o + 1 : o + 6])) for i, o in enumerate(offsets)}
    assert artifacts.load_stream(spark, artifacts.stream_folder(root, "law", "own"), "validation")["meta"]["docs"] == 4
    with pytest.raises(FileNotFoundError):
        artifacts.load_stream(spark, folder, "test")
    with pytest.raises(ValueError):
        packing.BlockSampler(5, 5, 1)


def test_prepared_conversations(spark, vocab, root):
    out = prepare.prepare_conversations_job(spark, root, f"{root}/m", "chat-prepared", "chat", ["train"], 0.3, 1, vocab, "own")
    prompts = json.loads(open(f"{root}/chat-prepared/prompts-50.json").read())
    assert out["prompts"]["count"] == len(prompts) == 3 and prompts[0]["source_split"] == "validation"
    folder = artifacts.stream_folder(root, "chat-prepared", "own")
    found = artifacts.load_stream(spark, folder, "train", masked=True)
    masked = [r.token for r in readers.binary_stream(spark, found["mask"], "i1").orderBy("position").collect()]
    assert sum(masked) == found["meta"]["assistant_tokens"] == out["partitions"]["train"]["assistant_tokens"] and len(masked) == found["length"]
    with pytest.raises(ValueError):
        prepare.prepare_conversations_job(spark, root, f"{root}/m", "c", "chat", ["test"], 0.3, 1, vocab, "own")


def test_manifests(spark, root):
    rows = [tuple(r) for r in artifacts.manifest_lookup(spark, ["law", "none", "chat"], f"{root}/m").select("dataset", "revision").collect()]
    assert rows == [("law", "r1"), ("none", None), ("chat", "r1")]
    assert artifacts.manifest_lookup(spark, ["none"], f"{root}/m").first().license is None
    with pytest.raises(FileNotFoundError):
        artifacts.corpus_manifest(spark, f"{root}/m", "none")
    with pytest.raises(ValueError):
        artifacts.corpus_manifest(spark, f"{root}/m", "law", ("nothing",))


def test_provenance_takes_injected_providers():
    def version(name):
        if name == "gone":
            raise artifacts.metadata.PackageNotFoundError
        return "1"

    assert artifacts.environment(("a", "gone"), version) | {"python": ""} == {"python": "", "a": "1", "gone": None}
    record = artifacts.run_record(["x", "y"], "abc", lambda: {"available": True})
    assert record["command"] == "x y" and record["hardware"]["accelerator"] == {"available": True}


MODEL = {"vocab_size": 100, "hidden_size": 16, "num_hidden_layers": 2, "num_attention_heads": 4, "intermediate_size": 32, "max_position_embeddings": 64}
TRAIN = {"seq_len": 64, "micro_batch_size": 2, "grad_accum_steps": 3, "max_steps": 10}
ADAPTER = {"rank": 8, "alpha": 16, "target_modules": ["q_proj"]}


def test_configs(spark, tmp_path):
    model = configs.checked(configs.MODEL, MODEL)
    assert model["tie_word_embeddings"] and model["dropout"] == 0.0
    assert configs.parameters_of(model) == 100 * 16 + 64 * 16 + 2 * (4 * 256 + 2 * 16 * 32 + 9 * 16 + 32) + 32
    assert configs.tokens_of(configs.checked(configs.TRAIN, TRAIN)) == (384, 3840)
    data = {"corpus": "c", "tokenizer": "t"}
    (tmp_path / "c.json").write_text(json.dumps({"run_name": "r", "data": data, "model": MODEL, "train": TRAIN}))
    assert configs.read(spark, configs.PRETRAIN, str(tmp_path / "c.json")) == configs.read_local(configs.PRETRAIN, str(tmp_path / "c.json"))
    tuning = {"run_name": "r", "model_path": "m", "train": TRAIN}
    assert configs.checked(configs.TUNING, {**tuning, "adapter": ADAPTER, "quantised": True})["adapter"]["dropout"] == 0.0
    assert configs.checked(configs.TUNING, tuning)["adapter"] is None
    bad = [
        (configs.MODEL, {**MODEL, "parameters": [1, 10]}, "outside"),
        (configs.MODEL, {**MODEL, "hidden_size": 17}, "multiple"),
        (configs.MODEL, {**MODEL, "activation": "tanh"}, "among"),
        (configs.MODEL, {**MODEL, "vocab_size": True}, "kind"),
        (configs.TRAIN, {**TRAIN, "min_lr_ratio": 1.0}, "min_lr_ratio must be < 1"),
        (configs.STRICT_TRAIN, {**TRAIN, "warmup_steps": 10}, "warm-up"),
        (configs.TRAIN, {**TRAIN, "micro_batch_size": 0}, "micro_batch_size must be >= 1"),
        (configs.PRETRAIN, {"run_name": "r", "data": data, "model": MODEL, "train": {**TRAIN, "seq_len": 65}}, "positions"),
        (configs.PRETRAIN, {"run_name": "r", "data": {**data, "splits": ["test"]}, "model": MODEL, "train": TRAIN}, "test"),
        (configs.TUNING, {**tuning, "adapter": {**ADAPTER, "target_modules": ["x_proj"]}}, "adapter.target_modules"),
        (configs.TOKENIZER, {"name": "t", "corpus": "c", "vocab_size": 3}, "vocab_size"),
        (configs.TUNING, {**tuning, "quantised": True}, "adapters"),
        (configs.TUNING, {**tuning, "splits": ["train", "test"]}, "test"),
        (configs.TUNING, {**tuning, "kind": "tiny"}, "small"),
    ]
    for section, given, says in bad:
        with pytest.raises(configs.ConfigError, match=says):
            configs.checked(section, given)
    with pytest.raises(configs.ConfigError) as all_of_them:
        configs.checked(configs.PRETRAIN, {"run_name": "", "data": {"corpus": "c", "x": 1}, "model": {**MODEL, "dropout": 1}, "train": 3})
    assert len(all_of_them.value.faults) == 5
    own = configs.reference_model({"vocab_size": 10, "hidden_size": 4})
    assert own["embedding_lm_head_params"] == 80 and configs.reference_model({"vocab_size": 10}) is None and configs.reference_model(None) is None
    assert configs.reference_model({"vocab_size": 10, "hidden_size": 4, "tie_word_embeddings": True})["embedding_lm_head_params"] == 40


def test_revision(tmp_path):
    assert artifacts.code_revision(str(tmp_path)) is None
    git = tmp_path / "a/.git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert artifacts.code_revision(str(tmp_path / "a/b/c.py")) is None
    (git / "packed-refs").write_text("# pack\n" + "1" * 40 + " refs/heads/main\n")
    assert artifacts.code_revision(str(tmp_path / "a/b/c.py")) == "1" * 40
    (git / "refs/heads/main").write_text("2" * 40 + "\n")
    assert artifacts.code_revision(str(tmp_path / "a")) == "2" * 40
    (git / "HEAD").write_text("3" * 40 + "\n")
    assert artifacts.code_revision(str(tmp_path / "a")) == "3" * 40


def test_guarded_params(spark):
    n = numeric.guarded_params(F.col("id"), 3, 5)
    assert [r.n for r in spark.range(3, 6).select(n.alias("n")).collect()] == [3, 4, 5]
    with pytest.raises(Exception, match="outside the budget"):
        spark.range(9).select(n.alias("n")).collect()


def test_records_that_parquet_has_no_type_for(spark, tmp_path):
    df = spark.range(2).withColumn("nothing", F.lit(None))
    assert sinks.write_records(df, str(tmp_path / "a.parquet")) == "jsonl" and spark.read.json(str(tmp_path / "a.jsonl")).count() == 2
    assert sinks.write_records(spark.range(2).toDF("ord"), str(tmp_path / "b.parquet")) == "parquet"


@pytest.mark.parametrize("shift", [40, 48])
def test_buckets_of_many_files_stay_small(spark, shift):
    df = spark.range(100_000).select((F.shiftleft(F.floor(F.col("id") / 1000), shift) + F.col("id") % 1000).alias("ord"))
    sizes = [r["count"] for r in df.groupBy(order.ordered_bucket(df, "ord", 100).alias("b")).count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 200
    spread = spark.range(50_000).select((F.col("id") * 1_000_003).alias("ord"))
    sizes = [r["count"] for r in spread.groupBy(order.ordered_bucket(spread, "ord", 1000).alias("b")).count().collect()]
    assert len(sizes) < 400 and max(sizes) <= 32_000
    total = order.running(df, ["ord"], order.ordered_bucket(df, "ord", 100), None, "rank", total="n")
    assert total.agg(F.max("rank"), F.min("n"), F.countDistinct("rank")).first() == (100_000, 100_000, 100_000)


def test_commands(spark, root, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/d.jsonl").write_text("".join(json.dumps({"text": f"{TEXTS[i % 4]} number {i}"}) + "\n" for i in range(60)))
    specs = {"d": {"provenance": {"license": "l", "revision": "r", "upstream": "u"}, "source": {"files": "d.jsonl", "schema": "text string", "transform": "wikitext"}, "split": {"by": "shuffle"}, "limits": {"tokens": 200}}}
    (tmp_path / "specs.json").write_text(json.dumps(specs))
    where = ["--raw-root", str(tmp_path / "raw"), "--out-root", str(tmp_path / "out"), "--manifest-dir", str(tmp_path / "m"), "--specs", str(tmp_path / "specs.json")]

    def run(*args):
        assert cli.main(list(args)) == 0
        return json.loads(capsys.readouterr().out)

    free = run("govern", *where)["d"]["partitions"]
    assert free["train"]["tokens"] is None and not json.loads((tmp_path / "m/d.json").read_text())["token_cap_applied"]
    made = run("train-tokenizer", "--root", str(tmp_path / "out"), "--corpus", "d", "--name", "own", "--out-root", str(tmp_path / "t"), "--manifest-dir", str(tmp_path / "m"), "--vocab-size", "300")
    assert made["vocab_size"] == 300 and made["corpus"]["revision"] == "r"
    capped = run("govern", *where, "--tokenizer", str(tmp_path / "t/own"), "--log", str(tmp_path / "log"))["d"]["partitions"]
    assert 0 < capped["train"]["tokens"] <= 200 and capped["train"]["records"] < free["train"]["records"]
    assert json.loads((tmp_path / "m/d.json").read_text())["token_cap_applied"] and spark.read.json(str(tmp_path / "log")).count() == 1
    analysed = run("analyze-tokenizers", "--root", str(tmp_path / "out"), "--manifest-dir", str(tmp_path / "m"), "--report", str(tmp_path / "a.json"), "--tokenizers", str(tmp_path / "t/own"))
    own = analysed["tokenizers"]["own"]
    assert set(own["probes_tokens_per_char"]) == {"en", "zh", "code", "overall"} and own["corpus_validation_roundtrip"]["ok"] and analysed["impact"][0]["embedding_lm_head_params"] == 300 * 512 * 2
    assert analysed["impact"][0]["train_tokens_estimated"] > 0 and json.loads((tmp_path / "a.json").read_text()) == analysed
    assert analysed["reference_own_config"] is None
    (tmp_path / "other.json").write_text(json.dumps({"vocab_size": 50, "hidden_size": 8, "tie_word_embeddings": True}))
    again = run("analyze-tokenizers", "--root", str(tmp_path / "out"), "--manifest-dir", str(tmp_path / "m"), "--report", str(tmp_path / "a.json"), "--tokenizers", str(tmp_path / "t/own"), "--reference-config", str(tmp_path / "other.json"))
    assert again["reference_own_config"]["embedding_lm_head_params"] == 400
    (tmp_path / "pre.json").write_text(json.dumps({"run_name": "r", "data": {"corpus": "d", "tokenizer": "own"}, "model": {**MODEL, "vocab_size": 300}, "train": TRAIN}))
    pre = run("prepare-pretraining", "--root", str(tmp_path / "out"), "--manifest-dir", str(tmp_path / "m"), "--tokenizer-root", str(tmp_path / "t"), "--config", str(tmp_path / "pre.json"))
    assert set(pre) == {"train", "validation"} and artifacts.load_stream(spark, artifacts.stream_folder(str(tmp_path / "out"), "d", "own"), "train")["length"] == pre["train"]["tokens"] > 0
    domain = run("prepare-domain", "--root", root, "--manifest-dir", f"{root}/m", "--out-corpus", "law2", "--source", "law", "--tokenizer", str(tmp_path / "t/own"), "--val-frac", "0.3")
    assert domain["total_tokens"] > 0
    chat = run("prepare-chat", "--root", root, "--manifest-dir", f"{root}/m", "--out-corpus", "chat2", "--source", "chat", "--tokenizer", str(tmp_path / "t/own"), "--val-frac", "0.3")
    assert chat["partitions"]["train"]["assistant_tokens"] > 0
    sized = run("sizing", "--report", str(tmp_path / "s.json"), "--micro-batch", "2", "--accumulation", "4", "--seq-len", "512", "--steps", "10", "--adapter-params", "286720", "--model-params", "1000", "--domain-tokens", "50")
    assert sized["budget_tokens"] == 40960 and sized["flops_estimate"] == 4.0 * 1000 * 50 * 3
    for name, loss in (("base", 2.0), ("tuned", 1.5)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"eval_name": "domain_val", "val_loss": loss, "val_ppl": 2.718281828**loss}) + "\n")
    compared = run("compare", "--base", str(tmp_path / "base.json"), "--tuned", str(tmp_path / "tuned.json"), "--report", str(tmp_path / "c.json"))
    assert compared["summary"]["domain_ppl_improved"] and compared["evaluations"][0]["kind"] == "domain"
    (tmp_path / "g.json").write_text('{"prompt_index": 0, "generated": "x"}\n')
    merged = run("merge-check", "--before", str(tmp_path / "g.json"), "--after", str(tmp_path / "g.json"), "--report", str(tmp_path / "mc.json"), "--loss-before", "1.0", "--loss-after", "1.001")
    assert merged["merge_consistent"] and merged["generation_exact_match"] == 1
    for name, texts in (("b", ["x", "y z a b c"]), ("one", ["x", "no"]), ("two", ["x", "y z a b c"])):
        (tmp_path / f"gen-{name}.json").write_text("".join(json.dumps({"prompt_index": i, "generated": t}) + "\n" for i, t in enumerate(texts)))
    (tmp_path / "prompts.json").write_text(json.dumps([{"index": 0, "prompt": "p"}, {"index": 1, "prompt": "q"}]))
    gen = run("compare-generations", "--base", str(tmp_path / "gen-b.json"), "--prompts", str(tmp_path / "prompts.json"), "--report", str(tmp_path / "cg.json"), "--runs", f"one={tmp_path}/gen-one.json", f"two={tmp_path}/gen-two.json")
    assert gen["runs"] == {"one": {"pairs": 2, "exact_match_count": 1}, "two": {"pairs": 2, "exact_match_count": 2}}
    assert [s["prompt"] for s in gen["samples"]] == ["p", "p", "q", "q"] and gen["diversity"]["one"]["mean_distinct_4gram_ratio"] == 0.0 and gen["diversity"]["two"]["mean_distinct_4gram_ratio"] == 0.5
