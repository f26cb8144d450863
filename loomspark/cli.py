"""Commands: govern, overlap, train-tokenizer, analyze-tokenizers, prepare-pretraining, prepare-domain, prepare-chat, sizing, compare,
compare-generations, merge-check, summary."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .session import session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomspark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *needed: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for n in needed:
            p.add_argument(n, required=True)
        return p

    g = command("govern", "scan, clean, split and write datasets", "--raw-root", "--out-root", "--manifest-dir", "--specs")
    g.add_argument("--datasets", nargs="*")
    g.add_argument("--tokenizer", help="folder of the tokenizer that counts tokens; without one caps have no effect")
    g.add_argument("--log", help="a JSON-lines log to which each manifest is appended")
    command("overlap", "share of a corpus's texts that another holds", "--main", "--mini", "--report").add_argument("--sample", type=int)
    t = command("train-tokenizer", "byte-level BPE on a governed split", "--root", "--corpus", "--name", "--out-root", "--manifest-dir")
    t.add_argument("--split", default="train")
    t.add_argument("--vocab-size", type=int, default=16_000)
    t.add_argument("--max-docs", type=int)
    a = command("analyze-tokenizers", "probe texts, validation counts and costs of tokenizers", "--root", "--manifest-dir", "--report")
    a.add_argument("--tokenizers", nargs="+", required=True)
    a.add_argument("--hidden-size", type=int, default=512)
    a.add_argument("--seq-len", type=int, default=512)
    a.add_argument("--reference-config", help="another model's config.json, for the costs that it has by its own sizes")
    command("prepare-pretraining", "token streams of a governed corpus as a pretraining configuration names them", "--root", "--manifest-dir", "--tokenizer-root", "--config").add_argument("--max-docs", type=int)
    for name, about in (("prepare-domain", "token streams of a domain corpus"), ("prepare-chat", "token streams and masks of conversations")):
        p = command(name, about, "--root", "--manifest-dir", "--out-corpus", "--source", "--tokenizer")
        p.add_argument("--splits", nargs="+", default=["train"])
        p.add_argument("--val-frac", type=float, default=0.05)
        p.add_argument("--seed", type=int, default=42)
        if name == "prepare-domain":
            p.add_argument("--group-key", default="title")
            p.add_argument("--general", nargs="*", default=[])
    z = command("sizing", "batch, budget and cost of a tuning run", "--report")
    for name in ("--micro-batch", "--accumulation", "--seq-len", "--steps", "--adapter-params"):
        z.add_argument(name, type=int, required=True)
    z.add_argument("--model-params", type=int)
    z.add_argument("--domain-tokens", type=int)
    command("compare", "two models' evaluations (eval_name, val_loss, val_ppl)", "--base", "--tuned", "--report")
    k = command("compare-generations", "one run's generations (prompt_index, generated) against those of others", "--base", "--prompts", "--report")
    k.add_argument("--runs", nargs="+", required=True, help="NAME=PATH of each other run")
    m = command("merge-check", "generations and losses before and after a merge", "--before", "--after", "--report")
    m.add_argument("--loss-before", type=float, required=True)
    m.add_argument("--loss-after", type=float, required=True)
    command("summary", "summary of metric logs", "--log")
    return parser


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    spark = session()
    from .plans import artifacts
    from .sources.sinks import write_json

    if args.command == "govern":
        from .operators.tokenizer import batch_counter
        from .plans.govern import govern_all
        from .plans.specs import load_specs
        from .sources.sinks import append_jsonl

        specs = load_specs(args.specs)
        if unknown := set(args.datasets or []) - set(specs):
            parser.error(f"unknown datasets: {sorted(unknown)}")
        counter = batch_counter(artifacts.load_tokenizer(spark, args.tokenizer)[0]) if args.tokenizer else None
        out = govern_all(spark, [specs[n] for n in args.datasets or specs], args.raw_root, args.out_root, args.manifest_dir, counter)
        if args.log:
            append_jsonl(spark.createDataFrame([(n, artifacts.now(), json.dumps(v)) for n, v in out.items()], "dataset string, at string, entry string"), args.log)
    elif args.command == "overlap":
        from .operators.overlap import overlap
        from .sources.readers import jsonl

        mini = jsonl(spark, args.mini, "text string")
        mini = mini if args.sample is None else mini.where(f"ord < {args.sample}")
        out = overlap(jsonl(spark, args.main, "text string", ordered=False), mini).first().asDict()
        write_json(spark, out, args.report)
    elif args.command == "train-tokenizer":
        from .operators.tokenizer import check_specials, train_on
        from .sources.readers import corpus_texts

        corpus = artifacts.corpus_manifest(spark, args.manifest_dir, args.corpus, ("revision", "license"))
        vocab = train_on(corpus_texts(spark, args.root, args.corpus, args.split, args.max_docs), args.vocab_size)
        check_specials(vocab)
        out = artifacts.publish_tokenizer(spark, vocab, args.out_root, args.manifest_dir, artifacts.tokenizer_meta(args.name, vocab, corpus, args.split, args.max_docs))
    elif args.command == "analyze-tokenizers":
        out = _analysis(spark, args)
        write_json(spark, out, args.report)
    elif args.command == "prepare-pretraining":
        from .plans import configs, prepare

        config = configs.read(spark, configs.PRETRAIN, args.config)
        vocab, _ = artifacts.load_tokenizer(spark, f"{args.tokenizer_root}/{config['data']['tokenizer']}")
        out = prepare.prepare_pretraining_job(spark, args.root, args.manifest_dir, config, vocab, args.max_docs)
    elif args.command == "compare-generations":
        from .operators.metrics import compare_generations, generation_diversity

        texts = lambda path: spark.read.schema("prompt_index int, generated string").json(path)
        runs = dict(r.split("=", 1) for r in args.runs)
        prompts = spark.read.schema("index int, prompt string").json(args.prompts, multiLine=True)
        rows = compare_generations(texts(args.base), {n: texts(p) for n, p in runs.items()})
        samples = prompts.withColumnRenamed("index", "prompt_index").join(rows, "prompt_index").orderBy("prompt_index", "run")
        diversity = {n: generation_diversity(texts(p)).first().asDict() for n, p in {"base": args.base, **runs}.items()}
        counts = rows.groupBy("run").agg(F.count("*").alias("pairs"), F.count(F.when(F.col("equal"), 1)).alias("equal"))
        out = {"runs": {r.run: {"pairs": r.pairs, "exact_match_count": r.equal} for r in counts.collect()}, "samples": [r.asDict() for r in samples.collect()], "diversity": diversity, "run": artifacts.run_record(sys.argv)}
        write_json(spark, out, args.report)
    elif args.command in ("prepare-domain", "prepare-chat"):
        from .plans import prepare

        vocab, meta = artifacts.load_tokenizer(spark, args.tokenizer)
        where = (spark, args.root, args.manifest_dir, args.out_corpus, args.source, args.splits)
        if args.command == "prepare-domain":
            out = prepare.prepare_domain_job(*where, args.group_key, args.val_frac, args.seed, vocab, meta["name"], tuple(args.general))
        else:
            out = prepare.prepare_conversations_job(*where, args.val_frac, args.seed, vocab, meta["name"])
    elif args.command == "sizing":
        out = artifacts.sizing_report(args.micro_batch, args.accumulation, args.seq_len, args.steps, args.adapter_params, args.model_params, args.domain_tokens)
        write_json(spark, out, args.report)
    elif args.command == "compare":
        from .operators.metrics import compare_models, compare_summary

        evals = lambda path: spark.read.schema("eval_name string, val_loss double, val_ppl double").json(path)
        rows = compare_models(evals(args.base), evals(args.tuned))
        out = {"evaluations": [r.asDict() for r in rows.orderBy("eval_name").collect()], "summary": compare_summary(rows).first().asDict(), "run": artifacts.run_record(sys.argv)}
        write_json(spark, out, args.report)
    elif args.command == "merge-check":
        from .operators.metrics import merge_consistency

        texts = lambda path: spark.read.schema("prompt_index int, generated string").json(path)
        row = merge_consistency(texts(args.before), texts(args.after), args.loss_before, args.loss_after).first()
        out = {"generation_total": row.pairs, "generation_exact_match": row.equal, "loss_delta": args.loss_after - args.loss_before, "merge_consistent": row.consistent}
        write_json(spark, out, args.report)
    else:
        from .operators.metrics import run_summary
        from .sources.readers import metrics_log

        schema = "run string, global_step long, train_loss double, tokens_s double, step_time_s double, val_loss double, peak_mem_gb double"
        out = [r.asDict() for r in run_summary(metrics_log(spark, args.log, schema), "run", "ord").collect()]
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0


def _analysis(spark, args) -> dict:
    """Probes, validation counts and round trips, and costs of saved tokenizers."""
    from .operators import probes, tokenizer
    from .plans import artifacts
    from .sources.readers import corpus_texts

    loaded = [artifacts.load_tokenizer(spark, d) for d in args.tokenizers]
    report = {"generated_at": artifacts.now(), "environment": artifacts.environment(), "tokenizers": {}}
    for row in probes.probe_report(probes.probe_texts(spark), {m["name"]: (v.encode, v.decode) for v, m in loaded}).collect():
        entry = report["tokenizers"].setdefault(row.tokenizer, {"probes_tokens_per_char": {}, "probes_roundtrip_failures": 0})
        entry["probes_tokens_per_char"][row.category] = row.tokens_per_char
        if row.category == "overall":
            entry["probes_roundtrip_failures"] = row.failed
    stats = []
    for vocab, meta in loaded:
        texts = corpus_texts(spark, args.root, meta["corpus"]["dataset"], "validation")
        counted = tokenizer.corpus_stats(texts, tokenizer.batch_counter(vocab)(F.array("text"))).first()
        trip = tokenizer.round_trip(texts, vocab).first()
        report["tokenizers"][meta["name"]] |= {"vocab_size": vocab.size, "special_ids": meta["special_ids"], "corpus": meta["corpus"], "corpus_validation": counted.asDict(), "corpus_validation_roundtrip": {"checked": trip.checked, "ok": trip.ok, "failed": trip.failed}}
        stats.append((meta["name"], vocab.size, counted.tokens, counted.docs))
    parts = loaded[0][1]["corpus"].get("partitions") or {}
    chars = [(parts.get(p) or {}).get("chars") for p in ("train", "validation")]
    table = spark.createDataFrame(stats, "name string, vocab_size long, tokens long, docs long")
    from .plans import configs
    from .sources.readers import manifest

    report["reference_own_config"] = configs.reference_model(manifest(spark, args.reference_config) if args.reference_config else None)
    report["impact"] = [r.asDict() for r in probes.impact_report(table, *chars, args.hidden_size, args.seq_len).collect()]
    return report


if __name__ == "__main__":
    raise SystemExit(main())
