"""Preparing governed corpora for training: token streams by document and by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import group_key
from ..operators import chat, packing
from ..operators.dedup import dedupe_grouped
from ..operators.splits import prompt_set, split_by_groups, split_by_prompt
from ..operators.tokenizer import Vocabulary, encoder
from ..sources.readers import corpus_texts, governed_records, parquet
from ..sources.sinks import stream_meta, write_json
from ..storage import drop_table, materialize
from .artifacts import corpus_manifest, prepared_manifest, stream_folder, write_streams
from .configs import PREPARATION, checked


def document_stream(docs: DataFrame, vocab: Vocabulary, bos: int = 0, eos: int = 1) -> DataFrame:
    """(ord, ids, stream_start, stream_end): framed documents in order, as a table that its user drops."""
    return _placed(docs.select("ord", packing.framed(encoder(vocab)("text"), bos, eos).alias("ids")))


def _placed(encoded: DataFrame) -> DataFrame:
    """Encoded documents with their places in the stream, written; every text is encoded once, however often the
    stream is read."""
    ids = materialize(encoded)
    stream = materialize(packing.stream_offsets(ids))
    drop_table(ids)
    return stream


def prepare_domain(spark: SparkSession, root: str, corpus: str, splits: list[str], key: str, val_frac: float, seed: int, vocab: Vocabulary, source: dict) -> dict[str, tuple[DataFrame, dict]]:
    """Train and validation streams (tables) with their meta; whole groups stay on one side, copies within a side go."""
    rows = governed_records(spark, root, corpus, splits)
    parted = materialize(split_by_groups(rows, group_key(key, "text"), val_frac, seed), "partition")
    out = {}
    for part in ("train", "validation"):
        some = dedupe_grouped(parted.where(F.col("partition") == part), key, "text", ["ord"])
        stream = document_stream(some, vocab)
        out[part] = (stream, stream_meta(stream, source, corpus=corpus, split=part, seed=seed, split_strategy="group"))
    drop_table(parted)
    return out


def prepare_general(spark: SparkSession, root: str, corpora: list[str], vocab: Vocabulary, sources: dict[str, dict]) -> dict[str, tuple[DataFrame, dict]]:
    """Validation splits of other corpora as they are, encoded anew; seeds stay those of the sources."""
    out = {}
    for corpus in corpora:
        stream = document_stream(corpus_texts(spark, root, corpus, "validation"), vocab)
        out[corpus] = (stream, stream_meta(stream, sources[corpus], corpus=corpus, split="validation", seed=sources[corpus].get("seed")))
    return out


def conversation_stream(conversations: DataFrame, vocab: Vocabulary, bos: int = 0, eos: int = 1) -> DataFrame:
    """(ord, ids, mask, stream_start, stream_end) of two-turn conversations in the small template, as a table that
    its user drops."""
    encode = encoder(vocab)
    checked = conversations.withColumn("_r", chat.render_pair("messages")).where(F.col("_r").isNotNull())
    u = encode(F.concat(F.lit("user: "), F.col("messages")[0].content))
    a = encode(F.concat(F.lit("assistant: "), F.col("messages")[1].content))
    both = checked.select("ord", u.alias("u"), a.alias("a"))
    ids, mask = chat.pair_ids(F.col("u"), F.col("a"), bos, eos)
    return _placed(both.select("ord", ids.alias("ids"), mask.alias("mask")))


def prepare_conversations(df: DataFrame, vocab: Vocabulary, val_frac: float, seed: int, source: dict, prompts: int = 50) -> tuple[dict[str, tuple[DataFrame, dict]], DataFrame]:
    """Streams (tables) by partition and the fixed prompt set of the validation side."""
    parted = materialize(split_by_prompt(chat.valid_conversations(df), val_frac, seed), "partition")
    out = {}
    for part in ("train", "validation"):
        stream = conversation_stream(parted.where(F.col("partition") == part), vocab)
        out[part] = (stream, stream_meta(stream, source, split=part, seed=seed, split_strategy="prompt"))
    chosen = materialize(prompt_set(parted.where("partition = 'validation'"), prompts))
    drop_table(parted)
    return out, chosen


def prepare_domain_job(spark: SparkSession, root: str, manifest_dir: str, out_corpus: str, source: str, splits: list[str], key: str, val_frac: float, seed: int, vocab: Vocabulary, tokenizer: str, general: tuple[str, ...] = ()) -> dict:
    """Write a domain corpus's streams, the held-out streams of general corpora and the manifest; returns the manifest."""
    found = corpus_manifest(spark, manifest_dir, source)
    parts = prepare_domain(spark, root, source, splits, key, val_frac, seed, vocab, found)
    partitions = write_streams(spark, parts, stream_folder(root, out_corpus, tokenizer))
    drop_table(*[stream for stream, _ in parts.values()])
    for corpus, part in prepare_general(spark, root, list(general), vocab, {c: corpus_manifest(spark, manifest_dir, c) for c in general}).items():
        write_streams(spark, {"validation": part}, stream_folder(root, corpus, tokenizer))
        drop_table(part[0])
    out = prepared_manifest(out_corpus, found, f"{manifest_dir}/{source}.json", splits, tokenizer, vocab.size, partitions, group_key=key, split_strategy="group_by_document", val_frac=val_frac, seed=seed)
    write_json(spark, out, f"{manifest_dir}/{out_corpus}.json")
    return out


def prepare_conversations_job(spark: SparkSession, root: str, manifest_dir: str, out_corpus: str, source: str, splits: list[str], val_frac: float, seed: int, vocab: Vocabulary, tokenizer: str, prompts: int = 50, prompt_seed: int = 2026) -> dict:
    """Write a chat corpus's streams with masks, the fixed prompts of its validation side and the manifest; returns it."""
    checked(PREPARATION, {"corpus": out_corpus, "splits": list(splits), "val_frac": val_frac, "seed": seed})
    found = corpus_manifest(spark, manifest_dir, source)
    rows = None
    for k, split in enumerate(splits):
        some = parquet(spark, f"{root}/{source}/{split}.parquet").withColumn("ord", F.col("ord") + F.lit(k << 40))
        rows = some if rows is None else rows.unionByName(some)
    parts, chosen = prepare_conversations(rows, vocab, val_frac, seed, found, prompts)
    partitions = write_streams(spark, parts, stream_folder(root, out_corpus, tokenizer))
    listed = [r.prompt for r in chosen.orderBy("prompt_index").collect()]  # ``prompts`` at most
    drop_table(chosen, *[stream for stream, _ in parts.values()])
    path = f"{root}/{out_corpus}/prompts-{prompts}.json"
    write_json(spark, [{"index": i, "prompt": p, "source_split": "validation"} for i, p in enumerate(listed)], path)
    more = {"path": path, "count": len(listed), "seed": prompt_seed, "source_split": "validation", "selection_rule": f"distinct prompts of the validation side in seeded order, the first {prompts}"}
    out = prepared_manifest(out_corpus, found, f"{manifest_dir}/{source}.json", splits, tokenizer, vocab.size, partitions, split_strategy="group_by_prompt", val_frac=val_frac, seed=seed, chat_template="tiny", prompts=more)
    write_json(spark, out, f"{manifest_dir}/{out_corpus}.json")
    return out


def prepare_pretraining_job(spark: SparkSession, root: str, manifest_dir: str, config: dict, vocab: Vocabulary, max_docs: int | None = None) -> dict:
    """Write the token streams of a governed corpus's splits as a checked ``PRETRAIN`` configuration names them; returns
    what was written by split. The tokenizer's vocabulary must be the model's."""
    data, size = config["data"], config["model"]["vocab_size"]
    if vocab.size != size:
        raise ValueError(f"the tokenizer has {vocab.size} tokens, the model {size}")
    found = corpus_manifest(spark, manifest_dir, data["corpus"])
    out = {}
    for split in data["splits"]:
        stream = document_stream(corpus_texts(spark, root, data["corpus"], split, max_docs), vocab)
        meta = stream_meta(stream, found, corpus=data["corpus"], split=split, seed=found.get("seed"), tokenizer=data["tokenizer"], max_docs=max_docs)
        out |= write_streams(spark, {split: (stream, meta)}, stream_folder(root, data["corpus"], data["tokenizer"]))
        drop_table(stream)
    return out
