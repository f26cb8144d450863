"""What jobs leave behind: tokenizer artifacts, prepared streams, manifests, run records, and how they are found again."""

from __future__ import annotations

import json
import os
import platform
from collections.abc import Callable
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokenizer import ALPHABET, PATTERN, SPECIALS, Vocabulary
from ..sources import readers, sinks

#: Names of the special tokens, by id.
SPECIAL_NAMES = ("bos", "eos", "pad", "unk")


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas"), version: Callable[[str], str] = metadata.version) -> dict:
    """Python's and the packages' versions; one that isn't installed is None. ``version`` may be injected."""
    out: dict[str, str | None] = {"python": platform.python_version()}
    for name in packages:
        try:
            out[name] = version(name)
        except metadata.PackageNotFoundError:
            out[name] = None
    return out


def hardware(accelerator: Callable[[], dict] | None = None) -> dict:
    """Processors of this machine, and what an injected provider says of accelerators."""
    return {"cpu_count": os.cpu_count(), "accelerator": accelerator() if accelerator else {"available": False}}


def code_revision(start: str | None = None) -> str | None:
    """The commit that a checkout around ``start`` (this file) is on, read from its files; None outside of one."""
    from pathlib import Path

    here = Path(start or __file__).resolve()
    for folder in (here, *here.parents):
        git = folder / ".git"
        if git.is_file():  # a worktree or a submodule points elsewhere
            git = folder / git.read_text().removeprefix("gitdir:").strip()
        if not (git / "HEAD").is_file():
            continue
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref:"):
            return head or None
        ref = head.removeprefix("ref:").strip()
        common = git / (git / "commondir").read_text().strip() if (git / "commondir").is_file() else git
        for base in (git, common):
            if (base / ref).is_file():
                return (base / ref).read_text().strip() or None
        packed = common / "packed-refs"
        lines = packed.read_text().splitlines() if packed.is_file() else []
        return next((x.split()[0] for x in lines if x.endswith(f" {ref}")), None)
    return None


def run_record(command: list[str], revision: str | None = None, accelerator: Callable[[], dict] | None = None, **more) -> dict:
    """Provenance of a run; without a revision that of the code."""
    return {"command": " ".join(command), "revision": revision or code_revision(), "recorded_at": now(), "environment": environment(), "hardware": hardware(accelerator), **more}


# --- manifests
def corpus_manifest(spark: SparkSession, manifest_dir: str, name: str, needed: tuple[str, ...] = ()) -> dict:
    """One dataset's manifest; a missing one raises, and so does one without a needed key."""
    path = f"{manifest_dir}/{name}.json"
    if not exists(spark, path):
        raise FileNotFoundError(f"no manifest of {name}: {path}")
    out = readers.manifest(spark, path)
    if missing := [k for k in needed if k not in out]:
        raise ValueError(f"{path} lacks {missing}")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest_lookup(spark: SparkSession, names: list[str], manifest_dir: str) -> DataFrame:
    """(dataset, license, revision, seed): a row for each name, nulls where no manifest is found."""
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, dataset string")
    paths = [p for n in names if exists(spark, p := f"{manifest_dir}/{n}.json")]
    known = "dataset string, license string, revision string, seed long"
    found = spark.read.schema(known).json(paths, multiLine=True) if paths else spark.createDataFrame([], known)
    return wanted.join(F.broadcast(found), "dataset", "left").orderBy("ord").drop("ord")  # one row a name


# --- tokenizers
def _letters() -> dict[int, str]:
    """The character that stands for each byte in a tokenizer file: itself if printable, else the next from U+0100."""
    plain = set(ALPHABET[:188])
    return {b: chr(b) if b in plain else chr(256 + k) for k, b in [(0, b) for b in plain] + list(enumerate(sorted(set(range(256)) - plain)))}


def save_tokenizer(spark: SparkSession, vocab: Vocabulary, directory: str, meta: dict) -> None:
    """tokenizer.json, in the format of the usual library, and config.json."""
    letters = _letters()
    text = lambda b: "".join(letters[x] for x in b)
    special = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(vocab.specials)]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    model |= {"vocab": {t: i for i, t in enumerate(vocab.specials)} | {text(b): i for b, i in vocab.ids.items()}, "merges": [[text(a), text(b)] for a, b in vocab.merges]}
    body = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": special, "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}
    sinks.write_json(spark, body, f"{directory}/tokenizer.json")
    sinks.write_json(spark, meta, f"{directory}/config.json")


def load_tokenizer(spark: SparkSession, directory: str) -> tuple[Vocabulary, dict]:
    """A saved tokenizer and its config; either file missing raises."""
    for name in ("tokenizer.json", "config.json"):
        if not exists(spark, f"{directory}/{name}"):
            raise FileNotFoundError(f"{directory}/{name}")
    model = readers.manifest(spark, f"{directory}/tokenizer.json")["model"]
    meta = readers.manifest(spark, f"{directory}/config.json")
    back = {c: b for b, c in _letters().items()}
    raw = lambda t: bytes(back[c] for c in t)
    specials = tuple(sorted((t for t, i in model["vocab"].items() if i < len(SPECIALS)), key=model["vocab"].get))
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    out = Vocabulary({raw(t): i for t, i in model["vocab"].items() if i >= len(specials)}, [(raw(a), raw(b)) for a, b in pairs], specials)
    out.name, out.vocab_size = meta["name"], out.size
    return out, meta


def tokenizer_meta(name: str, vocab: Vocabulary, corpus: dict, split: str, max_docs: int | None = None, min_frequency: int = 2, seed: int = 42) -> dict:
    """What a tokenizer was trained on; ``corpus`` is the manifest of its corpus, with revision and license."""
    keep = ("dataset", "license", "revision", "upstream", "seed", "partitions", "processed_at")
    return {
        "name": name,
        "algorithm": "byte-level BPE",
        "pattern": PATTERN,
        "vocab_size": vocab.size,
        "min_frequency": min_frequency,
        "seed": seed,
        "special_tokens": dict(zip(SPECIAL_NAMES, vocab.specials)),
        "special_ids": {n: i for i, n in enumerate(SPECIAL_NAMES)},
        "corpus": {k: corpus.get(k) for k in keep} | {"split": split},
        "max_docs": max_docs,
        "trained_at": now(),
        "environment": environment(),
    }


def publish_tokenizer(spark: SparkSession, vocab: Vocabulary, out_root: str, manifest_dir: str, meta: dict) -> dict:
    """Save a tokenizer below ``out_root`` and its manifest as tokenizer-<name>.json."""
    directory = f"{out_root}/{meta['name']}"
    meta = meta | {"output_dir": directory}
    save_tokenizer(spark, vocab, directory, meta)
    sinks.write_json(spark, meta, f"{manifest_dir}/tokenizer-{meta['name']}.json")
    return meta


# --- prepared streams
def stream_folder(root: str, corpus: str, tokenizer: str) -> str:
    return f"{root}/{corpus}/tokens/{tokenizer}"


def write_streams(spark: SparkSession, parts: dict[str, tuple[DataFrame, dict]], folder: str) -> dict[str, dict]:
    """Each part's stream as a flat file, its mask (if any) beside it, and its meta; returns the manifest's partitions."""
    out = {}
    for name, (stream, meta) in parts.items():
        written = sinks.write_stream(stream, f"{folder}/{name}.bin")
        if written != meta["tokens"]:
            raise ValueError(f"{name}: {written} items written, {meta['tokens']} counted")
        if "mask" in stream.columns:
            if (masks := sinks.write_stream(stream, f"{folder}/{name}.mask.bin", ids_col="mask", item="i1")) != written:
                raise ValueError(f"{name}: a mask of {masks} items for {written}")
        sinks.write_json(spark, meta, f"{folder}/{name}.json")
        out[name] = {"records": meta["docs"], "docs": meta["docs"], "tokens": meta["tokens"], "path": f"{folder}/{name}.bin"}
        if "assistant_tokens" in meta:
            out[name]["assistant_tokens"] = meta["assistant_tokens"]
    return out


def load_stream(spark: SparkSession, folder: str, name: str, masked: bool = False) -> dict:
    """Path, mask path, length and meta of a prepared stream; whatever is missing raises, and so does a length that
    its meta contradicts."""
    paths = {"path": f"{folder}/{name}.bin", "meta": f"{folder}/{name}.json"} | ({"mask": f"{folder}/{name}.mask.bin"} if masked else {})
    if missing := [p for p in paths.values() if not exists(spark, p)]:
        raise FileNotFoundError(f"{name}: {missing}")
    meta, n = readers.manifest(spark, paths["meta"]), readers.stream_length(spark, paths["path"])
    if meta["tokens"] != n or masked and readers.stream_length(spark, paths["mask"], "i1") != n:
        raise ValueError(f"{name}: lengths of stream, mask and meta differ")
    return {**paths, "meta": meta, "length": n}


def prepared_manifest(dataset: str, source: dict, source_path: str, splits: list[str], tokenizer: str, vocab_size: int, partitions: dict, **more) -> dict:
    """The manifest of a prepared corpus, with the tokens of all its partitions."""
    return {
        "dataset": dataset,
        "source": {k: source.get(k) for k in ("dataset", "license", "revision", "upstream")} | {"governed_splits_used": list(splits), "test_excluded": "test" not in splits, "governed_manifest": source_path},
        "tokenizer": {"name": tokenizer, "vocab_size": vocab_size},
        "partitions": partitions,
        "total_tokens": sum(p["tokens"] for p in partitions.values()),
        "processed_at": now(),
        **more,
    }


# --- reports
def sizing_report(micro_batch: int, accumulation: int, seq_len: int, steps: int, adapter_params: int, model_params: int | None = None, domain_tokens: int | None = None, epochs: int = 3, peak_flops: float = 380e12, utilisation: float = 0.10) -> dict:
    """Batch and budget of a run, its trainable parameters and, with the corpus's tokens, FLOPs and seconds
    (4 a parameter and token, as the base is frozen)."""
    batch = micro_batch * accumulation * seq_len
    out = {"effective_batch_tokens": batch, "max_steps": steps, "budget_tokens": batch * steps, "lora_trainable_params": adapter_params, "flops_estimate": None, "wall_time_estimate_s": None}
    if domain_tokens and model_params:
        flops = 4.0 * model_params * domain_tokens * epochs
        out |= {"domain_tokens": domain_tokens, "flops_estimate": flops, "wall_time_estimate_s": flops / (peak_flops * utilisation)}
    return out


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
