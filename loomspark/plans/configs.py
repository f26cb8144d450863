"""Checks of configuration files by tables: what each key may hold, and what must hold between keys.

A ``Section`` lists its keys with kind, bounds and default. ``checked`` fills in defaults and reports all faults of a
file at once, each with its place.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators.metrics import parameter_count
from ..sources import readers

_OPS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
_NEEDED = object()
_KINDS = {"whole": int, "number": (int, float), "text": str, "flag": bool, "texts": list, "numbers": list, "table": dict, "any": object}


class ConfigError(ValueError):
    """All faults of a configuration."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class Key:
    """kind: a name of ``_KINDS``; bounds: such as ">= 1"; among: allowed values, of a list's items too. A default of None may
    be given as such."""

    kind: str
    default: object = _NEEDED
    bounds: tuple[str, ...] = ()
    among: tuple | None = None

    def faults(self, place: str, value: object) -> list[str]:
        if value is None and self.default is None:
            return []
        if not isinstance(value, _KINDS[self.kind]) or isinstance(value, bool) and self.kind in ("whole", "number"):
            return [f"{place} must be of kind {self.kind}"]
        out = []
        for bound in self.bounds:
            op, limit = bound.split()
            if not _OPS[op](value if not isinstance(value, str | list | dict) else len(value), float(limit)):
                out.append(f"{place} must be {bound}")
        items = value if isinstance(value, list) else [value]
        if self.among is not None and any(x not in self.among for x in items):
            out.append(f"{place} must be among {list(self.among)}")
        if self.kind in ("texts", "numbers") and not all(isinstance(x, str if self.kind == "texts" else (int, float)) for x in items):
            out.append(f"{place} must hold {self.kind}")
        return out


@dataclass(frozen=True)
class Section:
    """keys: by name, sections among them; rules: (what is wrong, whether it holds of the filled-in section); optional: may be null or missing."""

    keys: dict[str, Key | Section]
    rules: tuple[tuple[str, Callable[[dict], bool]], ...] = ()
    optional: bool = False

    def read(self, data: object, place: str, faults: list[str]) -> dict | None:
        if data is None and self.optional:
            return None
        if not isinstance(data, dict):
            faults.append(f"{place or 'the file'} must be a table")
            return None
        at, before, out = (lambda k: f"{place}.{k}" if place else k), len(faults), {}
        faults += [f"{at(k)} is unknown" for k in sorted(set(data) - set(self.keys))]
        for name, key in self.keys.items():
            if isinstance(key, Section):
                out[name] = key.read(data.get(name), at(name), faults)
            elif name in data:
                faults += key.faults(at(name), data[name])
                out[name] = data[name]
            elif key.default is _NEEDED:
                faults.append(f"{at(name)} is missing")
            else:
                out[name] = key.default
        if len(faults) == before:  # rules speak of sound keys only
            faults += [f"{place or 'the file'}: {what}" for what, holds in self.rules if not holds(out)]
        return out


def checked(section: Section, data: dict, place: str = "") -> dict:
    """The section with its defaults; all faults raise together."""
    faults: list[str] = []
    out = section.read(data, place, faults)
    if faults:
        raise ConfigError(faults)
    return out


def read(spark: SparkSession, section: Section, path: str) -> dict:
    """A configuration from a JSON file in any store."""
    return checked(section, readers.manifest(spark, path))


def read_local(section: Section, path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return checked(section, json.load(f))


def _whole(low: int, default: object = _NEEDED) -> Key:
    return Key("whole", default, (f">= {low}",))


_FRACTION = (">= 0", "< 1")
#: Names that low-rank adapters may take (fixed values).
PROJECTIONS = ("q_proj", "k_proj", "v_proj", "o_proj")
_SPLITS = (("test is not for training", lambda c: "test" not in c["splits"]),)

MODEL = Section(
    {
        "vocab_size": _whole(8),
        "hidden_size": _whole(8),
        "max_position_embeddings": _whole(8),
        "num_hidden_layers": _whole(1),
        "num_attention_heads": _whole(1),
        "intermediate_size": _whole(1),
        "tie_word_embeddings": Key("flag", True),
        "activation": Key("text", "gelu", among=("gelu", "relu")),
        "dropout": Key("number", 0.0, _FRACTION),
        "parameters": Key("numbers", None, (">= 2", "<= 2")),
    },
    (
        ("the width must be a multiple of the heads", lambda c: c["hidden_size"] % c["num_attention_heads"] == 0),
        ("the parameters lie outside their range", lambda c: c["parameters"] is None or c["parameters"][0] <= parameters_of(c) <= c["parameters"][1]),
    ),
)
BATCHES = {"seq_len": _whole(1), "micro_batch_size": _whole(1), "grad_accum_steps": _whole(1), "max_steps": _whole(1)}
SCHEDULE = {
    "peak_lr": Key("number", 3e-4, ("> 0",)),
    "warmup_steps": _whole(0, 0),
    "min_lr_ratio": Key("number", 0.1, _FRACTION),
    "weight_decay": Key("number", 0.1, (">= 0", "<= 1")),
    "grad_clip": Key("number", 1.0, ("> 0",)),
}
EVENTS = {"log_every": _whole(1, 1), "val_every": _whole(0, 0), "val_blocks": _whole(1, 1), "ckpt_every": _whole(0, 0), "peak_flops": Key("number", 380e12, ("> 0",))}
TRAIN = Section({**BATCHES, **SCHEDULE, **EVENTS})
#: Where a warm-up must end before the run does.
STRICT_TRAIN = Section(TRAIN.keys, (("the warm-up must be shorter than the run", lambda c: c["warmup_steps"] < c["max_steps"]),))
ADAPTERS = Section({"rank": _whole(1), "alpha": _whole(1), "dropout": Key("number", 0.0, _FRACTION), "target_modules": Key("texts", _NEEDED, (">= 1",), PROJECTIONS)}, optional=True)
TOKENIZER = Section(
    {
        "name": Key("text", _NEEDED, ("> 0",)),
        "corpus": Key("text", _NEEDED, ("> 0",)),
        "split": Key("text", "train"),
        "vocab_size": _whole(4),
        "min_frequency": _whole(1, 2),
        "max_docs": Key("whole", None, ("> 0",)),
    }
)
DATA = Section({"corpus": Key("text", _NEEDED, ("> 0",)), "splits": Key("texts", ["train", "validation"], (">= 1",)), "tokenizer": Key("text", _NEEDED, ("> 0",))}, _SPLITS)
PRETRAIN = Section(
    {"run_name": Key("text", _NEEDED, ("> 0",)), "data": DATA, "model": MODEL, "train": TRAIN},
    (("sequences must fit the model's positions", lambda c: c["train"]["seq_len"] <= c["model"]["max_position_embeddings"]),),
)
TUNING = Section(
    {
        "run_name": Key("text", _NEEDED, ("> 0",)),
        "model_path": Key("text", _NEEDED, ("> 0",)),
        "kind": Key("text", "base", among=("base", "tiny")),
        "chat_template": Key("text", "chat"),
        "quantised": Key("flag", False),
        "adapter": ADAPTERS,
        "train": TRAIN,
        "splits": Key("texts", ["train"], (">= 1",)),
        "general_corpora": Key("texts", []),
        "most_positions": _whole(8, 32_768),
    },
    (
        *_SPLITS,
        ("sequences must have 8 tokens or more, and no more than the model's positions", lambda c: 8 <= c["train"]["seq_len"] <= c["most_positions"]),
        ("the small model takes the small template and is tuned in full", lambda c: c["kind"] != "tiny" or c["chat_template"] == "tiny" and c["adapter"] is None),
        ("a quantised model needs adapters", lambda c: not c["quantised"] or c["adapter"] is not None),
    ),
)
PREPARATION = Section({"corpus": Key("text", _NEEDED, ("> 0",)), "splits": Key("texts", _NEEDED, (">= 1",)), "val_frac": Key("number", 0.05, ("> 0", "< 1")), "seed": Key("whole", 42)}, _SPLITS)


def parameters_of(model: dict) -> int:
    """Parameters of a checked model section."""
    return parameter_count(model["vocab_size"], model["hidden_size"], model["num_hidden_layers"], model["intermediate_size"], model["max_position_embeddings"], model["tie_word_embeddings"])


def tokens_of(train: dict) -> tuple[int, int]:
    """Tokens of a batch and of the whole run of a checked train section."""
    batch = train["seq_len"] * train["micro_batch_size"] * train["grad_accum_steps"]
    return batch, batch * train["max_steps"]


def reference_model(config: dict | None) -> dict | None:
    """Parameters of embedding and head of another model by its own config.json; None where it doesn't tell its sizes."""
    sizes = {k: (config or {}).get(k) for k in ("vocab_size", "hidden_size")}
    if not all(sizes.values()):
        return None
    tied = bool(config.get("tie_word_embeddings"))
    return {**sizes, "tie_word_embeddings": tied, "embedding_lm_head_params": sizes["vocab_size"] * sizes["hidden_size"] * (1 if tied else 2)}
