"""Datasets as configuration: where they come from, what is read, how they are split, what they may grow to.

A file is {name: {"provenance": {...}, "source": {...}, "split": {...}, "limits": {...}}}; see ``DATASET`` for the keys.
A split is an object that knows its partitions and deals rows to them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import group_split, official_split, shuffle_split
from .configs import _NEEDED, ConfigError, Key, Section, checked

DATASET = Section(
    {
        "provenance": Section({"license": Key("text"), "revision": Key("text"), "upstream": Key("text"), "notes": Key("texts", [])}),
        "source": Section(
            {"files": Key("any"), "transform": Key("text"), "schema": Key("text", None), "columns": Key("texts", None)},
            (("files must be a pattern, patterns, or patterns by split", lambda c: _globs(c["files"]) is not None),),
        ),
        "split": Section(
            {"by": Key("text", _NEEDED, among=("official", "shuffle", "group_by")), "seed": Key("whole", 42), "fractions": Key("numbers", [0.8, 0.1, 0.1], (">= 3", "<= 3")), "key": Key("text", None), "quotas": Key("table", None)},
            (
                ("group_by needs key and quotas", lambda c: c["by"] != "group_by" or bool(c["key"] and c["quotas"])),
                ("fractions must lie between 0 and 1 and sum to 1", lambda c: min(c["fractions"]) >= 0 and abs(sum(c["fractions"]) - 1) < 1e-9),
            ),
        ),
        "limits": Section({"records": Key("whole", None, ("> 0",)), "tokens": Key("whole", None, ("> 0",))}, optional=True),
    },
    (("an official split needs files by split", lambda c: c["split"]["by"] != "official" or isinstance(c["source"]["files"], dict)),),
)


def _globs(files: object) -> dict[str | None, tuple[str, ...]] | None:
    """Patterns by split; None for what is no such thing."""
    if isinstance(files, str):
        files = {None: [files]}
    elif isinstance(files, list):
        files = {None: files}
    if not isinstance(files, dict) or not files:
        return None
    out = {k: (v,) if isinstance(v, str) else tuple(v) for k, v in files.items() if isinstance(v, str | list)}
    return out if len(out) == len(files) and all(g and all(isinstance(x, str) for x in g) for g in out.values()) else None


class Split(Protocol):
    capped: bool  #: whether a cap on tokens applies to ``train``

    def partitions(self, dataset: Dataset) -> list[str]: ...

    def deal(self, rows: DataFrame, records: int | None, order: str) -> DataFrame:
        """``rows`` with partition and rank."""


@dataclass(frozen=True)
class Official:
    seed: int
    capped = True

    def partitions(self, dataset: Dataset) -> list[str]:
        return list(dataset.files)

    def deal(self, rows: DataFrame, records: int | None, order: str) -> DataFrame:
        return official_split(rows, self.seed, records, order=order)


@dataclass(frozen=True)
class Shuffled:
    seed: int
    fractions: tuple[float, float, float]
    capped = True

    def partitions(self, dataset: Dataset) -> list[str]:
        return ["train", "validation", "test"]

    def deal(self, rows: DataFrame, records: int | None, order: str) -> DataFrame:
        return shuffle_split(rows, self.fractions, self.seed, records, order=order)


@dataclass(frozen=True)
class Grouped:
    seed: int
    key: str
    quotas: dict[str, int]
    capped = False

    def partitions(self, dataset: Dataset) -> list[str]:
        return list(self.quotas)

    def deal(self, rows: DataFrame, records: int | None, order: str) -> DataFrame:
        return group_split(rows, F.col(self.key), self.quotas, self.seed)


@dataclass(frozen=True)
class Dataset:
    """One checked entry of a file of datasets."""

    name: str
    told: dict

    @property
    def files(self) -> dict[str | None, tuple[str, ...]]:
        return _globs(self.told["source"]["files"])

    def input_files(self) -> list[str]:
        """Sorted distinct patterns."""
        return sorted({p for globs in self.files.values() for p in globs})

    @property
    def split(self) -> Split:
        s = self.told["split"]
        if s["by"] == "official":
            return Official(s["seed"])
        if s["by"] == "shuffle":
            return Shuffled(s["seed"], tuple(s["fractions"]))
        return Grouped(s["seed"], s["key"], s["quotas"])

    def limit(self, of: str) -> int | None:
        return (self.told["limits"] or {}).get(of)


def dataset(name: str, data: dict) -> Dataset:
    return Dataset(name, checked(DATASET, data, name))


def load_specs(path: str) -> dict[str, Dataset]:
    """Datasets by name from a JSON file; the faults of all raise together."""
    with open(path, encoding="utf-8") as f:
        found, faults, out = json.load(f), [], {}
    for name, data in found.items():
        told = DATASET.read(data, name, faults)
        out[name] = Dataset(name, told)
    if faults:
        raise ConfigError(faults)
    return out
