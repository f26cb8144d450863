"""Flat files of whole numbers as a Spark data source, ``flat_stream``: committed writes, reads by ranges of items.

    docs.select("stream_start", "ids").write.format("flat_stream").option("path", p).mode("overwrite").save()
    spark.read.format("flat_stream").option("path", p).load()      # position, token

Written are rows (stream_start, ids) in ranges of the stream, each range in order. Every attempt of a task writes a file of
its own in the run's own folder, and tells what it holds when it ends; only what successful attempts told is
committed. The commit checks that the ranges follow one another from item 0 on, joins their files as bytes in that
order, checks the size and then puts the file in place. A run that fails leaves the old file as it was; what
it left behind is never read. ``layout=parts`` joins nothing: the files stay in a folder with an index, for streams too long for
one file; it is read in the same way.

Options: path (any store that pyarrow reaches); item, i4 (default) or i1; layout, file (default) or parts; range_items,
items of a read's partition. A number beyond its item's type raises. Documents without items weigh nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "flat_stream"
_INDEX = "index.json"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    """What an attempt wrote: a file's name, its first item's place and its items; start is None without rows."""

    file: str
    start: int | None
    items: int


@dataclass
class Range(InputPartition):
    """Items of one file, and the place of the first in the stream."""

    file: str
    first: int
    items: int
    position: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, item: str, layout: str):
        if layout not in ("file", "parts"):
            raise ValueError(f"unknown layout {layout}")
        self.path, self.dtype, self.layout = path, np.dtype(item), layout
        self.run = f"{path}.run-{uuid.uuid4().hex}"

    def write(self, iterator) -> Part:
        store, folder = _store(self.run)
        name = uuid.uuid4().hex  # an attempt's own
        store.create_dir(folder)
        start, items, bounds = None, 0, np.iinfo(self.dtype)
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                ids = batch.column(1)
                sizes = np.diff(np.asarray(ids.offsets)) if len(ids) else np.zeros(0, np.int64)
                places = np.asarray(batch.column(0)) if len(ids) else sizes
                values = np.asarray(ids.flatten())
                if len(values) != sizes.sum():
                    raise ValueError("a document's ids must not be null")
                if len(ids):
                    start = int(places[0]) if start is None else start
                    due = start + items + np.cumsum(sizes) - sizes
                    if not np.array_equal(places, due):
                        raise ValueError("documents must follow one another in the stream")
                if len(values) and (values.min() < bounds.min or values.max() > bounds.max):
                    raise ValueError(f"a number lies outside {self.dtype}")
                out.write(values.astype(self.dtype).tobytes())
                items += len(values)
        return Part(name, start, items)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.items), key=lambda m: m.start)
        at = 0
        for p in parts:
            if p.start != at:
                raise ValueError(f"the stream has no items from {min(at, p.start)} on, or has them twice")
            at += p.items
        store, folder = _store(self.run)
        _, target = _store(self.path)
        if self.layout == "parts":
            store.create_dir(folder)
            used = {p.file for p in parts}
            for m in messages:
                if m is not None and m.file not in used:
                    store.delete_file(f"{folder}/{m.file}")
            with store.open_output_stream(f"{folder}/{_INDEX}") as out:
                out.write(json.dumps({"item": self.dtype.str, "parts": [{"file": p.file, "items": p.items} for p in parts]}).encode())
            _replace(store, folder, target)
            return
        whole = f"{folder}.joined"
        with store.open_output_stream(whole) as out:
            for p in parts:
                with store.open_input_stream(f"{folder}/{p.file}") as part:
                    while block := part.read(1 << 22):
                        out.write(block)
        if store.get_file_info(whole).size != at * self.dtype.itemsize:
            raise ValueError(f"{whole}: not the size of {at} items")
        _replace(store, whole, target)
        _remove(store, folder)

    def abort(self, messages) -> None:
        store, folder = _store(self.run)
        _remove(store, folder)


def _remove(store, path: str) -> None:
    from pyarrow.fs import FileType

    kind = store.get_file_info(path).type
    if kind == FileType.Directory:
        store.delete_dir(path)
    elif kind == FileType.File:
        store.delete_file(path)


def _replace(store, source: str, target: str) -> None:
    _remove(store, target)
    store.move(source, target)


def layout_of(path: str, item: str) -> list[tuple[str, int]]:
    """(file, items) of a stream in order, of either layout; a size that is no multiple of an item, or that the index
    contradicts, raises."""
    from pyarrow.fs import FileType

    width = np.dtype(item).itemsize
    store, name = _store(path)
    info = store.get_file_info(name)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == FileType.File:
        if info.size % width:
            raise ValueError(f"{path}: {info.size} bytes are no multiple of {width}")
        return [(name, info.size // width)]
    with store.open_input_stream(f"{name}/{_INDEX}") as f:
        index = json.loads(f.read())
    if np.dtype(index["item"]) != np.dtype(item):
        raise ValueError(f"{path} holds items of type {index['item']}")
    for p in index["parts"]:
        if store.get_file_info(f"{name}/{p['file']}").size != p["items"] * width:
            raise ValueError(f"{path}: {p['file']} has another size than the index says")
    return [(f"{name}/{p['file']}", p["items"]) for p in index["parts"]]


class Reader(DataSourceReader):
    def __init__(self, path: str, item: str, range_items: int):
        self.path, self.item, self.range_items = path, item, range_items

    def partitions(self) -> list[Range]:
        out, position = [], 0
        for file, items in layout_of(self.path, self.item):
            for at in range(0, items, self.range_items):
                some = min(self.range_items, items - at)
                out.append(Range(file, at, some, position))
                position += some
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        width = np.dtype(self.item).itemsize
        if not partition.items:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            for at in range(0, partition.items, 1 << 16):
                n = min(1 << 16, partition.items - at)
                raw = f.read_at(n * width, (partition.first + at) * width)
                if len(raw) != n * width:
                    raise ValueError(f"{partition.file} ends early")
                place = partition.position + at
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(place, place + n)), pa.array(np.frombuffer(raw, self.item).astype(np.int32))], names=["position", "token"])


class FlatStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "position long, token int"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("item", "i4"), int(self.options.get("range_items", 1 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        kinds = [f.dataType.simpleString() for f in schema.fields]
        if len(kinds) != 2 or kinds[0] != "bigint" or kinds[1] not in ("array<int>", "array<tinyint>", "array<bigint>", "array<smallint>"):
            raise ValueError("rows must be (stream_start long, ids array of whole numbers)")
        if not overwrite:
            raise ValueError("a stream is written whole: use the mode overwrite")
        return Writer(self.options["path"], self.options.get("item", "i4"), self.options.get("layout", "file"))


def register(spark: SparkSession) -> None:
    """Make the source known to a session; its code travels with it."""
    if not getattr(spark, "_loom_flat", False):
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        spark.dataSource.register(FlatStream)
        spark._loom_flat = True
