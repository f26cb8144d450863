"""Records that span lines, read by ranges of bytes: JSON arrays and CSV with quoted line breaks.

Spark's text scan cuts files of any store into ranges and these into pieces at a separator: the closing brace of an
object, or the end of a line. Whether a piece lies within a string or a quoted field, and how deep, hangs on all
pieces before it, but each piece turns every state it may begin in into one that it ends in, and such functions
compose. So a first scan gives each range's function and how many records would end in it; a small table of ranges
is walked for each file, which tells each range the state it begins in and the number of its first record; and a
second scan cuts the records. Only records that span ranges are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

_IN_STRING = re.compile(r'["\\]')


class JsonObjects:
    """Pieces end at a closing brace; a record ends with an object that is an element of the outermost array.

    States: outside of strings, within one, behind a backslash within one.
    """

    separator, states, target = "}", 3, 2

    @staticmethod
    def walk(text: str, state: int) -> tuple[int, int]:
        """State behind the text, and by how much it is deeper there."""
        depth, i, n = 0, 0, len(text)
        if state == 2:
            if not n:
                return 2, 0
            i, state = 1, 1
        while True:
            if state:
                found = _IN_STRING.search(text, i)
                if not found:
                    return 1, depth
                i = found.end()
                if found[0] == "\\":
                    if i == n:
                        return 2, depth
                    i += 1
                    continue
            j = text.find('"', i)
            some = text[i:j] if j >= 0 else text[i:]
            depth += some.count("{") + some.count("[") - some.count("}") - some.count("]")
            if j < 0:
                return 0, depth
            i, state = j + 1, 1

    def step(self, value: str, first: bool, state: int, depth: int) -> tuple[int, int, list[tuple[str, bool]]]:
        """State and depth behind a piece, and its parts, each with whether a record may end behind it (where the depth
        before it is the target)."""
        if first:
            state, more = self.walk(value, state)
            return state, depth + more, [(value, False)]
        if state:
            whole = "}" + value
            state, more = self.walk(whole, state)
            return state, depth + more, [(whole, False)]
        state, more = self.walk(value, 0)
        return state, depth - 1 + more, [("}", True), (value, False)]


class CsvRows:
    """Pieces are lines; a record ends with a line that ends outside of quotes. Blank lines between records are none.

    States: at a record's start, within a quoted field.
    """

    separator, states, target = "\n", 2, 0

    @staticmethod
    def walk(line: str, inside: bool) -> bool:
        """Whether a quoted field goes on behind the line. Quotes are special at a field's start and within a quoted field."""
        i, n = 0, len(line)
        quoted = inside or line[:1] == '"'
        if quoted and not inside:
            i = 1
        while True:
            while quoted:
                j = line.find('"', i)
                if j < 0:
                    return True
                quoted = line[j + 1 : j + 2] == '"'
                i = j + 2 if quoted else j + 1
            k = line.find(",", i)
            if k < 0:
                return False
            i = k + 1
            if line[i : i + 1] == '"':
                quoted, i = True, i + 1
            if i >= n and not quoted:
                return False

    def step(self, value: str, first: bool, state: int, depth: int) -> tuple[int, int, list[tuple[str, bool]]]:
        if not state and not value.strip("\r"):
            return 0, 0, []
        if ('"' not in value and not state) or not self.walk(value, bool(state)):
            return 0, 0, [(value, True)]
        return 1, 0, [(value + "\n", False)]


def few(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of a column's strings, or of one row: Python holds no more than these as objects."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, i = np.cumsum(size, dtype=np.int64), 0
        while i < len(upto):
            j = max(i + 1, min(i + 1000, int(np.searchsorted(upto, upto[i] - size[i] + most, "right"))))
            yield batch.slice(i, j - i)
            i = j


def _ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(path, range, pieces) of rows (path, block, value) in order."""
    from itertools import groupby

    def rows():
        for batch in few(batches, 2):
            yield from zip(*(c.to_pylist() for c in batch.columns[:3]))

    for (path, block), some in groupby(rows(), key=lambda r: r[:2]):
        yield path, block, (value for _, _, value in some)


def _scan(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    text = spark.read.option("lineSep", separator).text(paths)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def records(spark: SparkSession, paths: str | list[str], kind: JsonObjects | CsvRows, read, schema: str) -> tuple[DataFrame, DataFrame]:
    """What ``read`` makes, in batches of ``schema``, of (path, r, text, open): the records of each file, numbered from 0; open: the
    file ends within it, or behind the last one (what a JSON file has behind its last object is such a record). And (path, n): how
    many of them end in each file. Records that lie within a range are read by the process that cuts them."""
    scan = _scan(spark, paths, kind.separator)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, pieces in _ranges_of(batches):
            now = [[s, 0, Counter()] for s in range(kind.states)]
            for i, value in enumerate(pieces):
                for a in now:
                    before = a[1]
                    a[0], a[1], parts = kind.step(value, block == 0 and i == 0, a[0], a[1])
                    a[2][before] += sum(ends for _, ends in parts)
            flat = [[(s, d, k, n) for k, n in ends.items() if n] or [(s, d, 0, 0)] for s, d, ends in now]
            columns = [pa.array([path] * kind.states), pa.array([block] * kind.states), pa.array(range(kind.states), pa.int32()), pa.array([x[0][0] for x in flat], pa.int32()), pa.array([x[0][1] for x in flat], pa.int64())]
            counts = pa.array([[{"depth": k, "n": n} for _, _, k, n in x] for x in flat], pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*columns, counts], names=["path", "block", "begins", "ends", "deeper", "counts"])

    functions = scan.mapInArrow(summed, "path string, block long, begins int, ends int, deeper long, counts array<struct<depth:long,n:long>>")

    def walked(table: pd.DataFrame) -> pd.DataFrame:
        """A file's ranges in order: the state, depth and record that each begins with, and whether it is the last."""
        state, depth, r, out, path = 0, 0, 0, [], table["path"].iloc[0]
        known = {(b, s): rest for b, s, *rest in table[["block", "begins", "ends", "deeper", "counts"]].itertuples(index=False)}
        blocks = sorted({b for b, _ in known})
        for block in blocks:
            ends, deeper, counts = known[block, state]
            upto = r + sum(c["n"] for c in counts if c["depth"] + depth == kind.target)
            out.append((path, block, state, depth, r, block == blocks[-1], upto))
            state, depth, r = ends, depth + deeper, upto
        return pd.DataFrame(out, columns=["p", "b", "state", "depth", "r", "final", "upto"])

    begins = materialize(functions.groupBy("path").applyInPandas(walked, "p string, b long, state int, depth long, r long, final boolean, upto long"))
    files = begins.where("final").select(F.col("p").alias("path"), F.col("upto").alias("n"))
    if begins.count() <= 1_000_000:  # a row for each range of 128 MB
        begins = F.broadcast(begins)
    known = scan.join(begins, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b"))).select("path", "block", "value", "state", "depth", "r", "final")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def rows():
            for batch in few(batches, 2):
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for (path, block, state, depth, r, final), some in groupby(rows(), key=lambda x: (*x[:2], *x[3:])):
            out, size, held, whole = [], 0, [], block == 0
            for i, x in enumerate(some):
                before = depth
                state, depth, parts = kind.step(x[2], block == 0 and i == 0, state, depth)
                for text, ends in parts:
                    held.append(text)
                    if ends and before == kind.target:
                        out.append((path, r, block, "".join(held), whole, False))
                        r, size, held, whole = r + 1, size + len(out[-1][3]), [], True
                if len(out) >= 1000 or size > 1 << 19:
                    yield table(out)
                    out, size = [], 0
            if any(held) and (final or "".join(held)):
                out.append((path, r, block, "".join(held), False, final))
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = (("path", pa.string()), ("r", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("whole", pa.bool_()), ("open", pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    def only(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = batch.column("whole")
            some = batch.filter(mask if whole else pc.invert(mask))
            if some.num_rows:
                yield some

    within = known.mapInArrow(lambda batches: read(x.select(["path", "r", "text", "open"]) for x in only(cut(batches), True)), schema)
    parts = known.mapInArrow(lambda batches: only(cut(batches), False), "path string, r long, block long, text string, whole boolean, open boolean")
    pieces = F.sort_array(F.collect_list(F.struct("block", "text")))
    spanning = parts.groupBy("path", "r").agg(pieces.alias("p"), F.bool_or("open").alias("open"))
    joined = spanning.select("path", "r", F.array_join(F.transform("p", lambda x: x.text), "").alias("text"), "open")
    return within.unionByName(joined.mapInArrow(read, schema)), files


def json_objects(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, r, text): the objects among the elements of each file's array, in JSON; r counts them from 0. And (path, n), the
    objects of each file. Whatever isn't JSON, or no array, raises."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, blank = json.JSONDecoder(), re.compile(r"[ \t\n\r]*")

        def parsed(text: str, first: bool, last: bool) -> str | None:
            """The object that a record ends with, None behind the last; elements before it are read, and dropped."""
            at = blank.match(text).end()
            if first and text[at : at + 1] != "[":
                raise ValueError("the top level must be an array")
            opens = first
            if first:
                at = blank.match(text, at + 1).end()
            while True:
                if text[at : at + 1] == "]" and last:
                    if blank.match(text, at + 1).end() != len(text):
                        raise ValueError("something follows the array")
                    return None
                if not opens:
                    if text[at : at + 1] != ",":
                        raise ValueError("elements must be separated by commas, and the array must end")
                    at = blank.match(text, at + 1).end()
                opens, start = False, at
                value, at = decoder.raw_decode(text, at)
                if at == len(text) and not last:
                    if not isinstance(value, dict):
                        raise ValueError("an object was expected")
                    return text[start:at]
                at = blank.match(text, at).end()

        for batch in few(batches, 2):
            path, r, text, last = (c.to_pylist() for c in batch.columns)
            found = [parsed(t, k == 0, e) for t, k, e in zip(text, r, last)]
            keep = [i for i, x in enumerate(found) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([path[i] for i in keep], pa.string()), pa.array([r[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.string())], names=["path", "r", "text"])

    return records(spark, paths, JsonObjects(), run, "path string, r long, text string")


def csv_rows(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, r, fields): rows of CSV files as lists of strings, the header (r is 0) among them. And (path, n), the rows of each
    file. A quoted field that never ends raises. Rows end with a line feed, or carriage return and line feed."""
    import csv

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 2):
            text, still = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if any(e and CsvRows.walk(t, False) for t, e in zip(text, still)):
                raise ValueError("a quoted field never ends")
            fields = list(csv.reader(text))
            if len(fields) != len(text):
                raise ValueError("a row ends within its record")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fields, pa.list_(pa.string()))], names=["path", "r", "fields"])

    return records(spark, paths, CsvRows(), run, "path string, r long, fields array<string>")


def numbered(rows: DataFrame, files: DataFrame, header: bool = False) -> DataFrame:
    """``rows`` with ``ord`` from 0: files by path, then records; headers don't count."""
    own = F.col("n") - (1 if header else 0)
    before = F.coalesce(F.sum(own).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = files.select(F.col("path").alias("_p"), before.alias("_base"))  # a row a file
    return rows.join(base, F.col("path") == F.col("_p")).withColumn("ord", F.col("_base") + F.col("r") - (1 if header else 0)).drop("_p", "_base")


def headers(spark: SparkSession, paths: str | list[str], rows: DataFrame) -> DataFrame:
    """(path, names): each file's header, from its first line, or from its first row where a name holds a line break."""
    import csv

    scan = _scan(spark, paths, "\n").where("block = 0").withColumn("i", F.monotonically_increasing_id()).where("trim(BOTH '\r' FROM value) <> ''")
    lines = materialize(scan.groupBy("path").agg(F.min_by("value", "i").alias("line")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if CsvRows.walk(x, False) else next(csv.reader([x])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["path", "names"])

    out = lines.mapInArrow(run, "path string, names array<string>")
    if out.where("names IS NULL").isEmpty():
        return out
    return rows.where("r = 0").select("path", F.col("fields").alias("names"))
