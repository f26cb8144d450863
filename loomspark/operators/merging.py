"""BPE training over a distributed word table, in rounds of merges that can't disturb each other.

The words lie in a table as arrays of symbols with their counts, the pairs' counts in another, which is kept up to date by
differences. A round takes the most frequent pairs in order, as many as keep apart: a pair (c, d) may follow (a, b)
if c isn't b and d isn't a, so merging the one neither makes nor breaks an occurrence of the other. All of them are merged
in one pass over the words. Their differences carry the step that makes them, so the counts at every step are known; if a
new pair would have come before a later one of the round, the round ends before that step, and the rest is dropped.
So merges come out in the order of one at a time, and the driver holds the most frequent pairs of a round only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Tables, drop_table, materialize


def matches(sym: np.ndarray, word: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where one of ``pairs`` (two columns; they keep apart) begins, from left to right without overlap, and which."""
    if len(sym) < 2 or not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = (np.zeros(max(int(sym.max()), int(pairs.max())) + 1, bool) for _ in range(2))
    left[pairs[:, 0]], right[pairs[:, 1]] = True, True
    hit = np.flatnonzero(left[sym[:-1]] & right[sym[1:]] & (word[:-1] == word[1:]))  # few are looked up
    code, known = sym[hit] << 32 | sym[hit + 1], pairs[:, 0] << 32 | pairs[:, 1]
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], code), len(known) - 1)
    some = known[order][at] == code
    hit, which = hit[some], order[at[some]]
    # Only a pair of equals overlaps itself: of a run the first, third, ... place.
    chained = np.concatenate([[False], (hit[1:] == hit[:-1] + 1) & (which[1:] == which[:-1])]) if len(hit) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(hit)))) if len(hit) else hit
    keep = (np.arange(len(hit)) - head) % 2 == 0
    return hit[keep], which[keep]


def merged(sym: np.ndarray, word: np.ndarray, at: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their words after the merges at some places."""
    out = sym.copy()
    out[at] = new
    keep = np.ones(len(sym), bool)
    keep[at + 1] = False
    return out[keep], word[keep]


def differences(sym: np.ndarray, word: np.ndarray, n: np.ndarray, at: np.ndarray, which: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step, left, right, difference) of the pairs' counts when merges are made in the order of their numbers; n: count of
    each symbol's word."""
    length = len(sym)
    owner = np.full(length, -1, np.int64)  # the merge that a place takes part in
    owner[at], owner[at + 1] = which, which
    opens = np.zeros(length, bool)
    opens[at] = True
    weight, new = n[at], first_new + which
    rows = [(which, sym[at], sym[at + 1], -weight)]
    left = np.flatnonzero((at > 0) & (word[np.maximum(at - 1, 0)] == word[at]))
    x = at[left] - 1
    # What stands before is merged already if its merge comes earlier, or is the same one (left to right).
    earlier = (owner[x] >= 0) & ~opens[x] & (owner[x] <= which[left])
    a = np.where(earlier, first_new + owner[x], sym[x])
    rows += [(which[left], a, sym[at[left]], -weight[left]), (which[left], a, new[left], weight[left])]
    y = np.minimum(at + 2, length - 1)
    right = np.flatnonzero((at + 2 < length) & (word[y] == word[at]))
    y = y[right]
    earlier = (owner[y] >= 0) & opens[y] & (owner[y] < which[right])
    b = np.where(earlier, first_new + owner[y], sym[y])
    rows += [(which[right], sym[at[right] + 1], b, -weight[right]), (which[right], new[right], b, weight[right])]
    return added(rows)


def added(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step, left, right, difference) in order, the differences of equal keys in one; symbols fit 27 bits, steps 9."""
    step, a, b, d = (np.concatenate(c) for c in zip(*rows))
    if not len(step):
        return step, a, b, d
    key = step << 54 | a << 27 | b
    order = np.argsort(key)
    key, d = key[order], d[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    d = np.add.reduceat(d, head)
    key, d = key[head][d != 0], d[d != 0]
    return key >> 54, key >> 27 & (1 << 27) - 1, key & (1 << 27) - 1, d


def added_up(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The differences of many batches as those of few: what a task has found is added before it is sent."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows > 2 * most:
            held = [added(held)]
            rows = len(held[0][0])
            if rows > most:
                yield held[0]
                held, rows = [], 0
    if held:
        yield added(held)


def apart(top: list[tuple[int, int, int]], most: int, merges_to: dict[bytes, int], tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """The longest beginning of (count, left, right) whose pairs keep apart and make tokens that are new and unlike."""
    out, lefts, rights, made = [], set(), set(), set()
    for n, a, b in top[:most]:
        token = tokens[a] + tokens[b]
        known = token in merges_to or token in made
        if out and (a in rights or b in lefts or known):
            break
        out.append((n, a, b))
        if known:  # its pairs have counts already: alone in its round
            break
        lefts.add(a), rights.add(b), made.add(token)
    return out


_BLOCK = "syms binary, size binary, n binary"


def _block(sym: np.ndarray, size: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Words as one row: their symbols one behind the other (int32), their sizes (int32) and counts (int64). The JVM passes it on as it is."""
    kinds = zip((sym, size, n), (np.int32, np.int32, np.int64))
    return pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in kinds], names=["syms", "size", "n"])


class _Words:
    """The word table, some thousand words a row, and merges that its rows still lack."""

    def __init__(self, table: DataFrame):
        self.table, self.lacks = table, []

    def lay_out(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Symbols, their words and the words' counts of each row, with all merges."""
        for batch in batches:
            for i in range(batch.num_rows):
                sym, size, n = (np.frombuffer(c[i].as_py(), k) for c, k in zip(batch.columns, (np.int32, np.int32, np.int64)))
                sym, word = sym.astype(np.int64), np.repeat(np.arange(len(size)), size)
                for pairs, new in self.lacks:
                    at, which = matches(sym, word, pairs)
                    if len(at):
                        sym, word = merged(sym, word, at, new[which])
                yield sym, word, n

    def differences(self, pairs: np.ndarray, first_new: int) -> DataFrame:
        lay_out = self.lay_out

        def of(words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            sym, word, n = words
            at, which = matches(sym, word, pairs)
            return differences(sym, word, n[word], at, which, first_new)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in added_up(map(of, lay_out(batches))):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["step", "a", "b", "d"])

        return self._without_table(run, "step long, a long, b long, d long")

    def counts(self) -> DataFrame:
        lay_out = self.lay_out

        def of(words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            sym, word, n = words
            inside = np.flatnonzero(word[:-1] == word[1:])
            return added([(np.zeros(len(inside), np.int64), sym[inside], sym[inside + 1], n[word[inside]])])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, *columns in added_up(map(of, lay_out(batches))):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "d"])

        return self._without_table(run, "a long, b long, d long")

    def written(self) -> None:
        """Put the merges that the rows lack into a new table."""
        lay_out = self.lay_out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for sym, word, n in lay_out(batches):
                size = np.bincount(word, minlength=len(n))
                yield _block(sym[size[word] > 1], size[size > 1], n[size > 1])  # a word of one symbol has no pairs

        old = self.table
        self.table = materialize(self._without_table(run, _BLOCK))
        self.lacks = []
        drop_table(old)

    def _without_table(self, run, schema: str) -> DataFrame:
        table, self.table = self.table, None  # the functions go to workers, the table doesn't
        try:
            return table.mapInArrow(run, schema)
        finally:
            self.table = table


def train_in_rounds(counts: DataFrame, alphabet: tuple[int, ...], first_id: int, vocab_size: int, min_frequency: int = 2, top: int = 256, every: int = 8) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids by token and merges in order from (pretoken, n): the most frequent pair first, ties to the smaller pair of ids.

    top: pairs that the driver looks at in a round; every: rounds after which tables are written anew.
    """
    tokens = [bytes([b]) for b in alphabet]
    ids = {t: first_id + k for k, t in enumerate(tokens)}
    code = np.empty(256, np.int32)
    code[list(alphabet)] = np.arange(256)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).cast(pa.large_binary())
            off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
            size = np.diff(off)
            yield _block(code[data[off[0] : off[-1]]][np.repeat(size > 1, size)], size[size > 1], np.asarray(batch.column(1))[size > 1])

    merges: list[tuple[bytes, bytes]] = []
    spark = counts.sparkSession
    with Tables(spark):
        words = _Words(materialize(counts.select("pretoken", "n").mapInArrow(symbols, _BLOCK)))
        summed = lambda parts: parts.groupBy("a", "b").agg(F.sum("d").alias("d")).where("d > 0")
        base = materialize(summed(words.counts()))
        changes: list[DataFrame] = []
        while first_id + len(ids) < vocab_size:
            now = base
            for c in changes:
                now = now.unionByName(c.select("a", "b", "d"))
            now = summed(now) if changes else base
            if len(changes) >= every:
                old, base = [base, *changes], materialize(now)
                drop_table(*old)
                changes, now = [], base
                words.written()
            best = [(r.d, r.a, r.b) for r in now.where(F.col("d") >= max(1, min_frequency)).orderBy(F.desc("d"), "a", "b").limit(top).collect()]
            some = apart(best, vocab_size - first_id - len(ids), ids, tokens)
            if not some:
                break
            pairs = np.array([(a, b) for _, a, b in some], np.int64)
            known = ids.get(tokens[some[0][1]] + tokens[some[0][2]])
            first_new = len(tokens) if known is None else known - first_id
            d = materialize(words.differences(pairs, first_new).groupBy("step", "a", "b").agg(F.sum("d").alias("d")))
            some = some[: _sound(d, some, first_new)] if len(some) > 1 else some
            for _, a, b in some:
                token = tokens[a] + tokens[b]
                merges.append((tokens[a], tokens[b]))
                if token not in ids:
                    ids[token] = first_id + len(tokens)
                    tokens.append(token)
            changes.append(d.where(F.col("step") < len(some)))
            changes[-1]._loom_path = d._loom_path
            words.lacks.append((pairs[: len(some)], first_new + np.arange(len(some))))
    return ids, merges


def _sound(d: DataFrame, some: list[tuple[int, int, int]], first_new: int) -> int:
    """How many of a round's merges are next in turn: none of the pairs made before comes before them."""
    new = (F.col("a") >= first_new) | (F.col("b") >= first_new)
    upto = F.sum("d").over(Window.partitionBy("a", "b").orderBy("step"))
    rows = d.where(new).withColumn("upto", upto).where(F.col("upto") >= some[-1][0]).select("step", "a", "b", "upto").collect()
    sound = len(some)
    for r in rows:
        # From its step on the pair has this count, until a later row of it says otherwise.
        until = min((q.step for q in rows if (q.a, q.b) == (r.a, r.b) and q.step > r.step), default=len(some))
        for k in range(r.step + 1, min(until + 1, sound)):
            n, a, b = some[k]
            if (-r.upto, r.a, r.b) < (-n, a, b):
                sound = k
                break
    return sound
