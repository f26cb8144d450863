"""Suffix-array dedup: byte strings of a given length that start anywhere else lose their bytes.

A sparse suffix array is sorted by a distributed merge sort that knows common prefixes. Suffixes begin at places that the
text itself chooses: of the starts of every ``spread`` consecutive 16-byte strings the one of least hash (and each text's
start). Two equal strings of ``length`` bytes choose alike, so a copy's suffixes meet those of its original.

1. Documents are packed into batches, with their suffixes' places. Suffixes whose first bytes (as many as any equal
   string must still share with them) have a hash that no other suffix has are left out: no string through them repeats.
2. Each batch sorts what is left, cut to the bytes that matter, tells equal ones apart by a count, and deals the sorted
   run front-coded (common prefix with the one before, and the rest) to ranges of strings. Ranges are bounded by a
   bounded sample of the suffixes; a string that fills several ranges is dealt to all of them in turn.
3. A range merges its runs by a loser tree. Every loser keeps the length of the prefix that it shares with the winner it
   lost to; a suffix that shares more wins without a comparison, and equals are compared from there on, so no byte
   known to be common is looked at again. The prefix shared with the neighbours in the merged order is the longest that is
   shared with any suffix; neighbours across two ranges' border are compared by a join of the borders.
4. A suffix that shares m bytes confirms the strings that start at it, up to the (m - length)th behind. Strings
   that start before a suffix, at most ``spread`` - 1 bytes, and are not confirmed by an earlier one stay open. All
   suffixes of such a first part then send what lies before them, as texts that overlapping strings share, to ranges
   of first parts; there neighbours in the order of the strings' hashes are compared.
5. Each batch removes what is covered.

Hashes choose what is compared; bytes decide, all of them. Batches lie in a table bucketed by batch, so answers return to
them without a second shuffle of the texts. A batch sends each string once, so a copy weighs as much
as the batches that hold it.

Nulls count as empty; a text shorter than ``length`` loses nothing. Ids and other columns play no part; repeated rows repeat
each other. Texts are processed whole. An empty table gives no rows. All input columns are kept; those named like a result
column are replaced. What is kept are bytes, as a code point may lose a part.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adopted, drop_table, frugal, from_ipc, give_back, load, materialize, mix, pack_sorted, shared_dir, slices, to_ipc, unpack_sorted, utf8_buffer

_U = np.uint64
_C = _U(0x9FB21C651E98DF25)
_PIECE = 1 << 17  # places whose arrays fit a cache


def string_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the strings of ``size`` bytes at some places; data: with eight bytes to spare at its end."""
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    h = np.full(len(at), size, _U)
    for j in range(0, size, 8):
        x = eight[at + j]
        if size - j < 8:
            x = x & _U((1 << 8 * (size - j)) - 1)
        h = mix(h * _C + x)
    return h


def distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are known; ``known`` is in order, and isn't gone through."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys if len(known) else np.zeros(len(keys), bool)


def recurring(data: np.ndarray, at: np.ndarray, size: int, known: np.ndarray) -> np.ndarray:
    """Which strings of ``size`` bytes, at some places, equal one at another of the places.

    known: strings that need not be told, as they are known to recur; data: with eight bytes to spare at its end. Strings
    of one hash are neighbours, and neighbours are compared; where two are unlike, all of their hash are told apart by a count.
    """
    h = string_hashes(data, at, size)
    order = np.argsort(h, kind="stable")
    h = h[order]
    fresh = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    group = np.cumsum(fresh, dtype=np.int64) - 1
    seen = np.bincount(group)
    looked = (seen > 1) & (np.bincount(group, weights=~known[order]) > 0)  # an unlike hash is an unlike string
    order, group, fresh = (x[looked[group]] for x in (order, group, fresh))
    here, before = at[order[1:]][~fresh[1:]], at[order[:-1]][~fresh[1:]]
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    unlike = np.zeros(len(here), bool)
    for j in range(0, size, 8):
        differs = eight[here + j] ^ eight[before + j]
        unlike |= (differs if size - j >= 8 else differs & _U((1 << 8 * (size - j)) - 1)) != 0
    mixed = np.zeros(len(seen), bool)
    mixed[group[1:][~fresh[1:]][unlike]] = True
    again = known.copy()
    again[order[~mixed[group]]] = True
    if unlike.any():
        raw = data.tobytes()
        some = order[mixed[group]].tolist()
        count = Counter(strings := [raw[a : a + size] for a in at[some].tolist()])
        again[some] |= np.array([count[x] > 1 for x in strings])
    return again


def ragged_places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def chosen(data: np.ndarray, off: np.ndarray, length: int, spread: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes (place, first and last start of the strings that choose it) of all texts, in order.

    A string of ``length`` bytes at p chooses, of the places p to p + spread - 1, that whose k bytes have the least hash (of
    equals the first). A text's start is a suffix that no string need have chosen (its first start lies behind its last).
    """
    n, room = len(data), np.concatenate([data, np.zeros(spread + k + 8, np.uint8)])
    edge = np.zeros(n + 1, np.int8)  # starts whose string would cross its text's end
    size = np.diff(off)
    lose = np.maximum(off[:-1], off[1:] - length + 1)
    np.add.at(edge, lose[size > 0], 1)
    np.add.at(edge, off[1:][size > 0], -1)
    crosses = np.cumsum(edge[:-1], dtype=np.int8)
    place, first, last = [], [], []
    for c in range(0, n, _PIECE):
        upto = min(n, c + _PIECE)
        starts = np.flatnonzero(crosses[c:upto] == 0)
        if not len(starts):
            continue
        places = np.arange(c, upto + spread - 1)
        key = (string_hashes(room, places, k) >> _U(32) << _U(32)) | np.arange(len(places), dtype=_U)
        width = 1
        while width < spread:
            step = min(width, spread - width)
            key = np.minimum(key[:-step], key[step:])
            width += step
        b = c + (key[starts] & _U(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        p = c + starts
        tail = np.append(head[1:], len(p)) - 1
        place.append(b[head]), first.append(p[head]), last.append(p[tail])
    begun = off[:-1][size >= length]
    b, lo, hi = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (place, first, last))
    if len(b):  # what two pieces share is one suffix
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        b, lo, hi = b[head], lo[head], hi[np.append(head[1:], len(hi)) - 1]
    more = begun[~np.isin(begun, b)]
    b, lo, hi = np.concatenate([b, more]), np.concatenate([lo, more + 1]), np.concatenate([hi, more])
    order = np.argsort(b, kind="stable")
    return b[order], lo[order], hi[order]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of strings. Iterating gives, in order, (run, prefix shared with the string given before).

    runs: lists of strings; shared: for each run the prefixes that its strings share with those before them.
    ``compared`` counts comparisons of bytes.
    """

    def __init__(self, runs: list[list[bytes]], shared: list[list[int]]):
        self.runs, self.shared, self.compared = runs, shared, 0
        self.width = 1
        while self.width < len(runs):
            self.width *= 2

    def __iter__(self) -> Iterator[tuple[int, int]]:
        width, runs, shared = self.width, self.runs, self.shared
        now: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (width - len(runs))
        at = [0] * len(runs)
        loser, knows = [0] * width, [0] * width  # who lost at a node, and what it shares with the winner there
        seat = [*([0] * width), *range(width)]
        for node in range(width - 1, 0, -1):
            a, b = seat[2 * node], seat[2 * node + 1]
            x, y = now[a], now[b]
            if y is None or x is None:
                won, lost, m = (b, a, -1) if x is None else (a, b, -1)
            else:
                m = common(x, y)
                self.compared += 1
                won, lost = (a, b) if x[m:] <= y[m:] else (b, a)
            seat[node], loser[node], knows[node] = won, lost, m
        best, known = seat[1], 0
        while now[best] is not None:
            yield best, known
            i = at[best] = at[best] + 1
            run = runs[best]
            if i < len(run):
                now[best], known = run[i], shared[best][i]
            else:
                now[best], known = None, -1
            node = (best + width) >> 1
            while node:
                k = knows[node]
                if k > known:
                    best, loser[node] = loser[node], best
                    known, knows[node] = k, known
                elif k == known and k >= 0:
                    other = loser[node]
                    x, y = now[best], now[other]
                    m = common(x, y, k)
                    self.compared += 1
                    knows[node] = m
                    if y[m:] < x[m:]:
                        best, loser[node] = other, best
                node >>= 1


def longest_shared(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[np.ndarray], tuple[int, int], tuple[int, int]]:
    """For each string of each run the longest prefix that it shares with any other string of the runs, and the first and
    the last string in the merged order as (run, place)."""
    order, known = [], []
    for run, m in LoserTree(runs, shared):
        order.append(run)
        known.append(m)
    run = np.array(order, np.int64)
    m = np.array([*known, 0], np.int64)
    m[0] = 0
    most = np.maximum(m[:-1], m[1:])
    by_run = np.argsort(run, kind="stable")
    out = np.split(most[by_run], np.cumsum([len(r) for r in runs])[:-1])
    return out, (order[0], 0), (order[-1], len(runs[order[-1]]) - 1)


def front_coded(strings: list[bytes]) -> bytes:
    """A sorted run: for each string what it shares with the one before, and the rest."""
    import zstandard

    m = [0, *map(common, strings, strings[1:])]
    rest = [s[k:] for s, k in zip(strings, m)]
    sizes = np.array([[len(strings), 0], *zip(m, map(len, rest))], np.uint32)
    return zstandard.compress(sizes.tobytes() + b"".join(rest), 3)


def decoded(raw: bytes) -> tuple[list[bytes], list[int]]:
    import zstandard

    data = zstandard.decompress(raw)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    sizes = np.frombuffer(data, np.uint32, 2 * n, 8).reshape(n, 2).tolist()
    out, at, before = [], 8 + 8 * n, b""
    for m, rest in sizes:
        before = before[:m] + data[at : at + rest]
        at += rest
        out.append(before)
    return out, [m for m, _ in sizes]


def dealt(strings: list[bytes], splitters: list[bytes], turn: int) -> list[tuple[int, int, int]]:
    """(range, from, to) for sorted distinct strings: a range ends before its splitter. A string that several splitters equal may lie in
    any range between them and behind; ``turn`` chooses."""
    bounds = [bisect_left(strings, s) for s in splitters]
    out, i = [], 0
    edges = [0, *bounds, len(strings)]
    while i <= len(splitters):
        a, b = edges[i], edges[i + 1]
        if i and b > a and strings[a] == splitters[i - 1]:
            same = i - bisect_left(splitters, splitters[i - 1])
            if same > 1:  # ranges i - same + 1 to i are open to it
                out.append((i - turn % same, a, a + 1))
                a += 1
        if b > a:
            if out and out[-1][0] == i:
                out[-1] = (i, out[-1][1], b)
            else:
                out.append((i, a, b))
        i += 1
    return out


class Batch:
    """The texts of a batch and their suffixes."""

    def __init__(self, rows: bytes, places: bytes, text_col: str, length: int, spread: int):
        import zstandard

        self.rows = from_ipc(rows)
        self.length, self.least = length, length - spread + 1
        data, self.off = utf8_buffer(self.rows.column(self.rows.schema.get_field_index(text_col)))
        self.size = len(data)
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        place, back, ahead = np.frombuffer(zstandard.decompress(places), np.int32).reshape(3, -1).astype(np.int64)
        self.place = np.cumsum(place)
        self.first, self.last = self.place - back, self.place - ahead
        self.doc = np.searchsorted(self.off, self.place, "right") - 1

    def names(self) -> np.ndarray:
        """Hashes of the bytes that every string shares with its suffix."""
        return string_hashes(self.data, self.place, self.least)

    def suffixes(self, which: np.ndarray) -> list[bytes]:
        """The suffixes as far as strings that start before the next one reach."""
        after = np.append(self.place[1:], 0)
        same = np.append(self.doc[1:] == self.doc[:-1], False)
        gap = np.where(same, after - self.place - 1, 0)
        stop = np.minimum(self.place + self.length + gap, self.off[self.doc + 1])
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.place[which].tolist(), stop[which].tolist())]

    def confirmed(self, which: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For every byte whether a string that starts there repeats, as far as suffixes and what they share tell."""
        long = most >= self.length
        opens = self.place[which][long]
        closes = opens + most[long] - self.length + 1
        step = np.bincount(opens, minlength=self.size + 1) - np.bincount(closes, minlength=self.size + 1)
        return np.cumsum(step[:-1], dtype=np.int32) > 0

    def before(self, which: np.ndarray, most: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix the first and last start of strings that choose it, lie before it and may repeat, and
        whether one of these is not confirmed yet (none: first lies behind last)."""
        lo, b = self.first[which], self.place[which]
        hi = np.minimum(np.minimum(self.last[which], b - 1), b - self.length + most)
        upto = np.zeros(len(known) + 1, np.int32)
        np.cumsum(known, out=upto[1:])
        some = hi >= lo
        still = np.zeros(len(which), bool)
        still[some] = upto[hi[some] + 1] - upto[lo[some]] < hi[some] - lo[some] + 1
        return lo, hi, still


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits key ranges in sorted keys."""
    edges = np.arange(1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(1, _U)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _with_flags(keys: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted keys with a bit each."""
    raw = np.packbits(flags).tobytes()
    return len(raw).to_bytes(4, "little") + raw + pack_sorted(keys)


def _flagged(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    keys = unpack_sorted(raw[4 + n :])
    return keys, np.unpackbits(np.frombuffer(raw, np.uint8, n, 4), count=len(keys)).astype(bool)


def _numbers(raw: bytes, kind: type = np.uint32) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(raw), kind)


def _squeezed(values: np.ndarray, kind: type = np.uint32) -> bytes:
    import zstandard

    return zstandard.compress(np.asarray(values, kind).tobytes(), 1)


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table bucketed by ``key``: joins on the key leave its rows where they are."""
    spark = df.sparkSession
    name, n = f"loom_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.format("parquet").options(path=path, compression="zstd").bucketBy(n, key).saveAsTable(name)
    return adopted(spark.table(name), path)


def _pack(df: DataFrame, text_col: str, length: int, spread: int, k: int, batch_bytes: int) -> DataFrame:
    """Rows (rows, places, n_bytes): documents as compressed Arrow streams of about ``batch_bytes`` of text, with the places of their suffixes."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, off = utf8_buffer(rows.column(rows.schema.get_field_index(text_col)))
            b, lo, hi = chosen(data, off, length, spread, k)
            places = np.stack([np.diff(b, prepend=0), b - lo, b - hi]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([to_ipc(rows)], pa.binary()), pa.array([zstandard.compress(places.tobytes(), 3)], pa.binary()), pa.array([len(data)])], names=["rows", "places", "n_bytes"])

        for batch in batches:
            for part in slices(batch, text_col, batch_bytes):
                if not part.num_rows:
                    continue
                held.append(part)
                size += int(utf8_buffer(part.column(part.schema.get_field_index(text_col)))[1][-1])
                if size >= batch_bytes // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return df.mapInArrow(frugal(run), "rows binary, places binary, n_bytes long")


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_PARCEL = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("body", pa.binary())])
_PARCEL_TYPE = "bucket int, batch long, body binary"


def repeated_strings(df: DataFrame, length: int = 200, spread: int = 112, text_col: str = "text", keep_text: bool = True, batch_bytes: int = 4 << 20, range_bytes: int = 24 << 20, most_samples: int = 200_000) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, removed (first and last byte of each span) and kept (bytes).

    length: of the strings that must not repeat. spread: see above; at most ``length`` less the bytes that are hashed.
    range_bytes: strings of a range, about. most_samples: suffixes that are gathered to bound the ranges, at most.
    """
    if length < 2:
        raise ValueError("length must be 2 bytes or more")
    k = min(16, max(1, length // 4))
    spread = max(1, min(spread, length - k + 1))
    own = ("n_bytes", "n_removed", "n_spans", "removed", "kept")
    df = df.drop(*[c for c in own if c != text_col])
    source, spark = df.schema, df.sparkSession
    loose = materialize(_pack(df, text_col, length, spread, k, batch_bytes))
    packed = _bucketed(loose.withColumn("batch", F.monotonically_increasing_id()), "batch")
    drop_table(loose)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(2, (max(1, total // (64 << 20)) - 1).bit_length())

    def batches_of(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            number, rows, places, *more = (c[i].as_py() for c in batch.columns)
            yield number, Batch(rows, places, text_col, length, spread), more

    # --- suffixes whose first bytes occur twice
    def name_parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, b, _ in batches_of(batch):
                keys, counts = np.unique(b.names(), return_counts=True)
                bounds = _ranges(keys, bits)
                rows = [(r, number, _with_flags(keys[x:y], counts[x:y] > 1)) for r, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
                if rows:
                    yield _frame(rows, _PARCEL)

    def known_twice(table: pa.Table) -> pa.Table:
        keys, several = zip(*map(_flagged, table.column("body").to_pylist()))
        every = np.sort(np.concatenate(keys))
        twice = distinct(np.concatenate([every[1:][every[1:] == every[:-1]], *[x[s] for x, s in zip(keys, several)]]))
        hit = [among(x, twice) for x in keys]
        give_back()
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "body": pa.array([np.packbits(x).tobytes() for x in hit], pa.binary()), "n": pa.array([int(x.sum()) for x in hit])})

    parcels = packed.select("batch", "rows", "places").mapInArrow(frugal(name_parcels), _PARCEL_TYPE)
    found = materialize(parcels.groupBy("bucket").applyInArrow(known_twice, _PARCEL_TYPE + ", n long"))
    n_shared = found.agg(F.sum("n")).first()[0] or 0
    marks = materialize(found.where("n > 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "body")).alias("shared")))
    drop_table(found)
    first = packed.select("batch", "rows", "places").join(marks, "batch", "left")

    def bits_of_names(marks: list | None, names: np.ndarray) -> np.ndarray:
        """The returned bit of each name."""
        keys = distinct(names)
        bounds, hit = _ranges(keys, bits), np.zeros(len(keys), bool)
        for m in marks or []:
            x, y = bounds[m["bucket"]], bounds[m["bucket"] + 1]
            hit[x:y] = np.unpackbits(np.frombuffer(m["body"], np.uint8), count=y - x)
        return hit[np.searchsorted(keys, names)]

    def of_interest(b: Batch, shared: list | None) -> np.ndarray:
        """Suffixes whose names occur twice."""
        return np.flatnonzero(bits_of_names(shared, b.names())) if shared else np.zeros(0, np.int64)

    # --- bounds of the ranges of strings
    n_ranges = max(1, n_shared * (length + spread // 4) // range_bytes)
    share = min(1.0, min(most_samples, 64 * n_ranges) / max(1, n_shared))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, b, (shared,) in batches_of(batch):
                which = of_interest(b, shared)
                drawn = (mix(mix(which.astype(_U)) + _U(number)) >> _U(11)).astype(np.float64) < share * (1 << 53)
                yield pa.RecordBatch.from_arrays([pa.array(b.suffixes(which[drawn]), pa.binary())], names=["s"])

    splitters: list[bytes] = []
    if n_ranges > 1:
        sample = sorted(bytes(r.s) for r in first.where("shared IS NOT NULL").mapInArrow(frugal(sampled), "s binary").collect())
        splitters = [sample[len(sample) * i // n_ranges] for i in range(1, n_ranges)] if sample else []
    bounds_of = spark.sparkContext.broadcast(splitters)

    # --- sorted runs, front-coded, and their merge
    def in_order(b: Batch, which: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct suffixes in order, the number of each of ``which`` among them, and how often each occurs."""
        strings = b.suffixes(which)
        distinct = sorted(set(strings))
        number = dict(zip(distinct, range(len(distinct))))
        code = np.fromiter(map(number.__getitem__, strings), np.int64, len(strings))
        return distinct, code, np.bincount(code, minlength=len(distinct))

    def run_parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, b, (shared,) in batches_of(batch):
                strings, _, _ = in_order(b, of_interest(b, shared))
                rows = [(r, number, front_coded(strings[x:y])) for r, x, y in dealt(strings, bounds_of.value, number)]
                if rows:
                    yield _frame(rows, _PARCEL)

    merged_type = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("most", pa.binary()), ("at", pa.int32()), ("side", pa.int32()), ("edge", pa.binary())])

    def merged(table: pa.Table) -> pa.Table:
        """What each string shares at most with another of the range, and the range's first and last string."""
        bucket, owners = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
        runs, shared = zip(*(decoded(x) for x in table.column("body").to_pylist()))
        most, *ends = longest_shared(list(runs), list(shared))
        rows = [(bucket, o, _squeezed(m), None, None, None) for o, m in zip(owners, most)]
        rows += [(bucket, owners[run], None, i, side, runs[run][i]) for side, (run, i) in enumerate(ends)]
        give_back()
        return pa.Table.from_batches([_frame(rows, merged_type)])

    runs = first.where("shared IS NOT NULL").mapInArrow(frugal(run_parcels), _PARCEL_TYPE)
    result = materialize(runs.groupBy("bucket").applyInArrow(merged, "bucket int, batch long, most binary, at int, side int, edge binary"))

    # Two rows for each range: the neighbours of its first and its last string may lie in the ranges beside it.
    along = Window.orderBy("bucket", "side")
    borders = result.where("side IS NOT NULL").select("bucket", "batch", "at", "side", "edge", F.when(F.col("side") == 0, F.lag("edge").over(along)).otherwise(F.lead("edge").over(along)).alias("beside"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, owner, at, _, edge, beside = (c.to_pylist() for c in batch.columns)
            rows = [(r, o, _squeezed(np.array([common(x, y)])), i) for r, o, i, x, y in zip(bucket, owner, at, edge, beside) if y is not None]
            yield _frame(rows, pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("most", pa.binary()), ("at", pa.int32())]))

    shared_by = result.where("side IS NULL").select("bucket", "batch", "most", F.lit(None).cast("int").alias("at")).unionByName(borders.mapInArrow(across, "bucket int, batch long, most binary, at int"))
    answers = materialize(shared_by.groupBy("batch").agg(F.collect_list(F.struct("bucket", "most", "at")).alias("longest")))
    drop_table(result)
    second = first.join(answers, "batch", "left").select("batch", "rows", "places", "shared", "longest")

    def told(number: int, b: Batch, shared: list | None, longest: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of interest, what each shares at most with another, and for each byte whether a string there is confirmed."""
        which = of_interest(b, shared)
        if not len(which):
            return which, which, np.zeros(b.size, bool)
        strings, code, count = in_order(b, which)
        pieces = dealt(strings, bounds_of.value, number)
        start = {r: x for r, x, _ in pieces}
        most = np.zeros(len(strings), np.int64)
        for m in sorted(longest, key=lambda m: m["at"] is not None):
            x, values = start[m["bucket"]] + (m["at"] or 0), _numbers(m["most"])
            most[x : x + len(values)] = np.maximum(most[x : x + len(values)], values)
        most = np.where(count > 1, [len(s) for s in strings], most)[code]
        return which, most, b.confirmed(which, most)

    # --- strings that start before their suffix: which suffixes are asked about, and what those have before them
    def question_parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, b, more in batches_of(batch):
                which, most, known = told(number, b, *more)
                _, _, still = b.before(which, most, known)
                keys, code = np.unique(b.names()[which], return_inverse=True)
                asks = np.bincount(code, weights=still, minlength=len(keys)) > 0
                bounds = _ranges(keys, bits)
                rows = [(r, number, _with_flags(keys[x:y], asks[x:y])) for r, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
                if rows:
                    yield _frame(rows, _PARCEL)

    def known_asked(table: pa.Table) -> pa.Table:
        keys, asked = zip(*map(_flagged, table.column("body").to_pylist()))
        every = distinct(np.concatenate([k[a] for k, a in zip(keys, asked)]))
        hit = [among(k, every) for k in keys]
        give_back()
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "body": pa.array([np.packbits(x).tobytes() for x in hit], pa.binary())})

    questions = second.where("shared IS NOT NULL").mapInArrow(frugal(question_parcels), _PARCEL_TYPE)
    asked_of = materialize(questions.groupBy("bucket").applyInArrow(known_asked, _PARCEL_TYPE).groupBy("batch").agg(F.collect_list(F.struct("bucket", "body")).alias("asked")))
    third = second.join(asked_of, "batch", "left").select("batch", "rows", "places", "shared", "longest", "asked")

    def stretches(number: int, b: Batch, shared: list | None, longest: list | None, asked: list | None):
        """Which starts are confirmed; the distinct texts of the stretches before suffixes that any batch asks about, in the order of
        their ranges, and these ranges' bounds; and for each stretch its first start and its text's number."""
        which, most, known = told(number, b, shared, longest)
        lo, hi, _ = b.before(which, most, known)
        names = b.names()[which]
        some = np.flatnonzero((hi >= lo) & bits_of_names(asked, names))
        raw = b.data.tobytes()
        texts = [raw[x : y + length] for x, y in zip(lo[some].tolist(), hi[some].tolist())]
        home = dict(zip(texts, names[some].tolist()))
        ordered = sorted(home, key=lambda t: (home[t], t))
        numbered = {t: i for i, t in enumerate(ordered)}
        code = np.fromiter(map(numbered.__getitem__, texts), np.int64, len(texts))
        bounds = _ranges(np.array([home[t] for t in ordered], _U), bits + 1)
        return known, ordered, bounds, lo[some], code

    def stretch_parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, b, more in batches_of(batch):
                _, ordered, bounds, _, _ = stretches(number, b, *more)
                rows = [(r, number, front_coded(ordered[x:y])) for r, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
                if rows:
                    yield _frame(rows, _PARCEL)

    def settled(table: pa.Table) -> pa.Table:
        """For every string of every stretch, in order, whether it occurs in another stretch of the range.

        Stretches with the same text are one, whose strings all repeat.
        """
        texts = [decoded(x)[0] for x in table.column("body").to_pylist()]
        number: dict[bytes, int] = {}
        code = [[number.setdefault(t, len(number)) for t in some] for some in texts]
        del texts
        size = np.fromiter(map(len, number), np.int64, len(number))
        count = size - length + 1
        upto = np.concatenate([[0], np.cumsum(count)])
        at = ragged_places(np.cumsum(size) - size, count)
        data = np.frombuffer(b"".join([*number, bytes(8)]), np.uint8)
        del number
        known = np.repeat(np.bincount(np.concatenate([np.array(c, np.int64) for c in code]), minlength=len(count)) > 1, count)
        again = recurring(data, at, length, known)
        body = [np.packbits(np.concatenate([again[upto[c] : upto[c + 1]] for c in some])).tobytes() for some in code]
        give_back()
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "body": pa.array(body, pa.binary())})

    lasting = third.where("asked IS NOT NULL").mapInArrow(frugal(stretch_parcels), _PARCEL_TYPE)
    bits_of = materialize(lasting.groupBy("bucket").applyInArrow(settled, _PARCEL_TYPE).groupBy("batch").agg(F.collect_list(F.struct("bucket", "body")).alias("settled")))
    fourth = third.join(bits_of, "batch", "left").select("batch", "rows", "places", "shared", "longest", "asked", "settled")
    fields = [f for f in source.fields if keep_text or f.name != text_col]
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    counts = [T.StructField(c, T.LongType()) for c in own[:3]]
    schema = T.StructType([*fields, *counts, T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, b, (shared, longest, asked, ended) in batches_of(batch):
                start = np.zeros(b.size, bool)
                if shared:
                    start, ordered, bounds, lo, code = stretches(number, b, shared, longest, asked)
                    count = np.array([len(t) - length + 1 for t in ordered], np.int64)
                    upto = np.concatenate([[0], np.cumsum(count)])
                    again = np.zeros(upto[-1], bool)
                    for m in ended or []:
                        x, y = upto[bounds[m["bucket"]]], upto[bounds[m["bucket"] + 1]]
                        again[x:y] = np.unpackbits(np.frombuffer(m["body"], np.uint8), count=y - x)
                    often = np.bincount(code, minlength=len(ordered)) > 1
                    size = count[code]
                    start[ragged_places(lo, size)] |= again[ragged_places(upto[code], size)] | np.repeat(often[code], size)
                yield put_out(b, start)

    def put_out(b: Batch, start: np.ndarray) -> pa.RecordBatch:
        upto = np.zeros(b.size + 1, np.int32)
        np.cumsum(start, out=upto[1:])
        gone = upto[1:] > 0  # a string begins here, or at one of the length - 1 bytes before
        gone[length:] = upto[1 + length :] > upto[1:-length]
        docs = len(b.off) - 1
        opens = np.zeros(b.size + 1, bool)
        opens[b.off[:-1]] = True  # a text's first byte opens a span of its own
        edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1]])[: b.size] | gone & opens[:-1])
        stop = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]])[: b.size] | opens[1:]))
        doc = np.searchsorted(b.off, edge, "right") - 1
        spans = np.bincount(doc, minlength=docs)
        np.cumsum(gone, out=upto[1:])
        removed = upto[b.off[1:]] - upto[b.off[:-1]]
        keep = b.data[: b.size][~gone].tobytes()
        cut = (b.off - upto[b.off]).tolist()
        kept = [keep[x:y] for x, y in zip(cut, cut[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32()), pa.StructArray.from_arrays([pa.array(edge - b.off[doc]), pa.array(stop - b.off[doc])], names=["first", "last"]))
        columns = [b.rows.column(b.rows.schema.get_field_index(f.name)) for f in fields]
        columns += [pa.array(np.diff(b.off)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), lists, pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return fourth.mapInArrow(frugal(finish), schema)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's bytes once repeated 200-byte strings are gone, as digests."""
    out = repeated_strings(load(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Strings as runs of bytes in hexadecimal, two digits a byte.
OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT k, h, unnest(range(length(h) // 2 - 199)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
e AS (SELECT k, i, coalesce(i > max(i) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200, true) AS fresh FROM r),
g AS (SELECT k, i, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) AS s FROM e),
p AS (SELECT k, s, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY ALL),
c AS (SELECT k, count(*) AS spans, sum(b - a) AS gone, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM p GROUP BY k)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN la IS NULL THEN h ELSE array_to_string(list_transform(range(len(la) + 1), lambda j: CASE WHEN j = 0 THEN substr(h, 1, 2 * la[1]) WHEN j = len(la) THEN substr(h, 2 * lb[j] + 1) ELSE substr(h, 2 * lb[j] + 1, 2 * (la[j + 1] - lb[j])) END), '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (k)
"""
