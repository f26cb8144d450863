"""Substring dedup by recompression.

Every text is a sequence of words. Rounds name runs of equal symbols and pairs of unlike symbols (a
pair forms where a symbol of the left class meets one of the right class; class and name are functions
of the symbol alone), so equal substrings get equal interior symbols in all documents, wherever they
run. Each symbol knows the words that decide it, its context; a symbol whose context lies in a window
occurs in every copy of that window. The least name of these anchors, taken with its context's words,
represents the window.

A global dictionary of names, which rounds over all data would fill, is not needed for that: a name is a
hash of what it stands for, so all batches give one thing one name without an exchange. What unlike
things share by accident is a candidate too many, as the last step compares the words themselves.

1. Each batch of documents names its windows' anchors; names are dealt to key ranges, where those of
   two documents or more are found: the shared symbols. One bit per name returns to the batch.
2. Only windows with a shared anchor (or with none) go on, as words: each batch tells its own apart by
   their bytes and deals each distinct one, with its least document, by its anchor. There the bytes are
   compared among all batches, and one bit per window returns: whether a lesser document has it.
3. Each batch marks the words of such windows and puts out what is left.

Batches are kept as compressed Arrow streams in the shared folder; what travels is about 8 bytes for
each anchor, and the words of the candidate windows (once for all windows of a range that overlap), both
deduplicated within the batch, so a passage in very many documents weighs no
more than once per batch. Key ranges grow in number with the input and hold a bounded share each; keys
are mixed anew after minima are taken, so that they fill the ranges evenly.

Nulls: a null text has no words; a null id counts as larger than all others, and nulls don't repeat each
other. Texts shorter than a window lose nothing. Texts of any length are processed whole. Rows of one
id never repeat each other. An empty table gives no rows. All input columns are kept; those named like a
result column are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, from_ipc, give_back, gram_hashes, load, materialize, mix, pack_sorted, ragged, slices, to_ipc, unpack_sorted, utf8_buffer, word_hashes, word_spans

_U = np.uint64
_BASE = 0xBF58476D1CE4E5B9
_FAR = 1 << 62  # beyond any word: what a text's edge needs to know


def recompress(words: np.ndarray, doc_of_word: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``rounds`` rounds: names, first word, end, and the words [low, high) that decide each.

    Symbols don't cross documents. At a text's edge, what a neighbour would decide stays open, so
    low or high lies beyond all words and the symbol is no anchor.
    """
    n = len(words)
    name, start = words.copy(), np.arange(n)
    end, low, high, doc = start + 1, start.copy(), start + 1, doc_of_word

    def near(values: np.ndarray, step: int, edge: int) -> np.ndarray:
        """The neighbour's value, or ``edge`` at a text's end."""
        out = np.full(len(values), edge, np.int64)
        if step < 0:
            out[1:] = np.where(doc[1:] == doc[:-1], values[:-1], edge)
        else:
            out[:-1] = np.where(doc[1:] == doc[:-1], values[1:], edge)
        return out

    for r in range(rounds):
        if len(name) < 2:
            break
        # Runs: to know where a run ends, both neighbours must be known.
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        size = np.diff(at, append=len(name))
        last = at + size - 1
        low, high = near(low, -1, -_FAR)[at], near(high, 1, _FAR)[last]
        start, end, doc = start[at], end[last], doc[at]
        name = np.where(size > 1, mix(name[at] * _U(0x9FB21C651E98DF25) + size.astype(_U) + _U(r)), name[at])
        # Pairs: a left symbol and the right symbol behind it.
        left = (mix(name ^ _U(0x5851F42D4C957F2D * (r + 1) & (1 << 64) - 1)) & _U(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # A left symbol's fate hangs on what follows, a right symbol's on what precedes.
        before, after = near(low, -1, -_FAR), near(high, 1, _FAR)
        low = np.where(left, low, np.minimum(low, before))
        high = np.where(left, np.maximum(high, after), high)
        keep = np.flatnonzero(~second)
        joined = pair[keep]
        partner = np.minimum(keep + 1, len(name) - 1)
        merged = mix(name[keep] * _U(0xD6E8FEB86659FD93) + name[partner] + _U(r + 77))
        name, end = np.where(joined, merged, name[keep]), np.where(joined, end[partner], end[keep])
        start, low, high, doc = start[keep], low[keep], high[keep], doc[keep]
    return name, start, end, low, high


def _prefix_hash(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [low, high), from prefix sums."""
    n = len(words)
    up = np.full(n + 1, _U(_BASE))
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n + 1, _U(pow(_BASE, -1, 1 << 64)))
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[high] - sums[low]) * down[low] + (high - low).astype(_U))


class Batch:
    """One batch's words, windows and the windows' anchors."""

    def __init__(self, rows: pa.RecordBatch, id_col: str, text_col: str, window: int):
        self.rows, self.window = rows, window
        ids = rows.column(rows.schema.get_field_index(id_col)).cast(pa.int64())
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.data, off = utf8_buffer(rows.column(rows.schema.get_field_index(text_col)))
        self.start, self.end = word_spans(self.data, off)
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(self.ids))
        self.upto = np.concatenate([[0], np.cumsum(self.n_words)])
        self.words = word_hashes(self.data, self.start, self.end)
        n = len(self.words) - window + 1
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``at``: whether it has an anchor, and the least anchor's name, mixed anew."""
        name, _, _, low, high = recompress(self.words, self.doc)
        use = (low >= 0) & (high <= len(self.words)) & (high - low <= self.window)
        name, low, high = name[use], low[use], high[use]
        key = mix(name ^ _prefix_hash(self.words, low, high)) if len(name) else name
        # Contexts lie in order, so a window's anchors are neighbours.
        first, last = np.searchsorted(low, self.at), np.searchsorted(high, self.at + self.window, "right")
        best = np.full(len(self.at), np.iinfo(np.uint64).max, _U)
        width = last - first
        for j in range(int(width.max(initial=0))):
            some = np.flatnonzero(width > j)
            best[some] = np.minimum(best[some], key[first[some] + j])
        return width > 0, mix(best)

    def joined(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some words, each with a space behind it, and where each begins."""
        size = self.end[word] - self.start[word] + 1
        off = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(off[-1], np.uint8)
        padded = np.append(self.data, np.uint8(32))
        for i in range(0, len(word), 1 << 15):  # in pieces, as places take eight bytes for each byte
            some = slice(i, i + (1 << 15))
            out[off[i] : off[min(len(word), i + (1 << 15))]] = ragged(padded, self.start[word[some]], size[some])[0]
        out[off[1:] - 1] = 32
        return out, off

    def least(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the least id and the largest id that has each."""
        order = np.argsort(keys, kind="stable")
        k, d = keys[order], self.ids[self.doc[at[order]]]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        if not len(head):
            return k, d, d
        return k[head], np.minimum.reduceat(d, head), np.maximum.reduceat(d, head)


def _numbered(values: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal values only."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def exact_names(words: np.ndarray, off: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """For the windows of ``window`` words that begin at the given words, numbers that are equal for equal words only.

    words: bytes, off: where each word begins. Words are numbered by their bytes. Hashes of pairs, of pairs of
    pairs and so on bring windows together; each is then compared word by word with the first of its hash. If
    any differs, all are numbered without hashes.
    """
    code = _numbered(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(words)]))
    if not len(at):
        return np.zeros(0, np.int64)
    h, span = mix(code.astype(_U)), 1
    while span < window:
        step = min(span, window - span)
        h = mix(h[:-step] * _U(0x9FB21C651E98DF25) + h[step:])
        span += step
    name = _numbered(pa.array(h[at]))
    first = np.empty(int(name.max()) + 1, np.int64)
    first[name[::-1]] = at[::-1]
    like = first[name]
    for j in range(window):
        if not np.array_equal(code[at + j], code[like + j]):
            return _numbered_in_rounds(code, window)[at]
    return name


def _numbered_in_rounds(code: np.ndarray, window: int) -> np.ndarray:
    """Numbers of all windows from numbers of words: after k rounds a number stands for 2**k words, two that overlap
    make the window."""
    name, span = code, 1
    while span < window:
        step = min(span, window - span)
        name = _numbered(pa.array(name[:-step] * (int(name.max()) + 1) + name[step:]))
        span += step
    return name


class Windows:
    """The distinct ones of a batch's windows, told apart by their words, in the order of their key ranges."""

    def __init__(self, batch: Batch, at: np.ndarray, keys: np.ndarray, bits: int):
        self.window, self.bounds = batch.window, np.zeros((1 << bits) + 1, np.int64)
        self.code, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(at):
            return
        used = np.zeros(len(batch.words) + 1, np.int64)
        np.add.at(used, at, 1)
        np.add.at(used, at + self.window, -1)
        word = np.flatnonzero(np.cumsum(used)[:-1])
        where = np.zeros(len(batch.words), np.int64)
        where[word] = np.arange(len(word))
        self.bytes, self.off = batch.joined(word)
        start = where[at]
        _, first, code = np.unique(exact_names(self.bytes, self.off, self.window, start), return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, code, batch.ids[batch.doc[at]])
        bucket = keys[first] >> _U(64 - bits)
        order = np.lexsort((first, bucket))
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        self.start, self.least, self.code = start[first[order]], least[order], place[code]
        self.bounds = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=_U))

    def pack(self, a: int, b: int) -> bytes:
        """Windows a to b as one compressed block: words that several windows share stand there once."""
        import zstandard

        start = self.start[a:b]
        step = np.minimum(np.diff(start, prepend=start[:1]), self.window)
        head = np.flatnonzero(np.concatenate([[True], step[1:] == self.window]))  # windows that share no word with the one before
        low, high = start[head], start[np.append(head[1:], len(start)) - 1] + self.window
        sizes, _ = ragged(np.diff(self.off), low, high - low)
        body, _ = ragged(self.bytes, self.off[low], self.off[high] - self.off[low])
        parts = np.array([len(start), len(sizes)], np.int64), step.astype(np.uint32), sizes.astype(np.uint32), body
        return zstandard.compress(b"".join(x.tobytes() for x in parts), 1)


def unpack_windows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, their sizes, and the word at which each window begins."""
    import zstandard

    data = zstandard.decompress(raw)
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    step, sizes = np.frombuffer(data, np.uint32, n, 16), np.frombuffer(data, np.uint32, m, 16 + 4 * n)
    return np.frombuffer(data, np.uint8, offset=16 + 4 * (n + m)), sizes, np.cumsum(step, dtype=np.int64)


def _pack(df: DataFrame, text_col: str, batch_bytes: int) -> DataFrame:
    """Rows (batch, rows, n_bytes): documents as compressed Arrow streams of about ``batch_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            raw = to_ipc(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([raw], pa.binary()), pa.array([size])], names=["batch", "rows", "n_bytes"])

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

    return df.mapInArrow(run, "batch string, rows binary, n_bytes long")


def _dealt(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits key ranges in sorted keys."""
    edges = np.arange(1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(1, _U)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _flags(marks: list[tuple[int, bytes]] | None, bounds: np.ndarray) -> np.ndarray:
    """The returned bits of all key ranges, in the order of the batch's keys."""
    out = np.zeros(bounds[-1], bool)
    for bucket, raw in marks or []:
        a, b = bounds[bucket], bounds[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
    return out


def _marks(value) -> list[tuple[int, bytes]]:
    return [(x["bucket"], x["bits"]) for x in value.as_py() or []]


def repeated(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, batch_bytes: int = 4 << 20, range_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with n_words, n_removed, removed (spans [first, last] of words), kept_text.

    range_bytes: text per key range of names, of which one task holds about a quarter; ranges of windows
    are a quarter as wide, and a task holds a few times that, if all text repeats.
    """
    if window < 2:
        raise ValueError("window must be 2 words or more")
    own = ("n_words", "n_removed", "removed", "kept_text")
    df = df.drop(*[c for c in own if c not in (id_col, text_col)])
    source = df.schema
    packed = materialize(_pack(df, text_col, batch_bytes))
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(3, (max(1, total // range_bytes) - 1).bit_length())
    bits_of_windows = bits + 2

    def anchor_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Batch(from_ipc(batch.column(1)[i].as_py()), id_col, text_col, window)
                has, best = b.anchors()
                keys, least, most = b.least(best[has], b.at[has])
                bounds, several = _dealt(keys, bits), least != most
                rows = [(k, pack_sorted(keys[x:y]), np.packbits(several[x:y]).tobytes()) for k, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
                yield from parcels(batch.column(0)[i].as_py(), rows)

    def parcels(name: str, rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if rows:
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows)), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "keys", "about"])

    def returned(table: pa.Table, bits_of: list[np.ndarray]) -> pa.Table:
        out = [np.packbits(x).tobytes() for x in bits_of]
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "bits": pa.array(out, pa.binary())})

    def shared_names(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("about"), keys)]
        everything = np.sort(np.concatenate(keys))
        twice = np.unique(np.concatenate([everything[1:][everything[1:] == everything[:-1]], *[k[m] for k, m in zip(keys, many)]]))
        if not len(twice):
            return returned(table, [np.zeros(len(k), bool) for k in keys])
        at = [np.minimum(np.searchsorted(twice, k), len(twice) - 1) for k in keys]
        return returned(table, [twice[i] == k for i, k in zip(at, keys)])

    def lesser_ids(table: pa.Table) -> pa.Table:
        import zstandard

        parts = [unpack_windows(x.as_py()) for x in table.column("keys")]
        sizes = [len(start) for _, _, start in parts]
        first = np.cumsum([0] + [len(x) for _, x, _ in parts[:-1]])
        place = np.concatenate([start + k for k, (_, _, start) in zip(first, parts)])
        off = np.concatenate([[0], np.cumsum(np.concatenate([x for _, x, _ in parts]), dtype=np.int64)])
        words = np.concatenate([x for x, _, _ in parts])
        del parts
        code = exact_names(words, off, window, place)
        d = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in table.column("about")])
        least = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, code, d)
        return returned(table, np.split(least[code] < d, np.cumsum(sizes)[:-1]))

    returned_type = "bucket int, batch string, bits binary"
    parcel_type = "bucket int, batch string, keys binary, about binary"

    def by_batch(parcel: DataFrame, reduce) -> DataFrame:
        def call(table: pa.Table) -> pa.Table:
            out = reduce(table)
            give_back()
            return out

        found = parcel.groupBy("bucket").applyInArrow(call, returned_type)
        return materialize(found.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks")))

    shared = by_batch(packed.mapInArrow(frugal(anchor_names), parcel_type), shared_names)
    marked = packed.select("batch", "rows").join(shared.withColumnRenamed("marks", "shared"), "batch", "left")

    def candidates(b: Batch, marks: list[tuple[int, bytes]]) -> tuple[np.ndarray, Windows]:
        """Places of the windows whose anchor is shared, or that have none, and the distinct ones of these."""
        has, best = b.anchors()
        keys = np.unique(best[has])
        wanted = ~has
        wanted[has] = _flags(marks, _dealt(keys, bits))[np.searchsorted(keys, best[has])]
        at = b.at[wanted]
        key = best[wanted]
        alone = np.flatnonzero(~has[wanted])
        if len(alone):
            key[alone] = gram_hashes(b.words, window)[at[alone]]
        return at, Windows(b, at, key, bits_of_windows)

    def window_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for i in range(batch.num_rows):
                b = Batch(from_ipc(batch.column(1)[i].as_py()), id_col, text_col, window)
                _, w = candidates(b, _marks(batch.column(2)[i]))
                rows = [(k, w.pack(x, y), zstandard.compress(w.least[x:y].tobytes(), 1)) for k, (x, y) in enumerate(zip(w.bounds, w.bounds[1:])) if y > x]
                yield from parcels(batch.column(0)[i].as_py(), rows)

    lesser = by_batch(marked.select("batch", "rows", "shared").mapInArrow(frugal(window_texts), parcel_type), lesser_ids)
    final = marked.join(lesser.withColumnRenamed("marks", "lesser"), "batch", "left").select("rows", "shared", "lesser")
    kept_fields = [f for f in source.fields if keep_text or f.name != text_col]
    names_out = [f.name for f in kept_fields]
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = T.StructType([*kept_fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Batch(from_ipc(batch.column(0)[i].as_py()), id_col, text_col, window)
                at, w = candidates(b, _marks(batch.column(1)[i]))
                again = _flags(_marks(batch.column(2)[i]), w.bounds)[w.code] | (b.ids[b.doc[at]] > w.least[w.code]) if len(at) else np.zeros(0, bool)
                cover = np.zeros(len(b.words) + 1, np.int64)
                np.add.at(cover, at[again], 1)
                np.add.at(cover, at[again] + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                yield put_out(b, gone)

    def put_out(b: Batch, gone: np.ndarray) -> pa.RecordBatch:
        docs = len(b.ids)
        removed = np.bincount(b.doc[gone], minlength=docs)
        keep = np.flatnonzero(~gone)
        # Each kept word with a space behind it; a text ends before its last space.
        padded = np.append(b.data, np.uint8(32))
        size = b.end[keep] - b.start[keep]
        body, off = ragged(padded, b.start[keep], size + 1)
        body[off[1:] - 1] = 32
        cuts = np.concatenate([[0], np.cumsum(b.n_words - removed)])
        raw, cut = body.tobytes(), off[cuts]
        texts = [raw[x : max(x, y - 1)].decode("utf-8") for x, y in zip(cut.tolist(), cut[1:].tolist())]
        edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (b.doc[1:] != b.doc[:-1])])) if len(gone) else np.zeros(0, np.int64)
        stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | (b.doc[1:] != b.doc[:-1]), [True]])) if len(gone) else np.zeros(0, np.int64)
        base = b.upto[b.doc[edge]]
        spans = pa.StructArray.from_arrays([pa.array(edge - base), pa.array(stop - base)], names=["first", "last"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(b.doc[edge], minlength=docs))]), pa.int32()), spans)
        columns = [*(b.rows.column(b.rows.schema.get_field_index(n)) for n in names_out), pa.array(b.n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), lists, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names_out, "n_words", "n_removed", "removed", "kept_text"])

    return final.mapInArrow(frugal(finish), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated 13-word windows are gone, as digests."""
    out = repeated(load(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS i FROM r),
l AS (SELECT k, list(i) AS gone FROM c GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (k)
"""
