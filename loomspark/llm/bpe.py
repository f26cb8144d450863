"""Byte-level BPE encoding and decoding, vectorised over Arrow batches.

Pre-tokenisation needs no regex. Code points map to classes (letter, number, other, the places of a
white-space run, apostrophes that open a contraction), each class is a transition function on eight
states, and an associative scan composes these functions: within blocks for all start states at
once, then over the blocks' functions, then back into the blocks. A token starts where state and
class say so. The slices between starts feed a cached pair merging, vectorised over new slices; lengths of the ids' bytes give the
offsets that decoding keeps.

Nulls and empty texts have no ids and decode to no bytes. Texts of any length are encoded whole;
those of a batch are taken in pieces of documents of about ``slices``' bound, a longer text alone.
Repeated rows are encoded alike. Empty tables give no rows. All input columns are kept; those named like a
result column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import frugal, load, ragged, slices, utf8_buffer

L, N, O, A2, A3, W, P, X = range(8)
_BEGIN, _LETTERS, _NUMBERS, _OTHERS, _SPACE, _WHITE, _ONE_MORE, _TWO_MORE = range(8)
#: White space as Unicode's White_Space property has it (fixed values).
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: L, N, W (any white space) or O."""
    table = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = L
        elif kind == "N":
            table[c] = N
    table[_WHITE_SPACE] = W
    return table


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by 16 symbols (8 more: first of a text) and state."""
    to, starts = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for symbol in range(8):
        for state in range(8):
            if state == _TWO_MORE:
                go, new = _ONE_MORE, False
            elif state == _ONE_MORE:
                go, new = _BEGIN, False
            elif symbol in (L, N, O):
                go = (_LETTERS, _NUMBERS, _OTHERS)[symbol]
                new = state not in (go, _SPACE)
            elif symbol in (A2, A3):
                if state in (_OTHERS, _SPACE):
                    go, new = _OTHERS, False
                else:
                    go, new = (_ONE_MORE if symbol == A2 else _TWO_MORE), True
            elif symbol == W:
                go, new = _WHITE, state != _WHITE
            else:
                go, new = (_SPACE if symbol == P else _BEGIN), True
            to[symbol, state], starts[symbol, state] = go, new
        to[symbol + 8], starts[symbol + 8] = to[symbol, _BEGIN], True
    return to, starts


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the automaton: classes, with what the next characters decide."""
    n = len(points)
    kind = _classes()[points]
    last = np.ones(n, bool)  # of a text
    last[:-1] = first[1:]
    white = kind == W
    ends = white & ~last
    ends[:-1] &= ~white[1:]
    kind[ends] = np.where(points[ends] == 0x20, P, X)
    at = np.flatnonzero((points == 0x27) & ~last)
    if len(at):
        one = points[at + 1]
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        two[last[at + 1]] = 0
        kind[at[np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))]] = A2
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[at[pairs]] = A3
    return kind + 8 * first.astype(np.uint8)


def _scan(symbols: np.ndarray, block: int = 128) -> np.ndarray:
    """Where tokens start: a blocked associative scan over the symbols' transition functions."""
    to, starts = _automaton()
    n = len(symbols)
    rows = -(-n // block)
    grid = np.full(rows * block, W + 8, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat = to.ravel()
    # The function of each block: where each of the eight start states leads. Most become
    # constant within a few symbols; from then on one state stands for all eight.
    function = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    wide, narrow, state = np.arange(rows), np.zeros(0, np.intp), np.zeros(rows, np.uint8)
    for k, column in enumerate(grid):
        if len(narrow):
            state[narrow] = flat[column[narrow].astype(np.intp) * 8 + state[narrow]]
        if len(wide):
            part = flat[(column[wide].astype(np.intp) * 8)[:, None] + function[wide]]
            function[wide] = part
            if k & 3 == 3:
                same = (part == part[:, :1]).all(1)
                state[wide[same]] = part[same, 0]
                narrow = np.sort(np.concatenate([narrow, wide[same]]))
                wide = wide[~same]
    if len(narrow):
        function[narrow] = state[narrow][:, None]
    # Prefixes of the blocks' functions, by doubling.
    step, prefix = 1, function
    while step < rows:
        longer = prefix.copy()
        longer[step:] = np.take_along_axis(prefix[step:], prefix[:-step].astype(np.intp), 1)
        prefix, step = longer, step * 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = _BEGIN, prefix[:-1, _BEGIN]
    out = np.empty((block, rows), bool)
    marks = starts.ravel()
    for k, column in enumerate(grid):
        index = column.astype(np.intp) * 8 + state
        out[k], state = marks[index], flat[index]
    return out.T.ravel()[:n]


def token_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens of the texts (bytes, n+1 offsets) start."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    return leads[_scan(_symbols(points, first[leads]))]


class PairMerger:
    """Ids of many pre-tokens at once: again and again the leftmost pair of least rank becomes one.

    Short pre-tokens of like length are rows of matrices (ids, next parts, ranks of pairs); a round
    merges one pair in every row. Longer ones go through a heap.
    """

    LONG, NONE = 32, np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        known = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    known[a << 32 | b] = rank
        self.keys = np.array(sorted(known), np.int64)
        self.pair_ranks = np.array([known[k] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([ranks[bytes([k])] for k in range(256)], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.pair_ranks[at], self.NONE)

    def _rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of 1 to ``width`` bytes."""
        m = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(m, width)
        ids = self.bytes[raw]
        alive = np.arange(width) < size[:, None]
        after = np.broadcast_to(np.arange(1, width + 1), (m, width)).copy()  # the next part's place
        before = np.broadcast_to(np.arange(-1, width - 1), (m, width)).copy()
        rank = np.full((m, width), self.NONE, np.int32)
        rank[:, :-1][alive[:, 1:]] = self._rank(ids[:, :-1][alive[:, 1:]], ids[:, 1:][alive[:, 1:]])
        rows = np.arange(m)
        while len(rows):
            part = rank[rows]
            i = part.argmin(1)
            least = part[np.arange(len(rows)), i]
            more = least != self.NONE
            rows, i, least = rows[more], i[more], least[more]
            j = after[rows, i]
            ids[rows, i] = least
            alive[rows, j] = False
            rank[rows, j] = self.NONE
            k = after[rows, j]
            after[rows, i] = k
            inside = k < size[rows]
            r, a, b = rows[inside], i[inside], k[inside]
            before[r, b] = a
            rank[rows, i] = self.NONE
            rank[r, a] = self._rank(ids[r, a], ids[r, b])
            h = before[rows, i]
            inside = h >= 0
            r, a, b = rows[inside], h[inside], i[inside]
            rank[r, a] = self._rank(ids[r, a], ids[r, b])
        flat, upto = ids[alive].tobytes(), (np.cumsum(alive.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *upto], upto)]

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed int32 ids by piece."""
        out, by_width = {}, {8: [], 16: [], 32: []}
        for x in pieces:
            whole = self.ranks.get(x)
            if whole is not None:
                out[x] = np.int32(whole).tobytes()
            elif len(x) > self.LONG:
                out[x] = np.array(_merge_long(x, self.ranks), np.int32).tobytes()
            else:
                by_width[8 if len(x) <= 8 else 16 if len(x) <= 16 else 32].append(x)
        for width, some in by_width.items():
            if some:
                out.update(zip(some, self._rows(some, width)))
        return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap and a linked list, for pre-tokens of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged into another
    before = list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) for x in items], out=off[1:])
    return np.frombuffer(b"".join(items), np.uint8), off


class Codec:
    """Encoder and decoder of one rank file (lines of base64 bytes and rank)."""

    def __init__(self, rank_file: bytes, cache: int = 300_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.merger, self.cache, self.most = PairMerger(self.ranks), {}, cache
        items = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            items[rank] = token
        self.tokens = _packed(items)
        self.digits = _packed([b"%d " % k for k in range(len(items))])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n+1 offsets of the texts in them."""
        starts = token_starts(data, off)
        cuts = np.append(starts, len(data))
        raw = data.tobytes()
        bounds = cuts.tolist()
        cache = self.cache
        pieces = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        new = set(pieces).difference(cache)
        if len(cache) + len(new) > self.most:  # so that memory stays bounded
            cache.clear()
            new = set(pieces)
        cache.update(self.merger.merge(list(new)))
        pieces = [cache[x] for x in pieces]
        ids = np.frombuffer(b"".join(pieces), np.int32)
        upto = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2, out=upto[1:])
        return ids, upto[np.searchsorted(starts, off)]

    @staticmethod
    def _take(data: np.ndarray, off: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged(data, off[:-1][items], np.diff(off)[items])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids and the n+1 byte offsets of the ids."""
        return self._take(*self.tokens, ids)

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal digits, each with a space behind it, and their n+1 offsets."""
        return self._take(*self.digits, ids)


@lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of a rank file, one in each worker process."""
    with open(path, "rb") as f:
        return Codec(f.read())


def _default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(df: DataFrame, ranks_path: str | None = None, text_col: str = "text", with_offsets: bool = True, keep_text: bool = True, round_trip: bool = False) -> DataFrame:
    """``df`` with ids array<int>, n_tokens and, if asked for, offsets array<bigint> (each id's first byte in the text).

    ranks_path: a file that every worker can open (an installed package's, or one shipped along).
    round_trip: add a column of this name, whether the ids decode to the text's bytes.
    """
    from pyspark.sql import types as T

    path = ranks_path or _default_ranks()
    df = df.drop(*[c for c in ("ids", "offsets", "n_tokens", *["round_trip"] * round_trip) if c != text_col])
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    offsets = [T.StructField("offsets", T.ArrayType(T.LongType()))] * with_offsets
    checked = [T.StructField("round_trip", T.BooleanType())] * round_trip
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), *offsets, T.StructField("n_tokens", T.LongType()), *checked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in slices(batch, text_col, 2_000_000):
                data, off = utf8_buffer(part.column(part.schema.get_field_index(text_col)))
                ids, upto = coder.encode(data, off)
                lists = pa.array(upto, pa.int32())
                columns = [*(part.column(part.schema.get_field_index(f.name)) for f in kept), pa.ListArray.from_arrays(lists, pa.array(ids))]
                if with_offsets:
                    places = coder.decode(ids)[1][:-1] - np.repeat(off[:-1], np.diff(upto))
                    columns.append(pa.ListArray.from_arrays(lists, pa.array(places)))
                columns.append(pa.array(np.diff(upto)))
                if round_trip:
                    raw, at = coder.decode(ids)
                    cut, own, back = at[upto].tolist(), data.tobytes(), raw.tobytes()
                    ends = off.tolist()
                    columns.append(pa.array([back[a:b] == own[c:d] for a, b, c, d in zip(cut, cut[1:], ends, ends[1:])]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(frugal(run), schema)


def decoded(df: DataFrame, ranks_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids (binary; null ids give none)."""
    from pyspark.sql import types as T

    path = ranks_path or _default_ranks()
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "decoded"], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, upto = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            out = []
            for i in range(0, len(size), 64):  # some texts at once, so that their bytes stay few
                j = min(i + 64, len(size))
                raw, at = coder.decode(flat[upto[i] : upto[j]].astype(np.int64))
                cut = at[upto[i : j + 1] - upto[i]].tolist()
                raw = raw.tobytes()
                out += [raw[a:b] for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return df.drop("decoded").mapInArrow(frugal(run), schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests."""
    path = _default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = utf8_buffer(part.column(1))
                ids, upto = coder.encode(data, off)
                sums = []
                for flat, at in (coder.decimals(ids), coder.decode(ids)):
                    raw, cut = memoryview(flat.tobytes()), at[upto].tolist()
                    sums.append([hashlib.sha256(raw[a : max(a, b - (not sums))]).hexdigest() for a, b in zip(cut, cut[1:])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(upto)), *map(pa.array, sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
