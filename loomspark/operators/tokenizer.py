"""Byte-level BPE: pre-token counts, training, encoding, decoding and tokenizer statistics."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pieces import few
from ..storage import Tables, materialize
from .merging import train_in_rounds

#: Splits text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: \s and classes as Unicode has them.
_JAVA = f"(?U)({PATTERN})"
#: Pre-tokens in each half of a vocabulary's cache.
CACHED = 100_000
SPECIALS = ("<|bos|>", "<|eos|>", "<|pad|>", "<|unk|>")
#: Bytes in the order of their ids: the printable ones of Latin-1 first (fixed values).
ALPHABET = (*range(33, 127), *range(161, 173), *range(174, 256), *range(0, 33), *range(127, 161), 173)


def pretokens(text: Column | str) -> Column:
    """Pre-tokens of a text, in the JVM."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(_JAVA), F.lit(1))


def pretoken_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(pretoken, n) over all texts."""
    return df.select(F.explode(pretokens(F.coalesce(text_col, F.lit("")))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


class _Pieces(dict):
    """Ids of pre-tokens as bytes of int32, made when they are asked for; as many are remembered as by ``Vocabulary.merge``."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.older = vocab, {}

    def __missing__(self, piece: str) -> bytes:
        known = self.older.get(piece)
        if known is None:
            known = np.array([self.vocab.ids[p] for p in self.vocab._parts(piece.encode())], np.int32).tobytes()
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[piece] = known
        return known


@dataclass
class Vocabulary:
    """Ids by token bytes (specials first) and merges in order."""

    ids: dict[bytes, int]
    merges: list[tuple[bytes, bytes]]
    specials: tuple[str, ...] = SPECIALS
    _cache: dict = field(default_factory=dict, repr=False, compare=False)
    _older: dict = field(default_factory=dict, repr=False, compare=False)
    _pieces: _Pieces | None = field(default=None, repr=False, compare=False)
    _pairs: tuple[np.ndarray, ...] | None = field(default=None, repr=False, compare=False)
    _table: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.rank = {pair: i for i, pair in enumerate(self.merges)}
        self.tokens = {i: b for b, i in self.ids.items()}

    @property
    def size(self) -> int:
        return len(self.specials) + len(self.ids)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_cache": {}, "_older": {}, "_pieces": None, "_pairs": None, "_table": None}

    def merge(self, piece: str) -> list[int]:
        """Ids of a pre-token. The last ``CACHED`` to twice as many are remembered: those of the older half that are met
        again move to the younger one, the rest go when that is full."""
        known = self._cache.get(piece)
        if known is None:
            known = self._older.get(piece)
            if known is None:
                known = [self.ids[p] for p in self._parts(piece.encode())]
            if len(self._cache) >= CACHED:
                self._older, self._cache = self._cache, {}
            self._cache[piece] = known
        return known

    def _parts(self, piece: bytes) -> list[bytes]:
        """The piece merged: the pair of least rank first, the leftmost of equals, by a heap over a linked list."""
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank = self.rank.get((part[i], part[after[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, part[i], part[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    def encode(self, text: str) -> list[int]:
        import regex

        out: list[int] = []
        known = self._cache.get
        for piece in regex.findall(PATTERN, text):
            ids = known(piece)
            if ids is None:
                ids = self.merge(piece)
                known = self._cache.get
            out += ids
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of many texts, as arrays; pre-tokens that are new are merged all at once."""
        import regex

        self._pieces = known = self._pieces if self._pieces is not None else _Pieces(self)
        pieces = list(map(regex.compile(PATTERN).findall, texts))
        new = [p for p in set().union(*pieces) if p not in known and p not in known.older]
        if len(known) + len(new) > CACHED:
            known.older = dict(known)
            known.clear()
        known.update(zip(new, self.merge_all([p.encode() for p in new])))
        return [np.frombuffer(b"".join(map(known.__getitem__, some)), np.int32) for some in pieces]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, as bytes of int32: in every step each piece merges its leftmost pair of least rank, as in
        ``_parts``, and pieces that have none are done."""
        if self._pairs is None:
            code = np.zeros(256, np.int64)
            code[list(ALPHABET)] = [self.ids[bytes([b])] for b in ALPHABET]
            pairs = sorted((self.ids[a] << 32 | self.ids[b], k, self.ids[a + b]) for (a, b), k in self.rank.items())
            self._pairs = code, *np.array(pairs or [(-1, 0, 0)], np.int64).T
        code, known, rank, makes = self._pairs
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym, word = code[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), size)
        done = []
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            hit = np.flatnonzero((known[at] == pair) & (word[:-1] == word[1:]))
            goes_on = np.zeros(len(pieces), bool)
            goes_on[word[hit]] = True
            goes_on, keep = goes_on[word], np.ones(len(sym), bool)
            done.append((sym[~goes_on], word[~goes_on]))
            if len(hit):
                w = word[hit]
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                least = np.minimum.reduceat(rank[at[hit]] << 32 | hit, first) & 0xFFFFFFFF
                sym[least], keep[least + 1] = makes[at[least]], False
            sym, word = sym[goes_on & keep], word[goes_on & keep]
        sym, word = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in zip(*done, (sym, word)))
        raw = sym[np.argsort(word, kind="stable")].astype(np.int32).tobytes()
        ends = (4 * np.cumsum([0, *np.bincount(word, minlength=len(pieces))])).tolist()
        return [raw[x:y] for x, y in zip(ends, ends[1:])]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of an array of ids, and where each id's bytes end."""
        if self._table is None:
            known = {**{i: s.encode() for i, s in enumerate(self.specials)}, **self.tokens}
            every = [known.get(i, b"") for i in range(max(known) + 1)]
            self._table = np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *map(len, every)])
        data, off = self._table
        size = off[ids + 1] - off[ids]
        ends = np.cumsum(size)
        return data[np.repeat(off[ids] - (ends - size), size) + np.arange(int(size.sum()))], ends

    def decode(self, ids) -> str:
        special = [s.encode() for s in self.specials]
        tokens = self.tokens
        return b"".join([tokens[i] if i in tokens else special[i] for i in ids]).decode("utf-8", "replace")


def train(counts: list[tuple[str, int]], vocab_size: int, min_frequency: int = 2, specials: tuple[str, ...] = SPECIALS) -> Vocabulary:
    """Merges from pre-token counts: the most frequent pair first, ties to the smaller pair of ids.

    All words lie in one array of symbols, linked to their neighbours; a pair's places are indexed when it
    arises and looked over once it is merged, so a merge touches those places only, all at once.
    """
    first = len(specials)
    tokens = [bytes([b]) for b in ALPHABET]
    ids = {t: first + k for k, t in enumerate(tokens)}
    raw = [w.encode() for w, _ in counts]
    code = np.empty(256, np.int64)
    code[list(ALPHABET)] = np.arange(256)
    sym = code[np.frombuffer(b"".join(raw), np.uint8)]
    size = np.array([len(w) for w in raw], np.int64)
    n = len(sym)
    weight = np.repeat(np.array([k for _, k in counts], np.int64), size)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(size)
    after[ends[size > 0] - 1], before[(ends - size)[size > 0]] = -1, -1
    count: dict[tuple[int, int], int] = {}
    places: dict[tuple[int, int], list[np.ndarray]] = {}

    def grouped(at: np.ndarray):
        """The pairs that begin at the places: (pair, places, summed weight)."""
        at = at[(at >= 0) & (after[at] >= 0)]
        a, b = sym[at], sym[after[at]]
        if len(tokens) < 1 << 16:  # narrow keys are sorted by their digits
            order = np.argsort(b.astype(np.uint16), kind="stable")
            order = order[np.argsort(a[order].astype(np.uint16), kind="stable")]
        else:
            order = np.argsort(a << 32 | b, kind="stable")
        at, pair = at[order], (a << 32 | b)[order]
        cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(at) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weight[at], cuts) if len(cuts) else cuts
        for lo, hi, k in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], sums.tolist()):
            yield (int(pair[lo] >> 32), int(pair[lo] & 0xFFFFFFFF)), at[lo:hi], k

    def distinct(*some: np.ndarray) -> np.ndarray:
        """The places of several arrays, each once, in order."""
        every = np.concatenate(some)
        if len(every) * 32 < n:
            return np.unique(every)
        seen = np.zeros(n + 1, bool)  # the last is for what lies before a word
        seen[every] = True
        return np.flatnonzero(seen[:-1])

    for p, at, k in grouped(np.arange(n)):
        count[p], places[p] = k, [at]
    heap = [(-k, *p) for p, k in count.items()]
    heapq.heapify(heap)
    merges: list[tuple[bytes, bytes]] = []
    while heap and first + len(ids) < vocab_size:
        k, a, b = heapq.heappop(heap)
        known = count.get((a, b), 0)
        if -k != known:
            if known > 0:
                heapq.heappush(heap, (-known, a, b))
            continue
        if known < max(1, min_frequency):
            break
        merged = tokens[a] + tokens[b]
        merges.append((tokens[a], tokens[b]))
        new = ids.setdefault(merged, first + len(ids)) - first
        if new == len(tokens):
            tokens.append(merged)
        at = distinct(*places.pop((a, b)))
        at = at[(sym[at] == a) & (after[at] >= 0)]
        at = at[sym[after[at]] == b]
        if a == b and len(at):  # of a run the first, third, ... place
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = after[at]
        changed = {}
        for p, _, k in grouped(distinct(before[at], at, gone)):
            changed[p] = -k
        follows = after[gone]
        sym[at], sym[gone] = new, -1
        after[at], after[gone] = follows, -1
        before[follows[follows >= 0]] = at[follows >= 0]
        for p, where, k in grouped(distinct(before[at], at)):
            changed[p] = changed.get(p, 0) + k
            if new in p:
                places.setdefault(p, []).append(where)
        for p, k in changed.items():
            count[p] = count.get(p, 0) + k
            if count[p] > 0 and k > 0:
                heapq.heappush(heap, (-count[p], *p))
            elif count[p] <= 0:
                count.pop(p), places.pop(p, None)
    return Vocabulary(ids, merges, specials)


def train_on(df: DataFrame, vocab_size: int, min_frequency: int = 2, text_col: str = "text", most_words: int = 500_000, min_count: int = 1) -> Vocabulary:
    """Training on a corpus of any size.

    Words are counted in Spark. Up to ``most_words`` distinct ones are merged in the driver's arrays; more stay in a table
    and are merged in rounds (``merging``), with the same result. min_count: words of fewer occurrences are left out.
    """
    with Tables(df.sparkSession):
        counts = materialize(pretoken_counts(df, text_col).where(F.col("n") >= min_count))
        if counts.count() > most_words:
            ids, merges = train_in_rounds(counts, ALPHABET, len(SPECIALS), vocab_size, min_frequency)
            return Vocabulary(ids, merges)
        rows = counts.toArrow()
    return train(list(zip(rows.column("pretoken").to_pylist(), rows.column("n").to_pylist())), vocab_size, min_frequency)


def check_specials(vocab: Vocabulary) -> None:
    """bos 0, eos 1, pad 2, unk 3."""
    if tuple(vocab.specials) != SPECIALS or min(vocab.ids.values()) != len(SPECIALS):
        raise ValueError("special tokens must have the ids 0 to 3")


def batch_counter(tokenizer):
    """A function of an array of texts to its tokens: every text is encoded by itself, without special tokens.

    tokenizer: anything with encode(text) -> ids, a ``Vocabulary`` too. Governing takes it as its counter.
    """
    shared = _broadcast(tokenizer)

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        t = shared.value
        return texts.map(lambda some: sum(len(t.encode(x)) for x in some) if some is not None else 0)

    return lambda texts: counted(texts)


def encoder(vocab: Vocabulary):
    """Pandas UDF: text to ids, no special tokens."""
    shared = _broadcast(vocab)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        v = shared.value
        return texts.map(lambda t: v.encode(t or ""))

    return encode


def decoder(vocab: Vocabulary):
    """Pandas UDF: ids to text."""
    shared = _broadcast(vocab)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        v = shared.value
        return ids.map(lambda x: v.decode(list(x) if x is not None else []))

    return decode


def _broadcast(vocab: Vocabulary):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(vocab)


def round_trip(df: DataFrame, vocab: Vocabulary, text_col: str = "text", shown: int = 20) -> DataFrame:
    """One row: checked, ok, failures (the first 80 characters of up to ``shown`` texts and decodings), failed (their number)."""
    shared = _broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in few(batches, 0):
            texts = batch.column(0).to_pylist()
            if type(v).encode is Vocabulary.encode and type(v).decode is Vocabulary.decode:
                ids = v.encode_all(texts)
                data, ends = v.spelled(np.concatenate(ids))
                raw, ends = data.tobytes(), np.append(0, ends)[np.cumsum([0, *map(len, ids)])].tolist()
                decoded = [raw[x:y].decode("utf-8", "replace") for x, y in zip(ends, ends[1:])]
            else:  # anything that encodes and decodes
                decoded = [v.decode(v.encode(t)) for t in texts]
            pairs = [None if t == d else [t[:80], d[:80]] for t, d in zip(texts, decoded)]
            yield pa.RecordBatch.from_arrays([pa.array([p is not None for p in pairs]), pa.array(pairs, pa.list_(pa.string()))], names=["bad", "pair"])

    # Coded once: a flag for each text, and what failed, of which no task gathers more than is shown.
    seen = materialize(df.select(F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(run, "bad boolean, pair array<string>"))
    counted = seen.agg(F.count("*").alias("checked"), F.coalesce(F.bool_and(~F.col("bad")), F.lit(True)).alias("ok"), F.count(F.when(F.col("bad"), True)).alias("failed"))
    listed = seen.where("bad").select("pair").distinct().orderBy("pair").limit(shown).agg(F.sort_array(F.collect_list("pair")).alias("failures"))
    return counted.join(F.broadcast(listed)).select("checked", "ok", "failures", "failed")  # one row each


def tokens_per_char(df: DataFrame, tokens: Column, text_col: str, category: str) -> DataFrame:
    """(category, n_tokens, n_chars, tokens_per_char) for each category and for all as ``overall``."""
    rows = df.select(F.col(category).alias("category"), tokens.cast("long").alias("t"), F.length(text_col).cast("long").alias("c"))
    out = rows.rollup("category").agg(F.sum("t").alias("n_tokens"), F.sum("c").alias("n_chars"), F.grouping("category").alias("_g"))
    ratio = F.when(F.col("n_chars") > 0, F.col("n_tokens") / F.col("n_chars")).otherwise(0.0)
    return out.select(F.when(F.col("_g") == 1, "overall").otherwise(F.col("category")).alias("category"), "n_tokens", "n_chars", ratio.alias("tokens_per_char"))


def compare_tokens_per_char(own: DataFrame, other: DataFrame) -> DataFrame:
    """Own over other's tokens per character by category; 0 where the other has none."""
    b = other.select("category", F.col("tokens_per_char").alias("reference_tokens_per_char"))
    a = own.select("category", F.col("tokens_per_char").alias("custom_tokens_per_char"))
    ratio = F.when(F.col("reference_tokens_per_char") != 0, F.col("custom_tokens_per_char") / F.col("reference_tokens_per_char")).otherwise(0.0)
    return a.join(b, "category").withColumn("ratio_custom_over_reference", ratio)


def corpus_stats(df: DataFrame, tokens: Column) -> DataFrame:
    """One row: docs, tokens, mean_tokens (0 without documents)."""
    return df.agg(F.count("*").alias("docs"), F.coalesce(F.sum(tokens.cast("long")), F.lit(0)).alias("tokens"), F.coalesce(F.avg(tokens), F.lit(0.0)).alias("mean_tokens"))
