"""Fill-in-the-middle: texts cut into prefix, middle and suffix at code points, and put back together.

One table-driven automaton over bytes knows at once where code points begin (continuation bytes of UTF-8), how
far a sentinel has been seen, and which sentinel has just ended. Its states are the prefixes of the sentinels
and the continuation bytes still owed; the table has a row for each state and a column for each byte.

The first scan runs it over the texts of a batch, joined by a byte that no text holds. The batch is laid out in
lanes that step together, a table look-up a step for all of them; as no state depends on more than the last few
bytes (three of a code point, all but one of a sentinel), a lane enters with the state that these bytes before it give.
Transitions that begin a code point are counted as they are made. The second pass finds each text's number of units
and its cuts in these counts. What comes out is scanned by the same automaton to find the sentinels it
was joined with, and so to rebuild the text.

Nulls count as empty; an empty text, and one that holds a sentinel, stays plain. A null id is drawn for as an empty
one. Bytes that are no UTF-8 are units by themselves. Texts of any length are cut whole; a batch holds about 4 MB of
text, or one text. Repeated rows fare alike. An empty table gives no rows. All input columns are kept; those named
like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, load, slices

#: Prefix, suffix and middle are announced by these.
SENTINELS = ("<P>", "<S>", "<M>")
#: Between texts: no byte of UTF-8.
_BETWEEN = b"\xff"
_STEPS = 1024


@lru_cache(8)
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Next state and whether a unit begins, by 256 * state + byte; the sentinel (from 1) that has ended, by state;
    and how many bytes a state can depend on."""
    words = [s.encode() for s in sentinels]
    if not all(words) or len(set(words)) < len(words) or any(max(w) > 127 for w in words):
        raise ValueError("sentinels must be distinct, not empty and ASCII")
    if any(a != b and a in b for a in words for b in words):
        raise ValueError("no sentinel may lie within another")
    seen = sorted({w[:i] for w in words for i in range(len(w) + 1)}, key=lambda p: (len(p), p))  # the empty one is state 0
    state = {p: i for i, p in enumerate(seen)}
    owed = [len(seen) + k for k in range(3)]  # one, two or three continuation bytes
    to, begins = np.zeros((len(seen) + 3, 256), np.uint8), np.ones((len(seen) + 3, 256), bool)
    for s in range(len(seen) + 3):
        here = seen[s] if s < len(seen) else b""
        for b in range(128):
            grown = here + bytes([b])
            to[s, b] = next(state[grown[i:]] for i in range(len(grown) + 1) if grown[i:] in state)
        to[s, 0xC2:0xE0], to[s, 0xE0:0xF0], to[s, 0xF0:0xF5] = owed
    for k, s in enumerate(owed):
        to[s, 0x80:0xC0] = owed[k - 1] if k else 0
        begins[s, 0x80:0xC0] = False
    begins[:, _BETWEEN[0]] = False
    ended = np.zeros(len(seen) + 3, np.uint8)
    for i, w in enumerate(words):
        ended[state[w]] = i + 1
    return to.ravel(), begins.ravel(), ended, max(3, max(map(len, words)) - 1)


def scan(joined: bytes, sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units begun up to and with each byte; where sentinels end (the byte behind) and which these are (from 0)."""
    to, begins, ended, reach = automaton(sentinels)
    lanes = -(-len(joined) // _STEPS)
    data = np.full(reach + lanes * _STEPS, _BETWEEN[0], np.uint8)
    data[reach : reach + len(joined)] = np.frombuffer(joined, np.uint8)
    body = np.ascontiguousarray(data[reach:].reshape(lanes, _STEPS).T)
    state = np.zeros(lanes, np.int32)
    for j in range(reach):  # what precedes each lane
        state = to[(state << 8) | data[j : j + lanes * _STEPS : _STEPS]].astype(np.int32)
    unit, over = np.empty((_STEPS, lanes), bool), np.empty((_STEPS, lanes), np.uint8)
    for j in range(_STEPS):
        move = (state << 8) | body[j]
        unit[j] = begins[move]
        state = to[move].astype(np.int32)
        over[j] = ended[state]
    counted = np.cumsum(unit.T.ravel()[: len(joined)], dtype=np.int64)
    over = over.T.ravel()[: len(joined)]
    at = np.flatnonzero(over)
    return counted, at + 1, over[at].astype(np.int64) - 1


def cuts(texts: list[bytes], draws: np.ndarray, sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: units, those of the prefix and of prefix and middle together, the bytes of both, and whether it
    holds a sentinel. draws: two whole numbers a text, whose remainders by units + 1 are the cuts."""
    counted, over, _ = scan(_BETWEEN.join(texts), sentinels)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + 1) - size - 1
    upto = np.concatenate([[0], counted])
    base = upto[start]
    n = upto[start + size] - base
    units = np.sort(draws % (n + 1)[:, None], axis=1)
    place = np.searchsorted(counted, base[:, None] + units + 1) - start[:, None]
    place = np.where(units == n[:, None], size[:, None], place)
    holds = np.zeros(len(texts), bool)
    holds[np.searchsorted(start, over - 1, "right") - 1] = True
    return n, units, place, holds


def joined(text: bytes, a: int, b: int, form: str, sentinels: tuple[str, ...] = SENTINELS) -> bytes:
    """The parts of a text, cut at bytes a and b, in the order of the form."""
    if form == "plain":
        return text
    p, s, m = (x.encode() for x in sentinels)
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


def rebuilt(outputs: list[bytes], forms: list[str], sentinels: tuple[str, ...] = SENTINELS) -> list[bytes]:
    """The texts that outputs of the given forms were made of; an output without its three sentinels in order is an error."""
    _, over, which = scan(_BETWEEN.join(outputs), sentinels)
    ends = np.cumsum([len(o) + 1 for o in outputs])
    first, last = np.searchsorted(over, np.concatenate([[0], ends[:-1]]), "right"), np.searchsorted(over, ends, "right")
    out = []
    for i, (o, form) in enumerate(zip(outputs, forms)):
        if form == "plain":
            out.append(o)
            continue
        at, kind = over[first[i] : last[i]] - (ends[i] - len(o) - 1), which[first[i] : last[i]]
        if kind.tolist() != ([0, 1, 2] if form == "psm" else [1, 0, 2]):
            raise ValueError(f"an output of form {form} lacks its sentinels")
        x, y, z = at.tolist()
        width = [len(sentinels[k]) for k in kind]
        one, two, middle = o[x : y - width[1]], o[y : z - width[2]], o[z:]
        out.append(one + middle + two if form == "psm" else two + middle + one)
    return out


def _draw(hashed: Column, k: int) -> Column:
    return F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")


_RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")


def fill_in_middle(df: DataFrame, seed: int = 1, plain: int = 10, suffix_first: int = 20, sentinels: tuple[str, ...] = SENTINELS, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``df`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    plain: of a hundred documents so many stay plain; suffix_first: of a hundred others so many take the form spm. All draws
    come from the SHA-256 of seed and id. digests: in place of text and output their SHA-256, of the output and of the
    text rebuilt from it.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drop = [c for c in _RESULTS if c in df.columns and c not in (id_col, text_col)]
    kept = [f for f in df.drop(*drop).schema.fields if f.name not in _RESULTS and not (digests and f.name == text_col)]
    names = [f.name for f in kept]
    rows = df.drop(*drop).withColumn("_h", hashed).withColumns({f"_h{k}": _draw(F.col("_h"), k) for k in range(4)}).drop("_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                if part.num_rows:
                    yield cut(part)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda c: part.column(part.schema.get_field_index(c))
        texts = [t or b"" for t in column(text_col).cast(pa.large_binary()).to_pylist()]
        h = np.stack([column(f"_h{k}").to_numpy() for k in range(4)], axis=1)
        n, units, place, holds = cuts(texts, h[:, :2], sentinels)
        same = (n == 0) | holds | (h[:, 2] % 100 >= 100 - plain)
        forms = np.where(same, "plain", np.where(h[:, 3] % 100 < suffix_first, "spm", "psm")).tolist()
        outputs = [joined(t, a, b, form, sentinels) for t, (a, b), form in zip(texts, place.tolist(), forms)]
        count = lambda x: pa.array(x, pa.int64(), mask=same)
        out = [*(column(c) for c in names), pa.array(n), pa.array(forms), count(units[:, 0]), count(units[:, 1] - units[:, 0])]
        if digests:
            sha = lambda some: pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string())
            out += [sha(outputs), sha(rebuilt(outputs, forms, sentinels))]
        else:
            out.append(pa.array(outputs, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    made = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    made += [("output_sha256", T.StringType()), ("restored_sha256", T.StringType())] if digests else [("output", T.StringType())]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in made)])
    return rows.mapInArrow(frugal(run), schema)


def restored(df: DataFrame, sentinels: tuple[str, ...] = SENTINELS, output_col: str = "output", form_col: str = "form", name: str = "text") -> DataFrame:
    """``df`` with the text that each output was made of; a null output gives a null."""
    if name in (output_col, form_col):
        raise ValueError("the text needs a column of its own")
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output_col):
                if not part.num_rows:
                    continue
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                raw = column(output_col).cast(pa.large_binary()).to_pylist()
                texts = rebuilt([o or b"" for o in raw], ["plain" if o is None else f for o, f in zip(raw, column(form_col).to_pylist())], sentinels)
                text = pa.array([None if o is None else t for o, t in zip(raw, texts)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(column(f.name) for f in schema.fields[:-1]), text], names=[f.name for f in schema.fields])

    return df.mapInArrow(frugal(run), schema)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts and form, and the digests of its output and of the text rebuilt from it."""
    return fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
