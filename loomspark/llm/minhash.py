"""MinHash near-duplicates by min-max hashing.

Each permutation of the shingles leaves both its minimum and its maximum, so that K hash evaluations
give 2K values; bands of these values are buckets. Documents of the same words in the same order (a
128-bit BLAKE2 digest of them) are one class from the start, represented by their least id. Within a
bucket no pair list is made:

1. The least member of each bucket meets all others; candidate pairs are confirmed on both full sets of
   shingles, as words, not as hashes; confirmed links make components. So copies collapse in one round,
   however many there are.
2. Documents of buckets that still hold several components may be merely similar in great number.
   They meet again under the rare shingles of their sets: two sets of the wanted similarity share one
   among the rarest few of each, early enough in both (prefix and place bounds, which lose nothing).
   Rounds of pivots, small sets first, meet the members of other components, until each of these
   buckets is one component, or nobody is left whose bounds allow a partner. Each round has four times
   the pivots of the one before, 64 of a bucket to a row, so a bucket of N unlike documents takes about
   log4(N) rounds and no row grows with it.

Before a pair is made, sizes, places and sketches (4 bits of each value) leave out what can't be similar
enough. A link is lost only if the pair shares no band or its sketches mislead: less than two in a
million at a similarity of 0.85 with 40 permutations in 20 bands of 4 values; 3 in a million at 0.8
with 48 in 24.

Shingle counts are those of distinct hashes of 64 bits; a hash that two shingles shared would lower a count
by one and could not make a link. Components grow by alternating large-star and small-star steps on written tables.

Nulls and texts without words have no shingles and link with nothing. A row without an id links with
nothing and keeps a null component. Rows of one id are one document: their texts' links add up. Texts of
any length count whole. An empty table gives no rows. All input columns are kept; those named like a
result column are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, frugal, gram_hashes, join_small, load, materialize, mix, slices, utf8_buffer, word_hashes, word_spans

_U = np.uint64
#: A-Z to a-z, other bytes as they are.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted; a text of fewer words is one shingle."""
    data = _LOWER[data]
    start, end = word_spans(data, off)
    words = word_hashes(data, start, end)
    grams = gram_hashes(words, size)
    bounds = np.searchsorted(start, off).tolist()
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], _U)
            for k in range(a, b):
                h = mix(words[k : k + 1] ^ (h * _U(0x9E3779B97F4A7C15)))
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


def exact_shingles(raw: bytes, size: int) -> frozenset[tuple[bytes, ...]]:
    """A text's shingles as tuples of its lower-cased words."""
    words = raw.lower().split()
    return frozenset(zip(*(words[k:] for k in range(size)))) if len(words) >= size else frozenset([tuple(words)] if words else [])


def min_max(sets: list[np.ndarray], permutations: int, seed: int = 5) -> np.ndarray:
    """Minimum and maximum of each permutation for each (not empty) set: sets x 2K values."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, permutations, dtype=_U) * _U(2) + _U(1)
    b = rng.integers(0, 1 << 64, permutations, dtype=_U)
    out = np.empty((len(sets), 2 * permutations), _U)
    i = 0
    while i < len(sets):  # some ten thousand shingles at once stay in the processor's cache
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 50_000):
            total += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        heads = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        for k in range(permutations):
            x = flat * a[k] + b[k]
            out[i:j, 2 * k] = np.minimum.reduceat(x, heads)
            out[i:j, 2 * k + 1] = np.maximum.reduceat(x, heads)
        i = j
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values, different from band to band."""
    bands = values.shape[1] // rows
    out = np.empty((len(values), bands), _U)
    for j in range(bands):
        h = np.full(len(values), _U(j + 1))
        for k in range(rows):
            h = mix(h * _U(0x9E3779B97F4A7C15) + values[:, j * rows + k])
        out[:, j] = h
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """Four bits of each value, sixteen to a 64-bit word."""
    n, width = values.shape[0], -(-values.shape[1] // 16)
    bits = np.zeros((n, width * 16), _U)
    bits[:, : values.shape[1]] = mix(values) & _U(15)
    return (bits.reshape(n, width, 16) << (np.arange(16, dtype=_U) * _U(4))).sum(2, dtype=_U)


def most_differences(values: int, percent: int, risk: float = 1e-7) -> int:
    """How many of ``values`` sketched values may differ: a pair of at least ``percent`` % similarity
    exceeds this with a probability of at most ``risk``."""
    p = 1 - (percent / 100 + (1 - percent / 100) / 16)
    tail, k = 1.0, -1
    while tail > risk and k < values:
        k += 1
        tail = sum(math.comb(values, j) * p**j * (1 - p) ** (values - j) for j in range(k + 1, values + 1))
    return k


def _differences(a: Column, b: Column) -> Column:
    """Sketched values in which two sketches differ."""

    def word(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, word), F.lit(0), lambda n, x: n + x)


def signatures(docs: DataFrame, size: int, permutations: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, n_shingles, words, bands, sketch, body): words is a digest of the lower-cased words, body the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "_text"):
                data, off = utf8_buffer(part.column(1))
                sets = shingle_sets(data, off, size)
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                values = min_max(full, permutations)
                keys, brief = band_keys(values, rows), sketches(values)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * x.shape[1])]), pa.int32()), pa.array(x.astype(np.int64).ravel()))
                raw, cut = data.tobytes(), off.tolist()
                texts = [raw[a:b] for a, b in zip(cut, cut[1:])]
                words = pa.array([hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() if k else None for t, k in zip(texts, n)], pa.binary())
                body = pa.array([press.compress(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), words, lists(keys), lists(brief), body], names=["_id", "n_shingles", "words", "bands", "sketch", "body"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows_in.mapInArrow(frugal(run), "_id long, n_shingles long, words binary, bands array<long>, sketch array<long>, body binary")


def _verified(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets' similarity is at least ``percent`` %; sets are compared word by word."""
    one = bodies.select(F.col("_id").alias("b"), F.col("body").alias("body_b"))
    hub = bodies.select(F.col("_id").alias("a"), F.col("body").alias("body_a"))
    both = pairs.join(one, "b").join(hub, "a").select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        recent: OrderedDict[int, frozenset] = OrderedDict()
        held = 0  # shingles of all recent sets

        def shingles(key: int, body) -> frozenset:
            nonlocal held
            if key in recent:
                recent.move_to_end(key)
                return recent[key]
            out = recent[key] = exact_shingles(unpress.decompress(body.as_py()), size)
            held += len(out)
            while len(recent) > 64 or held > 100_000 and len(recent) > 1:
                held -= len(recent.popitem(last=False)[1])
            return out

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for i in range(batch.num_rows):
                x, y = shingles(a[i], batch.column(2)[i]), shingles(b[i], batch.column(3)[i])
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both) and both:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    return both.mapInArrow(frugal(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b) but the roots, with the least node it reaches."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large-star: larger neighbours move to a node's least neighbour.
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        # Small-star: a node and its smaller neighbours move to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(low, "b")
        small = met.select(F.col("m").alias("a"), F.col("a").alias("b")).union(met.select(F.col("m").alias("a"), "b"))
        before, edges = edges, materialize(small.where("a <> b").distinct())
        drop_table(before)
        # Done when all are stars: a node is a root, or it has one root.
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        odd = ends.groupBy("x").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 OR down = 1 AND up = 1")
        if not odd.limit(1).count():
            out = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            out._loom_path = edges._loom_path  # so that it can be dropped in its turn
            return out


def near_duplicates(
    df: DataFrame, size: int = 5, percent: int = 80, permutations: int = 48, rows: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``df`` with n_shingles, component_id (least id reachable) and kept (it is its own)."""
    if rows < 1 or 2 * permutations % rows:
        raise ValueError("bands must use up the values of all permutations")
    own = ("n_shingles", "component_id", "kept")
    df = df.drop(*[c for c in own if c not in (id_col, text_col)])
    signed = materialize(signatures(df, size, permutations, rows, id_col, text_col))
    known = signed.where("_id IS NOT NULL AND n_shingles > 0")
    sets = ["words", "n_shingles"]
    # One class per sequence of words; its bands are the same for all members.
    classes = materialize(known.groupBy(*sets).agg(F.min("_id").alias("rep"), F.count("*").alias("_n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    many = classes.where("_n > 1").select(*sets, "rep")
    # A class goes by its least id, or by a number where an id of several texts is the least one of several classes.
    shared = classes.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").limit(1).count()
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id())) if shared else classes.withColumn("node", F.col("rep"))

    rows_of = classes.select(F.explode("bands").alias("key"), F.col("node").alias("doc"), F.col("n_shingles").alias("n"), "sketch", F.lit(0).alias("at"))
    crowded = rows_of.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    members = materialize(rows_of.join(crowded, "key"))
    met_sets = classes.select(*sets, F.col("rep").alias("_id"), "node").join(members.select(F.col("doc").alias("node")).distinct(), "node")
    bodies = materialize(signed.join(met_sets, [*sets, "_id"]).select(*sets, "_id", "node", "body").dropDuplicates([*sets, "_id"]).select(F.col("node").alias("_id"), "body"))

    tested, root, pivots, apart = None, None, 1, most_differences(2 * permutations, percent)
    hubs = True  # the first round: each bucket's least member is its pivot
    met = None
    while True:
        placed = members.withColumn("c", F.col("doc")) if root is None else join_small(members, root.withColumnRenamed("node", "doc"), "doc").withColumn("c", F.coalesce("root", "doc")).drop("root")
        if hubs:
            chosen = placed.groupBy("key").agg(F.array(F.min(F.struct("doc", "n", "c", "sketch", "at"))).alias("p"))
        else:
            # Buckets of one component are done. So are members whose place allows smaller partners only
            # than are left.
            drawn = F.min_by("c", F.xxhash64("doc", F.lit(pivots)))
            open_keys = placed.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), drawn.alias("_main"), F.min("n").alias("_least")).where("_lo < _hi").drop("_lo", "_hi")
            placed = placed.join(open_keys, "key").where((100 + percent) * (F.col("n") - F.col("at")) >= percent * (F.col("n") + F.col("_least")))
            # Pivots: the smallest set of each slot that a hash deals out, of those outside the component
            # of a member drawn by hash, so that strays among many copies have their turn soon. At most
            # 64 of a bucket's members come together in a row.
            slot = F.pmod(F.xxhash64("doc", F.lit(pivots)), F.lit(pivots))
            strays = placed.where(F.col("c") != F.col("_main"))
            placed = placed.drop("_main", "_least")
            chosen = strays.groupBy("key", slot.alias("_slot")).agg(F.min(F.struct("n", "doc", "c", "sketch", "at")).alias("p"))
            chosen = chosen.groupBy("key", F.floor(F.col("_slot") / 64).alias("_part")).agg(F.collect_list("p").alias("p")).drop("_part")
        previous, met = met, materialize(placed.join(chosen, "key"))
        drop_table(previous, members)
        if not met.limit(1).count():
            break
        # Sizes, places and sketches leave out, before any row is made, pairs that can't be similar enough:
        # what precedes the first shared shingle of the prefixes is not shared.
        near = lambda x: (
            (F.col("c") != x.c)
            & (100 * F.least("n", x.n) >= percent * F.greatest("n", x.n))
            & ((100 + percent) * F.least(F.col("n") - F.col("at"), x.n - x.at) >= percent * (F.col("n") + x.n))
            & (_differences(F.col("sketch"), x.sketch) <= apart)
        )
        ends = F.explode(F.transform(F.filter("p", near), lambda x: F.struct(F.least("doc", x.doc).alias("a"), F.greatest("doc", x.doc).alias("b"))))
        pairs = met.select(ends.alias("e")).select("e.a", "e.b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = materialize(_verified(pairs, bodies, size, percent))
        # Pivots have met their buckets. A member meets the parts of a bucket's pivots in several rows; it stays
        # if it is no pivot in any.
        members = met.groupBy("key", "doc").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("at").alias("at"), F.max(F.array_contains(F.transform("p", lambda x: x.doc), F.col("doc"))).alias("_was")) if pivots > 64 else met.withColumn("_was", F.array_contains(F.transform("p", lambda x: x.doc), F.col("doc")))
        members = members.where("NOT _was").select("key", "doc", "n", "sketch", "at")
        if fresh.limit(1).count():
            links = fresh if root is None else root.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(fresh)
            before, root = root, components(links)
            drop_table(before)
        drop_table(fresh)
        if hubs:
            hubs = False
            # Most copies are linked now. Documents of buckets that hold several components still may be
            # merely similar in great number; the rare shingles of their sets tell such apart.
            mixed = met.select("key", "doc") if root is None else join_small(met.select("key", "doc"), root.withColumnRenamed("node", "doc"), "doc").select("key", F.coalesce("root", "doc").alias("doc"))
            mixed = mixed.groupBy("key").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).where("_lo < _hi").select("key")
            doubtful = materialize(met.join(mixed, "key").groupBy("doc").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
            members = materialize(_prefixes(doubtful, bodies, size, percent).join(doubtful, "doc").select("key", "doc", "n", "sketch", "at"))
        else:
            pivots = min(pivots * 16, 64) if pivots < 64 else pivots * 4
    drop_table(met, bodies)
    if shared and root is not None:  # from classes to their ids, which link up through the ids of several texts
        rep_of = classes.select("node", "rep")
        ids = root.join(rep_of, "node").select("root", F.col("rep").alias("b"))
        root = ids.join(rep_of.withColumnRenamed("node", "root").withColumnRenamed("rep", "a"), "root").select(F.col("a").alias("root"), F.col("b").alias("node"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    result = df.join(_per_id(signed, known, many, root, sets), F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left")
    return result.select(*columns, F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.col("component_id"), F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True)).alias("kept"))


def _prefixes(docs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, doc, at): of each document, the shingles of its prefix that another document's set holds, and their places.

    Shingles are ordered by their number of these documents, rare ones first. Two sets of at least
    ``percent`` % similarity share a shingle among the first n - ceil(percent * n / 100) + 1 of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [unpress.decompress(x.as_py()) for x in part.column(1)]
                sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), size)
                upto = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(upto, pa.array(np.concatenate(sets).astype(np.int64)))], names=["doc", "s"])

    sets = docs.select(F.col("doc").alias("_id")).join(bodies, "_id").select("_id", "body").mapInArrow(frugal(run), "doc long, s array<long>")
    rows = sets.select("doc", F.explode("s").alias("key"))
    df = rows.groupBy("key").agg(F.count("*").alias("df"))
    each = rows.join(df, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))  # one text's shingles
    n = F.size("s")
    prefix = F.slice("s", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    return each.select("doc", F.posexplode(prefix).alias("at", "x")).where("x.df > 1").select("x.key", "doc", "at")


def _per_id(signed: DataFrame, known: DataFrame, many: DataFrame, root: DataFrame | None, sets: list[str]) -> DataFrame:
    """(_id, n_shingles, component_id), one row per id (rows of one id: the largest set counts)."""
    repeats = signed.groupBy("_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count()
    if not repeats:  # an id has one set, so its class's component is its own
        out = signed.select("_id", *sets).join(many, sets, "left").withColumn("rep", F.coalesce("rep", "_id"))
        out = out.withColumn("root", F.col("rep")) if root is None else join_small(out, root.withColumnRenamed("node", "rep"), "rep")
        return out.select("_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    # Sets of one id link their components: members of a class and ids of several sets are edges too.
    links = known.select("_id", *sets).join(many, sets).select(F.col("rep").alias("a"), F.col("_id").alias("b"))
    if root is not None:
        links = links.unionByName(root.select(F.col("root").alias("a"), F.col("node").alias("b")))
    final = components(links)
    per_id = signed.groupBy("_id").agg(F.max("n_shingles").alias("n_shingles"))
    return per_id.join(final, F.col("_id") == F.col("node"), "left").select("_id", "n_shingles", F.coalesce("root", "_id").alias("component_id"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document, by its 3-word shingles at 85 %."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=3, percent=85, permutations=40).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, len(x)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * joint >= 85 * (x.n + y.n - joint)),
f AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT f.b, r.c FROM r JOIN f ON f.a = r.doc_id WHERE r.c < f.b)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""
